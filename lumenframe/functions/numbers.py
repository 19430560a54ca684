"""Clamps, defaults, times and the letterbox."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DETECTOR_EDGE


def unit(x: Column) -> Column:
    """Clamped to 0 .. 1."""
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), x))


def clamp(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def tile_size(x: int) -> int:
    return int(clamp(x, 96, 280))


def float_threshold(x: float) -> Column:
    """A threshold to compare float columns with: of their own type, or 0.45 would not reach 0.45."""
    return F.lit(x).cast("float")


def iso_time(ts: Column) -> Column:
    """``2024-01-02T03:04:05.678Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, 0 for what is before."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(ts))


def letterbox(width: Column, height: Column, edge: int = DETECTOR_EDGE) -> Column:
    """(new_w, new_h, pad_x, pad_y) of an image fitted into a square, in single precision."""
    f = lambda x: x.cast("float")
    side = F.lit(float(edge)).cast("float")
    # Division widens to double in Spark; each quotient is rounded to single precision again.
    scale = F.least(f(side / f(width)), f(side / f(height)))
    fit = lambda x: F.greatest(F.lit(1), F.floor(f(f(x) * scale)).cast("int"))
    w, h = fit(width), fit(height)
    pad = lambda x: F.floor((F.lit(edge) - x) / 2).cast("int")
    return F.struct(w.alias("new_w"), h.alias("new_h"), pad(w).alias("pad_x"), pad(h).alias("pad_y"))
