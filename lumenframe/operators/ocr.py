"""What follows from recognized text: word statistics, the text itself and the title strip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TITLE_BAND
from ..functions.numbers import unit


def word_stats(words: DataFrame) -> DataFrame:
    """(hash, ocr_word_count, ocr_text_area_ratio) of ``words(hash, image_width, image_height, width, height)``, one row a word."""
    area = F.greatest(F.max(F.col("image_width") * F.col("image_height")), F.lit(1.0))
    return words.groupBy("hash").agg(F.count("*").cast("int").alias("ocr_word_count"), unit((F.sum(F.col("width") * F.col("height")) / area).cast("float")).alias("ocr_text_area_ratio"))


def result_stats() -> tuple[Column, Column]:
    """The same of a nested result's columns ``width``, ``height`` and ``lines``; no words count 0 and 0."""
    words = F.flatten(F.transform("lines", lambda x: x["words"]))
    area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0).cast("float"))
    covered = F.aggregate(words, F.lit(0.0), lambda s, w: s + (w["width"] * w["height"]).cast("double"))
    return F.size(words).cast("int"), unit((covered / area).cast("float"))


def image_text() -> Column:
    """The lines of a nested result, a line break between them."""
    return F.array_join(F.transform("lines", lambda x: x["text"]), "\n")


def line_top(words: Column) -> Column:
    """The highest word's top; null for a line without words."""
    return F.array_min(F.transform(words, lambda w: w["y"]))


def title_band(height: Column, share: float = TITLE_BAND) -> Column:
    """The height down to which a line belongs to the title bar: a share of the image, one pixel at least."""
    return F.greatest((height * F.lit(share).cast("float")).cast("float"), F.lit(1.0).cast("float"))


def title_strip(share: float = TITLE_BAND) -> Column:
    """The lines of a nested result that begin in the title band, joined by spaces."""
    band = title_band(F.col("height"), share)
    inside = F.filter("lines", lambda x: F.coalesce(line_top(x["words"]) <= band, F.lit(False)))
    return F.array_join(F.transform(inside, lambda x: x["text"]), " ")


def joined_lines(lines: DataFrame, separator: str = "\n") -> DataFrame:
    """(hash, text) of ``lines(hash, line_no, text)``, one row a line, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("hash").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"))
