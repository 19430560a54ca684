"""Detector output: class maxima, the explicit score, top classes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DETECTOR_CLASSES, EXPLICIT_CLASSES, EXPLICIT_CONFIDENCE, NO_CLASS_LABEL, TOP_CLASSES, TOP_CONFIDENCE
from ..functions.text import label_percent


def _zero() -> Column:
    return F.lit(0.0).cast("float")


def class_maxima(detections: DataFrame) -> DataFrame:
    """(hash, class, score): each class's largest score over all anchors, 0 at least; NaN never counts."""
    number = F.when(~F.isnan("score"), F.col("score"))
    return detections.groupBy("hash", "class").agg(F.greatest(_zero(), F.max(number)).alias("score"))


def explicit_scores(maxima: DataFrame) -> DataFrame:
    """(hash, nsfw_score): the largest maximum of an explicit class, 0 without one."""
    explicit = F.when(F.col("class").isin(*EXPLICIT_CLASSES), F.col("score"))
    return maxima.groupBy("hash").agg(F.greatest(_zero(), F.max(explicit)).alias("nsfw_score"))


def top_classes(maxima: DataFrame, most: int = TOP_CLASSES, least: float = TOP_CONFIDENCE) -> DataFrame:
    """(hash, rank, class, score) of the best classes: cut to ``most`` first, then to scores of ``least``; ties by index."""
    best = Window.partitionBy("hash").orderBy(F.col("score").desc(), "class")
    ranked = maxima.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.where(F.col("score") >= F.lit(least).cast("float")).select("hash", "rank", "class", "score")


def labels(maxima: DataFrame) -> DataFrame:
    """(hash, nsfw_score, nsfw_labels): explicit classes by index, then the top classes, or a sentence if there are none.

    A hash has 18 maxima at most, so its array is bounded; classes it lacks count as 0.
    """
    per = maxima.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("m"))
    name = F.array(*[F.lit(x) for x in DETECTOR_CLASSES])
    score = lambda i: F.coalesce(F.try_element_at("m", i), _zero())
    label = lambda kind, i: F.concat(F.lit(kind + " "), F.element_at(name, i + 1), F.lit(" "), label_percent(score(i)))
    sure = F.filter(F.array(*[F.lit(i) for i in EXPLICIT_CLASSES]), lambda i: score(i) >= F.lit(EXPLICIT_CONFIDENCE).cast("float"))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(DETECTOR_CLASSES) - 1)), lambda i: F.struct((-score(i)).alias("s"), i.alias("i"))))
    top = F.filter(F.slice(ranked, 1, TOP_CLASSES), lambda x: -x["s"] >= F.lit(TOP_CONFIDENCE).cast("float"))
    found = F.concat(F.transform(sure, lambda i: label("explicit", i)), F.transform(top, lambda x: label("top", x["i"])))
    best = F.array_max(F.transform(F.array(*[F.lit(i) for i in EXPLICIT_CLASSES]), score))
    return per.select("hash", F.greatest(_zero(), best).alias("nsfw_score"), F.when(F.size(found) == 0, F.array(F.lit(NO_CLASS_LABEL))).otherwise(found).alias("nsfw_labels"))
