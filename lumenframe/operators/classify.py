"""Ordered threshold rules that classify records, as expressions.

Thresholds are compared as floats, like the columns; comparisons with a nullable category or
classifier are null-safe, so that an unclassified record is rewritten too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AREA_THRESHOLD, EXPLICIT, HIGH_TEXT, LOW_TEXT, SCORE_THRESHOLD, WORD_THRESHOLD

STATE = ("category", "classified_by", "classified_at")


def _state(category: Column, by: Column, at: Column) -> Column:
    return F.struct(category.alias("category"), by.alias("classified_by"), at.alias("classified_at"))


def _set(category: str, by: str, now: Column) -> Column:
    return _state(F.lit(category), F.lit(by), now)


def _nothing() -> Column:
    null = F.lit(None).cast("string")
    return _state(null, null, null)


def by_score(state: Column, score: Column, now: Column, threshold: Column) -> Column:
    """Explicit at the threshold or above; below it, what this rule itself had set is undone.  Manual and unscored states stay."""
    manual = state["classified_by"].eqNullSafe("manual")
    explicit = state["category"].eqNullSafe(EXPLICIT)
    return (
        F.when(manual | score.isNull(), state)
        .when(score >= threshold, F.when(explicit, state).otherwise(_set(EXPLICIT, "auto-nsfw", now)))
        .when(state["classified_by"].eqNullSafe("auto-nsfw"), _nothing())
        .otherwise(state)
    )


def by_text(state: Column, score: Column, words: Column, area: Column, now: Column, score_threshold: Column, word_threshold: Column, area_threshold: Column) -> Column:
    """Explicit first; then Low Text if words and area are within their thresholds, else High Text; rewritten only if different."""
    manual = state["classified_by"].eqNullSafe("manual")
    explicit = state["category"].eqNullSafe(EXPLICIT)
    wanted = F.when((words <= word_threshold) & (area <= area_threshold), LOW_TEXT).otherwise(HIGH_TEXT)
    return (
        F.when(manual, state)
        .when(F.coalesce(score >= score_threshold, F.lit(False)), F.when(explicit, state).otherwise(_set(EXPLICIT, "auto-nsfw", now)))
        .when(words.isNull() | area.isNull() | state["category"].eqNullSafe(wanted), state)
        .otherwise(_state(wanted, F.lit("auto"), now))
    )


def gates(records: DataFrame) -> DataFrame:
    """One row: whether any record has a score, and whether any has a word count."""
    some = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False))
    return records.agg(some("nsfw_score").alias("has_score"), some("ocr_word_count").alias("has_text"))


def classify(records: DataFrame, now: Column, word_threshold: int | Column = WORD_THRESHOLD, area_threshold: float | Column = AREA_THRESHOLD, score_threshold: float | Column = SCORE_THRESHOLD, rules: tuple[str, ...] = ("score", "text")) -> DataFrame:
    """``records`` with category, classified_by and classified_at after the score rule and then the text rule.

    A rule is idle until some record has what it looks at.  The gates are no test of their own: a rule
    changes only records that have a score or word counts, of which there are none behind a closed
    gate, so one pass over the records suffices.
    """
    threshold = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    words, area, score = threshold(word_threshold, "int"), threshold(area_threshold, "float"), threshold(score_threshold, "float")
    state = F.struct(*STATE)
    if "score" in rules:
        state = by_score(state, F.col("nsfw_score"), now, score)
    if "text" in rules:
        records = records.withColumn("_state", state)
        has_text = F.col("ocr_word_count").isNotNull() & F.col("ocr_text_area_ratio").isNotNull()
        scored = F.col("nsfw_score").isNotNull()
        after = by_text(F.col("_state"), F.col("nsfw_score"), F.col("ocr_word_count"), F.col("ocr_text_area_ratio"), now, score, words, area)
        # On its own, the text rule's explicit branch needs the text gate open.
        if "score" in rules:
            state = F.when(has_text | scored, after).otherwise(F.col("_state"))
        else:
            records = records.crossJoin(F.broadcast(gates(records.drop("_state")).select(F.col("has_text").alias("_open"))))
            state = F.when(F.col("_open"), after).otherwise(F.col("_state"))
    out = records.withColumn("_state", state)
    kept = [c for c in records.columns if c not in ("_state", "_open")]
    return out.select(*[F.col("_state")[c].alias(c) if c in STATE else F.col(c) for c in kept])


def invalidate_categories(records: DataFrame, categories: list[str] | DataFrame) -> DataFrame:
    """Takes category and classified_by off records whose category isn't in the list; classified_at stays."""
    if isinstance(categories, list):
        lost = F.col("category").isNotNull() & (~F.col("category").isin(*categories) if categories else F.lit(True))
    else:
        known = categories.select(F.col("name").alias("category"), F.lit(True).alias("_known")).distinct()
        records = records.join(known, "category", "left")
        lost = F.col("category").isNotNull() & F.col("_known").isNull()
    columns = [c for c in records.columns if c != "_known"]
    return records.select(*[F.when(~lost, F.col(c)).alias(c) if c in ("category", "classified_by") else F.col(c) for c in columns])


def ensure_categories(categories: list[str], has_score: bool, has_text: bool) -> list[str]:
    """The list with the built-in categories that open gates need, appended where missing, order kept."""
    wanted = ([EXPLICIT] if has_score else []) + ([LOW_TEXT, HIGH_TEXT] if has_text else [])
    return list(categories) + [c for c in wanted if c not in categories]
