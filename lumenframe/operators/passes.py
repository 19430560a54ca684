"""Enrichment passes: what is pending, why something is skipped, and one runner for all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SCORE_THRESHOLD
from ..functions.numbers import float_threshold
from .reconcile import merge_columns
from .views import outside


@dataclass(frozen=True)
class Pass:
    """A pass fills ``columns``; it is pending while ``marker`` is null.

    ``explicit``: how the score counts: ``any``, ``not_explicit`` (unscored files too) or
    ``scored`` (scored and below the threshold).
    """

    name: str
    marker: str
    columns: tuple[str, ...]
    explicit: str = "any"
    needs_folder: bool = False


PASSES = {
    p.name: p
    for p in (
        Pass("nsfw", "nsfw_score", ("nsfw_score", "nsfw_labels")),
        Pass("chunk", "video_title", ("video_title",)),
        Pass("text", "ocr_word_count", ("ocr_word_count", "ocr_text_area_ratio"), "not_explicit", True),
        Pass("extract", "ocr_text_chars", ("ocr_text_chars",), needs_folder=True),
        Pass("vision", "vision_desc_chars", ("vision_desc_chars",), "scored"),
    )
}
#: The order in which a queue and a scheduled refresh run them.
QUEUE = ("nsfw", "chunk", "text", "extract", "vision")
SCHEDULED = ("nsfw", "text", "extract")


def pending(view: DataFrame, which: Pass, excluded: list[str] | DataFrame, force: bool = False, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Files of folders that aren't excluded for which the pass has to run; a file without record is pending.

    The folder filter comes first, being cheap and below anything a model does.
    """
    rows = outside(view, "source_folder", excluded)
    below = F.col("nsfw_score") < float_threshold(threshold)
    if which.explicit == "not_explicit":
        rows = rows.where(F.coalesce(below, F.lit(True)))
    elif which.explicit == "scored":
        rows = rows.where(F.coalesce(below, F.lit(False)))
    return rows if force else rows.where(F.col(which.marker).isNull())


def skip_reason(threshold: float = SCORE_THRESHOLD) -> Column:
    """Why a file isn't described, in order: an unsampled video frame, explicit, unscored; null if none holds."""
    score = F.col("nsfw_score")
    return F.when(F.col("unsampled"), "video").when(score >= float_threshold(threshold), "explicit").when(score.isNull(), "unscored")


def with_unsampled(view: DataFrame, plan: DataFrame | None) -> DataFrame:
    """The view with ``unsampled``: a member of a video that the plan hasn't selected."""
    if plan is None:
        return view.withColumn("unsampled", F.lit(False))
    members = plan.select(F.explode("member_hashes").alias("hash"), F.lit(0).alias("chosen"))
    chosen = plan.select(F.explode("selected_hashes").alias("hash"), F.lit(1).alias("chosen"))
    marks = members.unionAll(chosen).groupBy("hash").agg((F.max("chosen") == 0).alias("_unsampled"))
    return view.join(marks, "hash", "left").withColumn("unsampled", F.coalesce("_unsampled", F.lit(False))).drop("_unsampled")


def skip_counts(view: DataFrame, plan: DataFrame | None, excluded: list[str] | DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """(reason, n): each file of an included folder counts once, described already or not."""
    rows = outside(view, "source_folder", excluded)
    rows = with_unsampled(rows, plan).select(skip_reason(threshold).alias("reason"))
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def vision_eligible(view: DataFrame, plan: DataFrame | None, excluded: list[str] | DataFrame, force: bool = False, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Files to describe: scored below the threshold, of included folders, sampled if of a video."""
    rows = with_unsampled(view, plan).where(~F.col("unsampled")).drop("unsampled")
    return pending(rows, PASSES["vision"], excluded, force, threshold)


def folder_gate(any_folders: bool, any_included: bool) -> str | None:
    """The message that ends a text or extraction pass early, if none of the folders is included."""
    return "All source folders are excluded from analysis." if any_folders and not any_included else None


def run_pass(records: DataFrame, todo: DataFrame, which: Pass, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records with the results of ``enrich``, which gets one file a hash and returns (hash, columns...).

    A failed item is left out or null, and so stays pending.
    """
    once = todo.groupBy("hash").agg(F.max(F.struct("relative_path", "absolute_path", "name")).alias("f")).select("hash", "f.*")
    return merge_columns(records, enrich(once), list(which.columns))
