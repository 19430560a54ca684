"""What a library shows: the joined view, counts, and filtered and sorted slices of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ROOT
from ..functions.text import matches_search, natural_key

CARRIED = ("category", "classified_by", "classified_at", "ocr_word_count", "ocr_text_area_ratio", "ocr_text_chars", "nsfw_score", "nsfw_labels", "video_title", "vision_desc_chars")


def name_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name) of a short list, of a size the planner knows, so that joins with it needn't shuffle the other side."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in names]).cast("array<string>")).alias("name"))


def outside(rows: DataFrame, column: str, excluded: list[str] | DataFrame) -> DataFrame:
    """Rows whose column isn't among the excluded names: a filter for a list, an anti join for a table."""
    if isinstance(excluded, DataFrame):
        return rows.join(excluded.select(F.col("name").alias(column)), column, "left_anti")
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*excluded)) if excluded else rows  # a form that scans take


def library_view(files: DataFrame, records: DataFrame) -> DataFrame:
    """Every file with its record's columns, null where it has none; an empty video title shows as null."""
    carried = [c for c in CARRIED if c in records.columns]
    joined = files.join(records.select("hash", *carried), "hash", "left")
    return joined.withColumn("video_title", F.nullif("video_title", F.lit(""))) if "video_title" in carried else joined


def with_thumbnails(view: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """The view with ``thumbnails(hash, thumbnail)``, null where there is none."""
    return view.join(thumbnails.select("hash", "thumbnail"), "hash", "left")


def category_counts(view: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, image_count) of every category, files counted one by one, 0 where there are none."""
    counts = view.where(F.col("category").isNotNull()).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    return categories.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("image_count"))


def unclassified_count(view: DataFrame) -> DataFrame:
    return view.agg(F.count_if(F.col("category").isNull()).alias("unclassified"))


def folder_counts(view: DataFrame, folders: DataFrame, excluded: DataFrame) -> DataFrame:
    """(name, is_manual, is_root, image_count, excluded) of every source folder; the root's only if it holds images."""
    own = (F.col("is_root") if "is_root" in view.columns else F.col("source_folder") == ROOT).alias("is_root")
    counts = view.groupBy(F.col("source_folder").alias("name"), own).agg(F.count("*").alias("n"))
    listed = folders.select("name", "is_manual", F.lit(False).alias("is_root")).join(counts, ["name", "is_root"], "left")
    root = counts.where("is_root").select("name", "is_root", F.lit(False).alias("is_manual"), "n")
    every = listed.unionByName(root)
    marks = excluded.select("name", F.lit(True).alias("_out")).distinct()
    return every.join(marks, "name", "left").select("name", "is_manual", "is_root", F.coalesce("n", F.lit(0)).cast("long").alias("image_count"), F.coalesce("_out", F.lit(False)).alias("excluded"))


def included(view: DataFrame, folders: DataFrame, excluded: DataFrame, any_folders: bool = True) -> DataFrame:
    """Files of folders that aren't excluded; all files of a library without folders."""
    if not any_folders:
        return view
    inside = folders.select("name").join(excluded.select("name"), "name", "left_anti").select(F.col("name").alias("source_folder")).distinct()
    return view.join(inside, "source_folder", "left_semi")


def filtered(view: DataFrame, kind: str = "all", category: str | None = None, query: str = "") -> DataFrame:
    """All, unclassified or one category's files whose name or path contains the query."""
    if kind == "unclassified":
        view = view.where(F.coalesce(F.col("category"), F.lit("")) == "")
    elif kind == "category":
        view = view.where(F.col("category") == category)
    return view.where(matches_search(F.col("name"), F.col("relative_path"), query))


def order(kind: str) -> list[Column]:
    """Sort keys: ``library`` (newest, then name in byte order), ``newest``, ``size`` and ``name`` (natural names); paths break ties."""
    newest, size, name = F.col("modified_ms").desc(), F.col("size").desc(), natural_key(F.col("name"))
    return {"library": [newest, F.col("name")], "newest": [newest, name], "size": [size, name], "name": [name]}[kind] + [F.col("relative_path")]


def viewport(view: DataFrame, kind: str, start: int, end: int) -> DataFrame:
    """Rows start .. end - 1 of the sorted view."""
    return view.orderBy(*order(kind)).offset(start).limit(max(0, end - start))


def categories_sorted(categories: DataFrame) -> DataFrame:
    return categories.orderBy(F.lower("name"), "name")
