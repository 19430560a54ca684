"""Reconciling a scan with the stored records: hash reuse, upsert and scoped purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ROOT
from ..functions.paths import source_folder
from ..schema import RECORD_COLUMNS, RECORDS, struct


def hash_index(records: DataFrame) -> DataFrame:
    """(relative_path, size, modified_ms, hash) of records whose file facts are known."""
    known = records.where(F.col("size").isNotNull() & F.col("modified_ms").isNotNull() & (F.col("last_known_path") != ""))
    return known.select(F.col("last_known_path").alias("relative_path"), "size", "modified_ms", "hash")


def reuse_hashes(files: DataFrame, index: DataFrame) -> DataFrame:
    """``files`` with the hash of an unchanged path, size and time, else null; one row a file whatever the index holds."""
    once = index.groupBy("relative_path", "size", "modified_ms").agg(F.max("hash").alias("hash"))
    return files.drop("hash").join(once, ["relative_path", "size", "modified_ms"], "left")


def winners(files: DataFrame) -> DataFrame:
    """One file a hash: of copies the one with the largest relative path."""
    best = F.max(F.struct("relative_path", "size", "modified_ms"))
    return files.groupBy("hash").agg(best.alias("w")).select("hash", F.col("w.relative_path").alias("path"), F.col("w.size").alias("new_size"), F.col("w.modified_ms").alias("new_ms"))


def upsert(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with the path, size and time of their winning file; new hashes get blank records; ``seen`` marks those of the scan."""
    both = records.join(winners(files).withColumn("seen", F.lit(True)), "hash", "full_outer")
    fresh = {"last_known_path": F.coalesce("path", "last_known_path"), "size": F.coalesce("new_size", "size"), "modified_ms": F.coalesce("new_ms", "modified_ms")}
    return both.select("hash", *[fresh.get(c, F.col(c)).alias(c) for c in RECORD_COLUMNS], F.coalesce("seen", F.lit(False)).alias("seen"))


def survives(scanned: list[str]) -> Column:
    """Whether an upserted record stays: seen, or of a known path in a folder that wasn't scanned.

    The root is always scanned.  A record of a folder that wasn't is never purged: its files may well
    be there.
    """
    folder = source_folder(F.col("last_known_path"))
    return F.col("seen") | ((F.coalesce(F.col("last_known_path"), F.lit("")) != "") & ~folder.isin(ROOT, *scanned))


def purge(records: DataFrame, scanned: list[str] | DataFrame) -> DataFrame:
    """Upserted records without those whose folder was scanned and which weren't seen."""
    if isinstance(scanned, list):
        return records.where(survives(scanned)).drop("seen")
    folders = scanned.select(F.col("name").alias("_folder")).unionAll(scanned.sparkSession.createDataFrame([(ROOT,)], "_folder string")).distinct()
    unseen = records.where(~F.col("seen") & (F.coalesce(F.col("last_known_path"), F.lit("")) != ""))
    kept = unseen.withColumn("_folder", source_folder(F.col("last_known_path"))).join(folders, "_folder", "left_anti").drop("_folder")
    return records.where("seen").unionByName(kept.select(records.columns)).drop("seen")


def reconcile(records: DataFrame, files: DataFrame, scanned: list[str] | DataFrame) -> DataFrame:
    """The records after a scan: ``upsert`` and ``purge``."""
    return purge(upsert(records, files), scanned)


def no_records(spark) -> DataFrame:
    return spark.createDataFrame([], struct(RECORDS))


def merge_columns(records: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Sets columns of records that ``updates(hash, ...)`` names; other hashes of updates are dropped.

    An update's null is set too: it means pending.  Of several updates of a hash the largest counts.
    """
    once = updates.groupBy("hash").agg(F.max(F.struct(*columns)).alias("_new"))
    both = records.join(once, "hash", "left")
    return both.select("hash", *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns if c != "hash"])
