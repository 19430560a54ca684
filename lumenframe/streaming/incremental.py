"""Incremental enrichment: result files stream into the record store, a bounded number a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import CHECKPOINT_ROWS
from ..functions.paths import is_image
from ..operators.classify import classify
from ..operators.passes import Pass
from ..operators.reconcile import merge_columns
from ..sinks.store import RecordStore
from ..sources.files import hash_files


def merge_batch(store: RecordStore, columns: list[str], now: str) -> Callable[[DataFrame, int], None]:
    """Merges a batch of updates into what is stored now and classifies; merging a batch again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.commit(lambda c, r: (c, classify(merge_columns(r, batch, columns), F.lit(now), c.ocr_word_threshold, c.ocr_area_threshold, c.nsfw_score_threshold)))

    return merge


def stream_results(spark: SparkSession, folder: str, schema: str, which: Pass, store: RecordStore, checkpoint: str, now: str, files_per_batch: int = CHECKPOINT_ROWS) -> StreamingQuery:
    """Starts a query that takes what has arrived in ``folder`` and ends; a restart goes on after the last commit."""
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return arrived.writeStream.foreachBatch(merge_batch(store, list(which.columns), now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_images(spark: SparkSession, folder: str, enrich: Callable[[DataFrame], DataFrame], which: Pass, store: RecordStore, checkpoint: str, now: str, files_per_batch: int = CHECKPOINT_ROWS) -> StreamingQuery:
    """The same over image files as they appear in a mounted folder: each batch is hashed as scans do, enriched and merged.

    Spark lists the files; only their first 64 KiB are read, by ``hash_files``.
    """
    listed = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    place = F.regexp_replace("path", "^file:/+", "/")
    name = F.element_at(F.split("path", "/"), -1)
    rows = listed.select(F.lit(None).cast("string").alias("hash"), F.col("path").alias("relative_path"), place.alias("absolute_path"), name.alias("name"), F.col("length").alias("size"))
    merge = merge_batch(store, list(which.columns), now)

    def hashed(batch: DataFrame) -> DataFrame:
        return hash_files(batch.where(is_image(F.col("name")))).drop("size")

    return rows.writeStream.foreachBatch(lambda b, i: merge(enrich(hashed(b)), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
