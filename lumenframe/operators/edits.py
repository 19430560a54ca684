"""Edits of records and of the library's lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RECORD_COLUMNS


def assign(records: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Sets categories by hand: ``changes(hash, category, at)``; of several changes of a hash the latest counts.

    A null category clears category, classified_by and classified_at; an unknown hash gets a record.
    """
    last = changes.groupBy("hash").agg(F.max_by(F.struct("category"), "at").alias("_c")).select("hash", F.col("_c.category").alias("_category"), F.lit(True).alias("_set"))
    both = records.join(last, "hash", "full_outer")
    chosen, given = F.col("_set"), F.col("_category").isNotNull()
    new = {
        "category": F.col("_category"),
        "classified_by": F.when(given, "manual"),
        "classified_at": F.when(given, now),
    }
    columns = [c for c in RECORD_COLUMNS if c in records.columns]
    fresh = {c: F.when(chosen, v).otherwise(F.col(c)) for c, v in new.items()}
    if "last_known_path" in columns:
        fresh["last_known_path"] = F.coalesce("last_known_path", F.lit(""))
    return both.select("hash", *[fresh.get(c, F.col(c)).alias(c) for c in columns])


def rename_category(records: DataFrame, old: str, new: str) -> DataFrame:
    return records.withColumn("category", F.when(F.col("category") == old, F.lit(new)).otherwise(F.col("category")))


def delete_category(records: DataFrame, name: str) -> DataFrame:
    """Takes the category and its classifier off its records; classified_at stays."""
    hit = F.coalesce(F.col("category") == name, F.lit(False))
    return records.withColumns({c: F.when(~hit, F.col(c)) for c in ("category", "classified_by")})


def toggled(items: Column, item: Column, present: Column) -> Column:
    """A list with the item, added at the end if missing, or without it."""
    return F.when(present, F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))).otherwise(F.array_remove(items, item))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def same_name(a: Column, b: Column) -> Column:
    """Names are the same if they differ in the case of ASCII letters alone."""
    return F.translate(a, _UPPER, _LOWER) == F.translate(b, _UPPER, _LOWER)


def is_same_name(a: str, b: str) -> bool:
    """same_name of two strings."""
    table = str.maketrans(_UPPER, _LOWER)
    return a.translate(table) == b.translate(table)


def move_to_front(items: list[str], item: str) -> list[str]:
    """The most recently used first, each once."""
    return [item, *[x for x in items if x != item]]


def outside_root(paths: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(inside, outside) rows of ``paths(path)`` by whether they lie below the root."""
    base = root.rstrip("/") + "/"
    inside = F.col("path").startswith(base)
    return paths.where(inside), paths.where(~inside)
