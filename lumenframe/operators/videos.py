"""Video frames grouped by title, with a deterministic sample of each group that sticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SAMPLES_PER_GROUP
from ..functions.text import group_key


#: Parts of a group that are ranked apart, so that no task sorts a whole group.
PARTS = 64


def sampled(marked: DataFrame, n: int = SAMPLES_PER_GROUP) -> DataFrame:
    """(key, selected_hashes) of ``marked(key, hash)``: the hashes with the n smallest MD5s, sorted.

    Each part of a group keeps its n smallest, and the n smallest of these are the group's.
    """
    own = Window.partitionBy("key", "part").orderBy("m", "hash")
    first = marked.select("key", "hash", F.md5("hash").alias("m"), F.pmod(F.xxhash64("hash"), F.lit(PARTS)).alias("part"))
    first = first.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= max(n, 1))
    best = F.slice(F.array_sort(F.collect_list(F.struct("m", "hash"))), 1, max(n, 1))
    return first.groupBy("key").agg(F.array_sort(F.transform(best, lambda x: x["hash"])).alias("selected_hashes"))


def groups(titled: DataFrame) -> DataFrame:
    """(key, hash, title) of ``titled(hash, title)`` rows whose title has a letter or digit, each hash once a group."""
    keyed = titled.where(F.length("title") > 0).withColumn("key", group_key(F.col("title"))).where("key <> ''")
    return keyed.groupBy("key", "hash").agg(F.min("title").alias("title"))


def build_plan(titled: DataFrame, n: int = SAMPLES_PER_GROUP, previous: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(key, title, member_hashes, selected_hashes) of each group.

    A group whose ``previous(title, selected_hashes)`` selection still has a member keeps just what is
    left of it, in its order, neither topped up nor cut; with ``force``, and otherwise, the sample
    counts.  The title is that of the smallest hash; of previous groups with one key the one with the
    largest title counts.  The sample is taken from parts of a group; only its member list holds all
    of it, by its contract.
    """
    marked = groups(titled)
    members = marked.groupBy("key").agg(F.min_by("title", "hash").alias("title"), F.array_sort(F.collect_list("hash")).alias("member_hashes"))
    plan = members.join(sampled(marked, n), "key").select("key", "title", "member_hashes", "selected_hashes")
    if previous is None or force:
        return plan
    old = previous.withColumn("key", group_key(F.col("title"))).groupBy("key").agg(F.max_by("selected_hashes", "title").alias("before"))
    both = plan.join(old, "key", "left")
    left = F.filter("before", lambda x: F.array_contains("member_hashes", x))
    return both.select("key", "title", "member_hashes", F.when(F.size(left) > 0, left).otherwise(F.col("selected_hashes")).alias("selected_hashes"))


def plan_ordered(plan: DataFrame) -> DataFrame:
    return plan.orderBy(F.size("member_hashes").desc(), "title", "key")


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: groups, members and selected frames."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return plan.agg(F.count("*").alias("groups"), total("member_hashes").alias("members"), total("selected_hashes").alias("selected"))


def description_index(records: DataFrame) -> DataFrame:
    """(relative_path, hash) of every described record with a path."""
    return records.where(F.col("vision_desc_chars").isNotNull() & (F.col("last_known_path") != "")).select(F.col("last_known_path").alias("relative_path"), "hash")
