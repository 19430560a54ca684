"""Connected components of a graph given as an edge table, without gathering any of it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Table


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, component)``, component being the smallest id reachable.

    Each round lets every node point to its least neighbour (by id in even rounds, by a hash of
    the id in odd ones, so that chains in id order shrink too), replaces both ends of every edge by
    their pointers and drops the loops this makes.  ``min`` combines before the shuffle, so a hub
    costs one row a task; the joins are plain sort-merge joins that AQE may split.  Every round is
    written to the shared folder, so a lost executor repeats one round at most.

    Null ends and self loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    clean = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = Table(clean, "edges")
    ends = F.explode(F.array("a", "b"))
    names = Table(live.df.select(ends.alias("node")).distinct().select("node", F.col("node").alias("to")), "names")
    rounds = 0
    while live.df.limit(1).count():
        order = (lambda c: F.col(c)) if rounds % 2 == 0 else (lambda c, r=rounds: F.xxhash64(F.col(c), F.lit(r)))
        both = live.df.select("a", "b").unionAll(live.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("id"))).alias("m"))
        best = best.select(F.col("a").alias("node"), F.least(F.struct(order("a").alias("o"), F.col("a").alias("id")), F.col("m"))["id"].alias("next"))
        hop = Table(best, "hop")
        left = hop.df.select(F.col("node").alias("a"), F.col("next").alias("x"))
        right = hop.df.select(F.col("node").alias("b"), F.col("next").alias("y"))
        moved = live.df.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = Table(moved, "edges")
        renamed = names.df.join(hop.df.select(F.col("node").alias("to"), "next"), "to", "left")
        called = Table(renamed.select("node", F.coalesce("next", "to").alias("to")), "names")
        for old in (live, names, hop):
            old.drop()
        live, names, rounds = after, called, rounds + 1
    least = names.df.groupBy("to").agg(F.min("node").alias("component"))
    return names.df.join(Table(least, "least").df, "to").select("node", "component")
