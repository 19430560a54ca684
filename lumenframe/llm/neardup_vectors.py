"""Embedding near-duplicates: all pairs of vectors with a cosine of at least a threshold, by cover trees.

Equal vectors are first taken together.  The top of a cover tree over a bounded sample gives cells;
every vector goes to its nearest cell, cells to blocks of bounded size by hash, and every block gets a
cover tree of its own.  Pairs of cells whose covering radii keep them apart are pruned; the trees of
all other block pairs are traversed together.  Blocks are dealt in squares of up to ``SQUARE`` by SQUARE
blocks, so that a tree travels once a square and not once a partner; a task holds one square.  Links
between different vectors are all found, and only counts and a spanning forest of them leave the task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .covertree import SLACK, CoverTree, chords, dual_pairs, net
from .simhash import settle
from .storage import Table, join_keyed

COSINE = 0.95
#: Vectors from which the top of the tree is made, and its cells, at most.
SAMPLE = 2048
CELLS = 256
#: Vectors in a block, on average.
BLOCK_ROWS = 4096
#: Blocks on a side of a square, for vectors of SQUARE_WIDTH components or fewer; wider ones have smaller squares.
SQUARE = 8
SQUARE_WIDTH = 64
NO_ID = 1 << 62


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, shorter ones filled up with zeros."""
    rows = [np.frombuffer(x, kind) for x in raw]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, x in enumerate(rows):
        x = x.astype(np.float64)
        x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
        out[i, : len(x)] = x / np.linalg.norm(x)
    return out


def _marks(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, raw): a vector's values as bytes, null if it is null, zero, empty or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            values = lists.flatten()
            bad = ~values.is_valid().to_numpy(zero_copy_only=False)
            flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            bad |= ~np.isfinite(flat)
            flat = flat + np.zeros(1, kind)  # a negative zero is a zero
            ends = np.cumsum(counts).tolist()
            raw = []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                raw.append(flat[a:b].tobytes() if b > a and not bad[a:b].any() and flat[a:b].any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "raw"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, raw binary")


def top_cells(sample: np.ndarray) -> np.ndarray:
    """Centres of the deepest net of the sample, radii halving from 2, that has CELLS of them at most."""
    best, radius = sample[:1], 2.0
    while radius > 0.05 and len(sample):
        radius /= 2
        found = net(sample, radius, CELLS)
        if found is None:
            break
        best = sample[found[0]]
    return best


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def vector_links(reps: DataFrame, width: int, kind: str, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> Table:
    """``reps(node, raw, copies)`` -> rows (a, b, n): b null: n vectors link to a; else an edge of a forest of the links."""
    spark = reps.sparkSession
    drawn = reps.select("raw", F.xxhash64("raw").alias("h"), "node").orderBy("h", "node").limit(SAMPLE).collect()
    pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    centres = top_cells(pad(unit_rows([bytes(r.raw) for r in drawn], kind))) if drawn else np.zeros((0, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = chords(pad(unit_rows(batch.column("raw").to_pylist(), kind)), centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["node", "raw", "copies", "cell", "away"])

    placed = Table(reps.select("node", "raw", "copies").mapInArrow(assign, "node long, raw binary, copies long, cell int, away double"), "cells").df
    # CELLS rows at most.
    cells = {r.cell: (-(-r.n // block_rows), r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    limit = np.sqrt(2 - 2 * cosine) + SLACK
    apart = chords(centres, centres)
    partners = {c: [k for k in cells if apart[c, k] <= cells[c][1] + cells[k][1] + limit] for c in cells}
    subs = {c: s for c, (s, _) in cells.items()}
    block_of = F.pmod(F.xxhash64("node"), F.create_map(*[F.lit(x) for c in cells for x in (c, subs[c])])[F.col("cell")]) if cells else F.lit(0)

    def plant(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        raw = group["raw"].to_pylist()
        x = pad(unit_rows(raw, kind))
        tree = CoverTree.build(x)
        dims = np.array([len(r) for r in raw])[tree.order]
        blob = _pack(nodes=group["node"].to_numpy()[tree.order], copies=group["copies"].to_numpy()[tree.order], dims=dims, values=np.frombuffer(b"".join(r.ljust(width * np.dtype(kind).itemsize, b"\0") for r in raw), kind).reshape(len(raw), width)[tree.order], lo=tree.lo, hi=tree.hi, first=tree.first, last=tree.last, radius=tree.radius, centre=tree.centre)
        return pa.table({"cell": [group["cell"][0].as_py()], "sub": [group["sub"][0].as_py()], "tree": pa.array([blob], pa.binary())}, pa.schema([("cell", pa.int32()), ("sub", pa.int64()), ("tree", pa.binary())]))

    trees = placed.withColumn("sub", block_of.cast("long")).groupBy("cell", "sub").applyInArrow(plant, "cell int, sub long, tree binary")

    # Squares of one block while there are few blocks, so that all cores have some.
    per = max(1, min(SQUARE * SQUARE_WIDTH // max(width, SQUARE_WIDTH), sum(subs.values()) // max(1, int((8 * spark.sparkContext.defaultParallelism) ** 0.5))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each square that a block is part of; s1 and s2 number runs of ``per`` blocks of a cell."""
        for batch in batches:
            for cell, sub, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for other in partners[cell]:
                    keys = [sorted(((cell, sub // per), (other, s))) for s in range(-(-subs[other] // per))]
                    for k in range(0, len(keys), 64):
                        some = keys[k : k + 64]
                        flat = [[p[0][0] for p in some], [p[0][1] for p in some], [p[1][0] for p in some], [p[1][1] for p in some]]
                        mine = [pa.array([v] * len(some), pa.int64()) for v in (cell, sub)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in flat), *mine, pa.array([tree] * len(some), pa.binary())], ["c1", "s1", "c2", "s2", "cell", "sub", "tree"])

    def traverse(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cell", "ascending"), ("sub", "ascending")])
        trees, nodes, copies, dims = [], [], [], []
        for blob in group["tree"].to_pylist():
            z = np.load(io.BytesIO(blob))
            values = z["values"].astype(np.float64)
            values /= np.abs(values).max(axis=1, keepdims=True)
            values /= np.linalg.norm(values, axis=1, keepdims=True)
            trees.append(CoverTree(np.arange(len(values)), values, z["lo"], z["hi"], z["first"], z["last"], z["centre"], z["radius"]))
            nodes.append(z["nodes"])
            copies.append(z["copies"])
            dims.append(z["dims"])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in nodes])))
        nodes, copies, dims = (np.concatenate(v) for v in (nodes, copies, dims))
        counts, names = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        first = [group[c][0].as_py() for c in ("c1", "s1")]
        inside = [[cell, sub // per] == first for cell, sub in zip(group["cell"].to_pylist(), group["sub"].to_pylist(), strict=True)]
        for p, q in combinations_with_replacement(range(len(trees)), 2):
            if inside[p] == inside[q] and not all(inside):
                continue  # two blocks of one side meet in another square
            for i, j in dual_pairs(trees[p], trees[q], cosine, p == q):
                i, j = i + offsets[p], j + offsets[q]
                alike = dims[i] == dims[j]
                i, j = i[alike], j[alike]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                settle(names, i, j)
        tied, found = np.flatnonzero(names != np.arange(len(nodes))), np.flatnonzero(counts)
        return pa.table({"a": np.concatenate((nodes[names[tied]], nodes[found])), "b": pa.array(np.concatenate((nodes[tied], np.zeros(len(found), np.int64))), mask=np.arange(len(tied) + len(found)) >= len(tied)), "n": np.concatenate((np.zeros(len(tied), np.int64), counts[found]))})

    dealt = trees.mapInArrow(deal, "c1 long, s1 long, c2 long, s2 long, cell long, sub long, tree binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Table(dealt.repartition(n, "c1", "s1", "c2", "s2").groupBy("c1", "s1", "c2", "s2").applyInArrow(traverse, "a long, b long, n long"), "links")


def embedding_components(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Rows link if their cosine, in double precision, is at least ``cosine``; vectors that are null,
    empty, zero or hold null or non-finite values, and vectors of different lengths, don't link.
    n_links counts the other rows linked directly; component_id is the smallest id reachable; rows
    without id link too but name no component; no rows give none; other columns are ignored.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)[vector_col] else "<f4"
    marks = Table(_marks(vectors, id_col, vector_col, kind), "marks").df
    key = F.md5("raw")
    reps = marks.where("raw is not null").groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    reps = reps.withColumn("node", F.coalesce("id", F.lit(NO_ID) + F.pmod(F.xxhash64("raw"), F.lit(NO_ID >> 1))))
    # Two vectors may share the smallest id; nodes must not, or they would count as linked.
    reps = Table(reps.select("raw", "copies", "id", "node", F.xxhash64("raw").alias("h")), "reps").df
    twice = reps.groupBy("node").count().where("count > 1").drop("count")
    reps = Table(reps.join(Table(twice, "twice").df.withColumn("again", F.lit(True)), "node", "left").select("raw", "copies", "id", F.when(F.col("again"), F.lit(NO_ID) + F.pmod("h", F.lit(NO_ID >> 1))).otherwise(F.col("node")).alias("node")), "nodes").df
    width = (reps.agg(F.max(F.length("raw"))).first()[0] or 0) // np.dtype(kind).itemsize
    found = vector_links(reps, width, kind, cosine, block_rows).df
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = connected_components(found.where("b is not null").select("a", "b"))
    info = reps.join(counts, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    info = Table(info.select("raw", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "id", "class"), "info").df
    least = info.groupBy("class").agg(F.min("id").alias("component_id"))
    info = Table(info.join(least, "class").select(key.alias("key"), F.col("copies").alias("n"), "n_links", "component_id"), "classes").df
    alive = join_keyed(marks.where("raw is not null").select("id", key.alias("key")), info, "key").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = marks.where("raw is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return alive.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
