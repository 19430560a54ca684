"""SimHash near-duplicates: fingerprints, then a tiled exact comparison within a Hamming radius.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` disjoint bit fields.
Every distinct fingerprint is therefore filed under each of its fields; the fingerprints of one
field value are sorted by population count, cut into tiles, and tile pairs are compared by
exclusive-or and bit counts unless their population counts differ by more than the radius.  A
field value with more than ``tile_rows`` fingerprints is dealt out as tile pairs, by population
count and hash, so that no task holds more than two tiles.  Nothing is dropped: the links found
are exactly those a comparison of all pairs finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Table, join_keyed
from .words import blocks, buffers, map_texts, split

SEED = 42
RADIUS = 4
SHINGLE = 4
TILE_ROWS = 16384
STEP = 1024
#: The column that numbers the rows of an input.
ROW = "lumenframe_row"
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's shingles, XXH64 of all shingles) of A-Z-lowered texts."""
    bounds, flat = split(texts, lower=True)
    counts = np.diff(bounds)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat), " ")
    offsets, data = buffers(joined)
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends_of = np.cumsum(lengths + 1) if len(lengths) else lengths
    starts_of = ends_of - lengths - 1
    per = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out = np.concatenate(([0], np.cumsum(per)))
    doc = np.repeat(np.arange(len(per)), per)
    first = bounds[doc] + np.arange(out[-1]) - out[doc]
    last = np.minimum(first + size, bounds[doc + 1]) - 1
    shift = offsets[doc] - (starts_of[bounds[doc]] if len(doc) else 0)
    starts, ends = starts_of[first] + shift, starts_of[last] + lengths[last] + shift
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    return out, hashes


def majority(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per group of hashes the bits set in over half of them; an empty group gives 0."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    runs = [np.arange(bounds[i], bounds[i + 1], 255) for i in full]  # a byte lane counts to 255
    owner = np.cumsum([0] + [len(r) for r in runs])[:-1]
    cuts = np.concatenate(runs)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        totals = np.add.reduceat(lanes.astype(np.int64), owner, axis=0)
        over = (2 * totals > counts[full][:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= over[:, byte] << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the SimHash of each row's whole text as a signed long.

    Null, empty and blank texts have fingerprint 0; fewer than four words are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                fp = majority(*shingle_hashes(part.column("text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], ["id", "fp"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, fp long")


def settle(names: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merges the classes of linked positions; names[i] is the least position known in i's class."""
    while True:
        a, b = names[left], names[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        parent = np.arange(len(names))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        names[:] = parent[names]


def tile_links(fp: np.ndarray, radius: int = RADIUS, step: int = STEP, split_at: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a spanning forest of the links among ``fp``.

    ``split_at``: compare only positions below it with positions from it on (a pair of tiles).
    """
    if split_at is None and len(fp) <= 64:
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
        if not len(i):
            return i, j
    bits = np.bitwise_count(fp).astype(np.int16)
    names = np.arange(len(fp))
    halves = [np.arange(len(fp))] if split_at is None else [np.arange(split_at), np.arange(split_at, len(fp))]
    tiles = []
    for half in halves:
        half = half[np.argsort(bits[half], kind="stable")]
        tiles.append([half[k : k + step] for k in range(0, len(half), step)])
    for x, left in enumerate(tiles[0]):
        for right in tiles[0][x:] if split_at is None else tiles[1]:
            if bits[right[0]] - bits[left[-1]] > radius or bits[left[0]] - bits[right[-1]] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius)
            settle(names, left[i], right[j])
    found = np.flatnonzero(names != np.arange(len(fp)))
    return names[found], found


def _fields(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 disjoint fields that cover 64 bits."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1 if b - a < 64 else -1) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(reps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``reps(fp, id)``, one row a fingerprint -> edges (a, b) of ids whose closure is that of all links."""
    filed = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(m)).alias("value")) for k, (a, m) in enumerate(_fields(radius))]))
    rows = reps.select("fp", "id", filed.alias("f")).select("fp", "id", "f.field", "f.value", F.bit_count("fp").alias("bits"))
    # Per crowded field value the number of tiles of each population count: 65 entries at most.
    sizes = rows.groupBy("field", "value", "bits").count()
    crowded = sizes.groupBy("field", "value").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("bits", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")))).alias("plan")).where(F.col("n") > tile_rows).drop("n")
    dealt = rows.join(Table(crowded, "crowded").df, ["field", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("plan")[F.col("bits")]).cast("int")
    near = F.filter(F.map_entries("plan"), lambda e: F.abs(e["key"] - F.col("bits")) <= radius)
    tiles = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda s: F.struct(e["key"].alias("bits"), s.alias("sub")))))
    mine = F.struct(F.col("bits").alias("bits"), own.alias("sub"))
    pair = F.transform(tiles, lambda t: F.struct(F.least(t, mine).alias("lo"), F.greatest(t, mine).alias("hi")))
    whole = F.array(F.struct(*[F.struct(F.lit(-1).alias("bits"), F.lit(-1).alias("sub")).alias(x) for x in ("lo", "hi")]))
    keyed = dealt.select("fp", "id", "field", "value", "bits", F.coalesce(own, F.lit(-1)).alias("sub"), F.explode(F.when(F.col("plan").isNull(), whole).otherwise(pair)).alias("pair"))
    group = [F.col("field"), F.col("value"), F.col("pair")]
    two = F.col("pair.lo") != F.col("pair.hi")
    second = two & (F.col("pair.hi") == F.struct(F.col("bits"), F.col("sub")))
    keyed = keyed.select(F.xxhash64(*group).alias("key"), F.hash(*group).alias("check"), second.cast("int").alias("second"), two.alias("two"), "fp", "id")
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "second", "id")
    return dealt.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal keys; a run may cross batches and is held whole (two tiles at most)."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, check, second, two, fp, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            # Two groups whose keys collide are compared whole, which finds their links all the same.
            at = int(np.count_nonzero(second[lo:hi] == 0)) if two[lo] and (check[lo:hi] == check[lo]).all() else None
            i, j = tile_links(fp[lo:hi].view(np.uint64), radius, split_at=at)
            if len(i):
                a.append(ids[lo + i])
                b.append(ids[lo + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
        if held and (cut or held[-1][0][-1] != key[0]):
            if held[-1][0][-1] == key[0] or not cut:
                first = int(np.argmax(key != key[0])) if cut else 0
                held.append([c[:first] for c in columns])
                yield from flush(held)
                held, columns, cut = [], [c[first:] for c in columns], max(cut - first, 0)
            else:
                yield from flush(held)
                held = []
        if cut:
            yield from flush([[c[:cut] for c in columns]])
            columns = [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield from flush(held)


def simhash_components(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text, ...)``.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the
    smallest doc_id reachable.  Empty texts share fingerprint 0 and so link with each other, repeated
    doc_ids keep one row each, and a null doc_id is kept with the component of its fingerprint (null if
    no row of that class has an id).  An empty table gives no rows; other columns are ignored.
    """
    marked = Table(fingerprints(docs), "fingerprints").df
    reps = Table(marked.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "reps").df
    # A fingerprint is its own node, so that ids may have any value, repeat or be null.
    found = connected_components(links(reps.select("fp", F.col("fp").alias("id")), radius, tile_rows))
    classes = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", "n", F.coalesce("component", "fp").alias("class"))
    classes = Table(classes, "classes").df
    least = classes.groupBy("class").agg(F.min("id").alias("component_id"))
    classes = Table(classes.join(least, "class").select("fp", "n", "component_id"), "named").df
    out = join_keyed(marked, classes, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their own near-duplicate class, all columns as they are.

    Each row is judged by its text: of a repeated doc_id only the rows go whose class has a smaller
    one.  Rows without doc_id, and rows that repeat the smallest doc_id of a class, stay.  Null and
    empty texts are one class; an empty table gives an empty table.
    """
    numbered = Table(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered").df
    classes = simhash_components(numbered.select(F.col(ROW).alias("doc_id"), "text"), radius).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("class"))
    placed = Table(classes.join(numbered.select(ROW, F.col("doc_id").cast("long").alias("id")), ROW), "placed").df
    least = placed.groupBy("class").agg(F.min("id").alias("least"))
    gone = placed.join(Table(least, "least").df, "class").where(F.col("id") != F.col("least")).select(ROW)
    return numbered.join(Table(gone, "gone").df, ROW, "left_anti").select(docs.columns)
