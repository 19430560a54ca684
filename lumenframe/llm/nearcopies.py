"""SimHash near-dedup at a shingle similarity: fingerprints of five-word shingle sets compared in tiles within a wide radius, then the sets.

Sets of similarity 0.8 or more have fingerprints that differ in 15 % of their bits (16 % at most for sets of
six or more, 19 % for sets of five and four).  With WIDE 64-bit words, RADIUS leaves out such a pair with a
probability of about 1e-7 for sets of five and four and 1e-11 for others, FIRST (the bound for the first two
words, which are compared before the others) with 3e-8 and 1e-10.  No bit field is long enough to file
fingerprints under at that radius, so the fingerprints of all different sets are compared: sorted by set
size and population count, cut into tiles and blocks, and compared by exclusive-or and bit counts unless
sizes say that two blocks can't hold a similar pair (a set of less than 0.8 times the size never is) or
population counts differ by more than the radius.  Tile pairs are dealt out as tasks; a task emits a spanning
forest of its links and how many each fingerprint has, never all pairs.  Work grows with the square of the
number of fingerprints of about one size.

The exact check follows inside the classes that these links connect.  Of a class of up to SMALL sets all
pairs within the radius are compared as sets; of a larger one all members with its hub, the one with most
links and so the likeliest middle of a group, so that a group of near copies around a common text costs a
pair a member.  What links remain can only be between members of larger classes that still fall apart.
Of those texts the rarest shingles are filed: of two sets of
n shingles or fewer whose similarity is 0.8 or more, some shingle is among the rarest fifth of both, and
the first such one so early that enough others can follow (the prefix and positional filters of set
joins, which are exact in any order that all sets share); so texts that share a frequent passage alone
don't meet.  Shingles are ordered by counts in PLACES hashed places, a bounded table that every task holds,
so a text finds its own fifth and no other shingle travels.  Collisions make a rare shingle look frequent,
never a frequent one rare: they cost candidates and lose none.  A shingle that up to SMALL texts file gives
their pairs.  Those that file one together with more are compared as sets in tiles, as the fingerprints are:
a set travels once a tile of its class and a task emits a spanning forest, so that near copies whose hub
isn't in their middle, or went in an earlier stage, never become all their pairs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import ROW, majority, settle, shingle_hashes
from .storage import Table, join_keyed
from .words import blocks, map_texts, mix

SHINGLE = 5
SIMILAR = 0.8
WIDE = 8
RADIUS = 144
FIRST = 50
#: Rows of a tile at most and at least, how many tiles there should be, and rows of a block inside one.
TILE_ROWS, LEAST_ROWS, TILES = 32768, 2048, 12
STEP = 512
SMALL = 8
#: Places that shingles are counted in, and the parts those counts travel in.
PLACES = 1 << 24
PARTS = 256
#: Sets of a tile at least and at most, how many tiles a class should have, and shingles of a tile together.
SET_ROWS, SET_MOST, SET_TILES, SET_SHINGLES = 128, 2048, 16, 1 << 21
#: Bits of the filter of rows whose texts are asked for.
ASKED_BITS = 1 << 27
_SEEDS = mix(np.arange(1, WIDE + 1, dtype=np.uint64))


def _sketches(rows: DataFrame) -> DataFrame:
    """(row, digest and size of the text's set of shingles, its wide SimHash) of ``rows(row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = _sets(part.column("text"))
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                sizes = np.array([len(x) for x in sets], np.int64)
                bounds, hashes = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(sets)
                wide = np.stack([majority(bounds, hashes if k == 0 else mix(hashes ^ _SEEDS[k])) for k in range(WIDE)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(digests, pa.binary()), pa.array(sizes), _listed(wide)], ["row", "digest", "size", "fp"])

    return map_texts(rows, run, "row long, digest binary, size long, fp array<long>")


def _listed(wide: np.ndarray) -> pa.Array:
    """Rows of WIDE words as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, wide.size + 1, WIDE, dtype=np.int32)), pa.array(wide.reshape(-1).view(np.int64)))


def tile_pairs(counts: list[tuple[int, int, int, int]], similar: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bool]]]:
    """Tiles of rows of similar set sizes, from (level, least size, largest size, number of rows) of ascending levels.

    Returns (level, its first tile, among how many tiles its rows are dealt) and (tile, pair, whether it is
    the second of that pair) of all pairs of tiles that may hold a similar pair, each tile with itself included.
    """
    most = min(TILE_ROWS, max(LEAST_ROWS, -(-sum(n for *_, n in counts) // TILES)))
    places, spans, held = [], [], most + 1
    for level, low, high, n in counts:
        subs = max(1, -(-n // most))
        if subs == 1 and held + n <= most:
            spans[-1], held = (spans[-1][0], high), held + n
        else:
            spans += [(low, high)] * subs
            held = n if subs == 1 else most + 1
        places.append((level, len(spans) - subs, subs))
    out = []
    for i, (_, high) in enumerate(spans):
        for j in range(i, len(spans)):
            if high < similar * spans[j][0]:
                break
            out += [(i, len(out), False)] + [(j, len(out), True)] * (i < j)
    return places, out


def tile_forest(fp: np.ndarray, sizes: np.ndarray, second: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, least, degree): positions with links, the position that names each one's class, its number of links.

    Linked are rows of ``fp`` within RADIUS bits whose sets have similar ``sizes``; where ``second`` holds for
    some rows, only those are compared with the others.
    """
    bits = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    halves = [np.flatnonzero(~second), np.flatnonzero(second)] if second.any() else [np.arange(len(fp))]
    tiles = []
    for half in halves:
        half = half[np.lexsort((bits[half], sizes[half]))]
        tiles.append([half[k : k + STEP] for k in range(0, len(half), STEP)])
    columns, room = np.ascontiguousarray(fp.T), np.empty(STEP * STEP, np.uint64)
    names, degree = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    ranges = {int(t[0]): (sizes[t[0]], sizes[t[-1]], bits[t].min(), bits[t].max()) for tile in tiles for t in tile}
    for x, left in enumerate(tiles[0]):
        least, most, few, many = ranges[int(left[0])]
        near = columns[:, left]
        for y, right in enumerate(tiles[0][x:] if len(tiles) == 1 else tiles[1]):
            low, high, fewer, more = ranges[int(right[0])]
            if most < similar * low or high < similar * least or fewer - many > RADIUS or few - more > RADIUS:
                continue
            far = columns[:, right]
            part = room[: len(left) * len(right)].reshape(len(left), len(right))
            apart = np.bitwise_count(np.bitwise_xor(near[0][:, None], far[0], out=part))
            apart += np.bitwise_count(np.bitwise_xor(near[1][:, None], far[1], out=part))
            i, j = np.divmod(np.flatnonzero(apart <= FIRST), len(right))
            if len(tiles) == 1 and not y:
                i, j = i[i < j], j[i < j]
            p, q = sizes[left[i]], sizes[right[j]]
            alike = np.minimum(p, q) >= similar * np.maximum(p, q)
            i, j = i[alike], j[alike]
            close = np.bitwise_count(near[:, i] ^ far[:, j]).sum(axis=0, dtype=np.int64) <= RADIUS
            i, j = left[i[close]], right[j[close]]
            if len(i):
                degree += np.bincount(np.concatenate((i, j)), minlength=len(fp))
                settle(names, i, j)
    found = np.flatnonzero(degree)
    return found, names[found], degree[found]


def _links(reps: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) among ``reps(node, size, fp)`` whose closure is that of all fingerprints within RADIUS.

    b is each linked node once a tile pair, with its number ``n`` of links there, its size and fingerprint.
    """
    spark = reps.sparkSession
    # Texts without words are one node. A level is a hundredth of the powers of two, so there are some thousands at most.
    reps = reps.where("size > 0").withColumn("level", F.floor(F.log2("size") * 100).cast("int"))
    counts = reps.groupBy("level").agg(F.min("size"), F.max("size"), F.count("*")).collect()
    places, pairs = tile_pairs(sorted(tuple(r) for r in counts), similar)
    placed = reps.join(F.broadcast(spark.createDataFrame(places, "level int, first int, subs int")), "level")
    placed = placed.select("node", "size", "fp", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("subs"))).cast("int").alias("tile"))
    dealt = placed.join(F.broadcast(spark.createDataFrame(pairs, "tile int, pair int, second boolean")), "tile").drop("tile")

    def compare(group: pa.Table) -> pa.Table:
        fp = group["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
        node, size = group["node"].to_numpy(), group["size"].to_numpy()
        found, least, degree = tile_forest(fp, size, group["second"].to_numpy(), similar)
        return pa.table({"a": node[least], "b": node[found], "n": degree, "size": size[found], "fp": _listed(fp[found])})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "pair").groupBy("pair").applyInArrow(compare, "a long, b long, n long, size long, fp array<long>")


def _asked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` without most of those that aren't in ``asked(row)``, so that their texts needn't travel for a join.

    A bit filter of ASKED_BITS, gathered in parts: it keeps every asked row, and some others the more rows are asked.
    """
    place = F.xxhash64("row").bitwiseAND(F.lit(ASKED_BITS - 1))
    words = asked.select(place.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).withColumn("part", F.shiftright("word", 13))

    def pack(group: pa.Table) -> pa.Table:
        held = np.zeros(1 << 13, np.int64)
        held[group["word"].to_numpy() & 8191] = group["bit"].to_numpy()
        return pa.table({"part": group["part"].slice(0, 1), "held": pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())})

    held = dict(words.groupBy("part").applyInArrow(pack, "part long, held binary").collect())
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(ASKED_BITS >> 6, np.uint64)
        for part, packed in sent.value.items():
            bits[part << 13 : (part + 1) << 13] = np.frombuffer(zlib.decompress(packed), np.uint64)
        for batch in batches:
            at = batch.column("place").to_numpy().astype(np.uint64)
            kept = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            yield batch.select(["row", "text"]).filter(pa.array(kept))

    return map_texts(rows.select("row", "text", place.alias("place")), run, "row long, text string")


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    bounds, hashes = shingle_hashes(texts, SHINGLE)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _shingle_sets(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The long ``columns`` of ``rows``, the first being the text's row, and as ``name`` its sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                # A text that several rows ask for is read once a block.
                _, first, of = np.unique(part.column(columns[0]).to_numpy(), return_index=True, return_inverse=True)
                sets = pa.array([x.tobytes() for x in _sets(part.column("text").take(pa.array(first)))], pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [sets.take(pa.array(of)).cast(pa.binary())], [*columns, name])

    return map_texts(rows.select(*columns, "text"), run, ", ".join(f"{c} long" for c in columns) + f", {name} binary")


def _levels(texts: DataFrame) -> bytes:
    """For each of PLACES hashed places a level that rises with how many (set, shingle) pairs of ``texts(text)`` fall there.

    Level 0 means one at most.  A task adds up its own, so what travels is a compressed array a task,
    and the driver gets PLACES bytes, whatever the input's size.
    """
    span = PLACES // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(PLACES, np.uint16)
        for batch in batches:
            for part in blocks(batch):
                places, n = np.unique(np.concatenate(_sets(part.column("text"))) & np.uint64(PLACES - 1), return_counts=True)
                held[places] = np.minimum(held[places] + n, 65535)
        used = [k for k in range(PARTS) if held[k * span : (k + 1) * span].any()]
        packed = [zlib.compress(held[k * span : (k + 1) * span].tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["part", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("held").to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(span, np.int64))
                sums[part] += np.frombuffer(zlib.decompress(held), np.uint16)
        levels = [np.minimum(8 * np.log2(np.maximum(x, 1)), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    counted = map_texts(texts.select("text"), count, "part int, held binary")
    out = bytearray(PLACES)
    for part, levels in counted.repartition("part").mapInArrow(add, "part int, levels binary").collect():
        out[part * span : (part + 1) * span] = levels
    return bytes(out)


def _filed(texts: DataFrame, similar: float) -> Table:
    """(node, c, size of its set, a shingle hash, its place) of ``texts(node, c, text)`` for the shingles that come first.

    A set's shingles are ordered by level and hash; those that no other set has come first, take places and aren't filed.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_levels(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for part in blocks(batch):
                sets = _sets(part.column("text"))
                sizes = np.array([len(x) for x in sets], np.int64)
                found, places = [], []
                for x in sets:
                    level = levels[x & np.uint64(PLACES - 1)]
                    first = np.argsort(level, kind="stable")[: len(x) - math.ceil(len(x) * similar - 1e-9) + 1]
                    mine = np.flatnonzero(level[first])
                    found.append(x[first[mine]])
                    places.append(mine + 1)
                n = np.array([len(x) for x in found], np.int64)
                columns = [np.repeat(part.column(c).to_numpy(), n) for c in ("node", "c")]
                columns += [np.repeat(sizes, n), np.concatenate(found).view(np.int64), np.concatenate(places).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "c", "size", "shingle", "place"])

    filed = Table(map_texts(texts.select("node", "c", "text"), run, "node long, c long, size long, shingle long, place long"), "rare")
    sent.unpersist()
    return filed


def _similar(pairs: DataFrame, sketches: DataFrame, rows: DataFrame, similar: float) -> Table:
    """Those of ``pairs(a, b)`` whose sets of shingles have at least this Jaccard similarity.

    ``sketches(node, size, fp)`` rule out most others: by sizes for sure, by RADIUS as above.
    """
    pairs = pairs.distinct()
    one, other = (sketches.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("fp").alias(f"fp_{n}")) for n in "ab")
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = F.least("size_a", "size_b") >= similar * F.greatest("size_a", "size_b")
    pairs = Table(pairs.join(one, "a").join(other, "b").where(alike & (apart <= RADIUS)).select("a", "b"), "near").df
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
                least, most = sorted((len(p), len(q)))
                both = len(np.intersect1d(p, q, assume_unique=True)) if least >= similar * most else 0
                keep.append(both >= similar * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A text that isn't a hub goes to its hubs, and only there.
    texts = Table(_asked(rows, pairs.select(F.explode(F.array("a", "b")).alias("row"))), "asked").df
    y = _shingle_sets(texts.join(pairs, F.col("row") == F.col("b")), ["b", "a"], "y")
    x = _shingle_sets(texts.join(pairs.select("a").distinct(), F.col("row") == F.col("a")), ["a"], "x")
    return Table(map_texts(y.join(x, "a").select("a", "b", "x", "y"), run, "a long, b long"), "similar")


def set_forest(sets: list[np.ndarray], classes: np.ndarray, second: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of links between different ``classes`` of ``sets``, a spanning forest of all such links.

    Linked are sets with at least this Jaccard similarity; where ``second`` holds for some, only those are
    compared with the others.
    """
    two = bool(second.any())
    sizes = np.array([len(x) for x in sets], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # For each shingle the sets that have it, one after the other.
    order = np.argsort(ids, kind="stable")
    order = order[second[owner[order]]] if two else order
    having, cuts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(ids[order], minlength=ids.max(initial=-1) + 1))))
    _, first, of = np.unique(classes, return_index=True, return_inverse=True)
    names = first[of]
    left, right = [], []
    for x in np.flatnonzero(~second) if two else range(len(sets)):
        mine = ids[bounds[x] : bounds[x + 1]]
        runs = [having[a:b] for a, b in zip(cuts[mine].tolist(), cuts[mine + 1].tolist(), strict=True) if b - a > (not two)]
        if not runs:
            continue
        both = np.bincount(np.concatenate(runs), minlength=len(sets))
        y = np.flatnonzero((both > 0) & (names != names[x]))
        y = y[both[y] >= similar * (sizes[x] + sizes[y] - both[y])]
        if len(y):
            y = y[np.unique(names[y], return_index=True)[1]]
            left.append(np.full(len(y), x))
            right.append(y)
            settle(names, left[-1], y)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _set_links(texts: DataFrame, similar: float) -> Table:
    """Links (a, b) among ``texts(node, component, c, text)`` whose closure with the classes c is that of all similar sets of a component."""
    spark = texts.sparkSession
    sets = Table(_shingle_sets(texts, ["node", "component", "c"], "held"), "sets").df
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"), (F.sum(F.octet_length("held")) / 8).alias("all"))
    rows = F.greatest(F.least(F.ceil(F.col("n") / SET_ROWS), F.lit(SET_TILES)), F.ceil(F.col("n") / SET_MOST), F.ceil(F.col("all") / SET_SHINGLES))
    # A class of several tiles has SET_ROWS sets or SET_SHINGLES shingles and more, so these are few.
    tiles = Table(sizes.select("component", F.least(rows, F.col("n")).cast("int").alias("tiles")).where("tiles > 1"), "tiles").df
    placed = sets.join(F.broadcast(tiles), "component", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "node", "c", "held")

    def compare(group: pa.Table) -> pa.Table:
        held = [np.frombuffer(v.as_buffer(), np.uint64) for v in group["held"]]
        node, second = group["node"].to_numpy(), group["second"].to_numpy()
        # Of two tiles one may be empty; the other is compared with itself elsewhere.
        alone = group["lo"][0].as_py() != group["hi"][0].as_py() and (second.all() or not second.any())
        i, j = (np.zeros(0, np.int64),) * 2 if alone else set_forest(held, group["c"].to_numpy(), second, similar)
        return pa.table({"a": node[i], "b": node[j]})

    keys = ["component", "lo", "hi"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Table(dealt.repartition(n, *keys).groupBy(*keys).applyInArrow(compare, "a long, b long"), "alike")


def _left_links(left: DataFrame, sketches: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) among ``left(node, component, c)`` whose closure with the classes c is that of all similar sets of a component."""
    texts = _asked(rows, left.select(F.col("node").alias("row"))).join(left, F.col("row") == F.col("node"))
    texts = Table(texts.select("node", "component", "c", "text"), "texts").df
    filed = _filed(texts, similar).df
    met = filed.groupBy("shingle").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    met = Table(met.select("shingle", "n"), "met").df
    few = filed.join(met.where(F.col("n") <= SMALL), "shingle", "left_semi")
    crowded = Table(filed.join(met.where(F.col("n") > SMALL), "shingle", "left_semi").select("node").distinct(), "crowded").df
    pairs = _similar(_rare_pairs(left, rows, similar, few), sketches, rows, similar).df
    return pairs.unionByName(_set_links(texts.join(crowded, "node", "left_semi"), similar).df)


def _rare_pairs(nodes: DataFrame, rows: DataFrame, similar: float, filed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, c)`` of different classes c, among them all whose sets are ``similar``.

    Given what is ``filed`` of them, only pairs that meet there.
    """
    if filed is None:
        texts = _asked(rows, nodes.select(F.col("node").alias("row"))).join(nodes, F.col("row") == F.col("node"))
        filed = _filed(Table(texts.select("node", "c", "text"), "texts").df, similar).df
    other = filed.select("shingle", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("c").alias("c_b"))
    # Of a pair's common shingles the first has the widest bound, so a similar pair passes by it.
    follow = 1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    enough = follow >= F.ceil((F.col("size") + F.col("size_b")) * (similar / (1 + similar)) - 1e-9)
    return filed.join(other, "shingle").where((F.col("node") < F.col("b")) & (F.col("c") != F.col("c_b")) & enough).select(F.col("node").alias("a"), "b")


def near_copy_classes(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(row, class) of ``rows(row, text)`` with distinct longs as rows: class is the least row of texts that links connect.

    Rows whose sets of five-word shingles (A-Z lowered; fewer words are one shingle) have a Jaccard
    similarity of at least ``similar`` are linked; texts without words link with each other.
    """
    marks = Table(_sketches(rows), "sketches").df
    reps = marks.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("n"))
    reps = Table(reps, "reps").df
    chosen = marks.select(F.col("row").alias("node"), "size", "fp").join(reps.select("node"), "node", "left_semi")
    links = Table(_links(Table(chosen, "chosen").df, similar), "links").df
    groups = Table(connected_components(links.select("a", "b")), "groups").df
    ends = links.groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("degree"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    met = Table(ends.join(groups, "node"), "met").df
    sketches = met.select("node", "size", "fp")
    # Of each group its hub and how many it has.
    hubs = met.groupBy("component").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"), F.count("*").alias("of"))
    named = Table(met.select("node", "component").join(hubs, "component"), "named").df
    small = named.where(F.col("of") <= SMALL)
    pairs = small.select("component", F.col("node").alias("a")).join(small.select("component", F.col("node").alias("b")), "component").where("a < b").select("a", "b")
    pairs = pairs.unionByName(named.where((F.col("of") > SMALL) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    first = _similar(pairs, sketches, rows, similar).df
    found = connected_components(first).withColumnRenamed("component", "c")
    large = named.where(F.col("of") > SMALL).join(found, "node", "left")
    large = Table(large.select("node", "component", F.coalesce("c", "node").alias("c")), "large").df
    mixed = large.groupBy("component").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("component")
    left = Table(large.join(mixed, "component", "left_semi"), "left").df
    second = _left_links(left, sketches, rows, similar)
    classes = Table(connected_components(first.unionByName(second)), "classes").df
    of_rep = Table(reps.join(classes, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("class")), "classes").df
    return join_keyed(marks.select("row", "digest"), of_rep, "digest").select("row", "class")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ``rows`` whose ROW is in ``kept(ROW)``, by a bit a row that every task holds, so that rows needn't travel."""
    bit = F.expr(f"shiftleft(1L, cast({ROW} & 63 as int))")
    words = kept.groupBy(F.shiftright(ROW, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    listed = F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).cast("int").alias("at"), "bits")))
    maps = Table(words.groupBy(F.shiftright("word", 6).alias(f"{ROW}_part")).agg(listed.alias(f"{ROW}_bits")), "maps").df
    marked = rows.join(F.broadcast(maps), F.shiftright(ROW, 12) == F.col(f"{ROW}_part"))
    return marked.where(F.expr(f"getbit({ROW}_bits[cast(shiftright({ROW}, 6) % 64 as int)], cast({ROW} & 63 as int)) = 1")).select(rows.columns)


def keep_one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id, all columns as they are.

    Of rows with the same doc_id, or of a class in which none has one, the first one read stays.
    Null, empty and wordless texts are one class; an empty table gives an empty table; other columns may
    have any name.
    """
    numbered = Table(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered").df
    classes = Table(near_copy_classes(numbered.select(F.col(ROW).alias("row"), "text"), similar), "classes").df
    ids = numbered.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"]
    kept = classes.join(ids, "row").groupBy("class").agg(first.alias(ROW)).select(ROW)
    return _only(numbered, Table(kept, "kept").df).select(docs.columns)
