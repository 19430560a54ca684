import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import nearcopies
from lumenframe.llm.nearcopies import keep_one_of_each
from lumenframe.llm.simhash import ROW
from lumenframe.llm.storage import Table

SCHEMA = "doc_id long, text string, row string, key string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(texts, similar=0.8):
    """The class, named by its first text, of each text."""
    sets, names = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= similar * len(a | b):
                x, y = root(i), root(j)
                names[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_matches_brute_force_with_chains_and_groups(spark):
    rng = np.random.default_rng(4)
    say = lambda n: ["w%d" % x for x in rng.integers(0, 5000, n)]
    texts = ["", None, " \t ", "one", "ONE", "a b c", "a b c d e f"]
    for n in (40, 150, 600):
        for _ in range(6):
            words = say(n)
            for _ in range(8):  # each is a change of the one before it, so that classes are chains
                texts.append(" ".join(words))
                words = list(words)
                for at in rng.integers(0, n, rng.integers(1, 2 + n // 40)):
                    words[at] = say(1)[0]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sorted(set(plain(texts)))
    assert got == want and len(want) < len(texts) - 40


def test_stage_drops_copies_that_simhash_leaves(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    want = {ids[i] for i in plain([rows[i] for i in ids])}
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    one, other = shingles(rows[1]), shingles(rows[177])
    assert len(one & other) >= 0.8 * len(one | other) and 177 not in got


def test_rows_without_own_id(spark):
    rows = [(3, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (9, "v w x y z"), (None, "k l m n o"), (None, "k l m n o"), (None, "A b c d e"), (7, "q q"), (7, "q q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in keep_one_of_each(docs).collect())))
    assert got == sorted(map(str, [(3, "a b c d e"), (5, "v w x y z"), (None, "k l m n o"), (7, "q q")]))
    assert keep_one_of_each(docs.limit(0)).collect() == []


def test_colliding_counts_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PLACES", 512)
    rng = np.random.default_rng(8)
    say = lambda n: ["w%d" % x for x in rng.integers(0, 3000, n)]
    texts, shared = [], say(60)
    for _ in range(25):  # texts around one frequent passage, in pairs of near copies
        words = shared + say(20)
        texts += [" ".join(words), " ".join(words[:-2] + say(2)), " ".join(words[:-30] + say(30))]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.a * 1000 + r.b for r in nearcopies._rare_pairs(rows.select(F.col("row").alias("node"), F.col("row").alias("c")), rows, 0.8).collect()}
    sets = [shingles(t) for t in texts]
    want = {i * 1000 + j for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got
    levels = np.frombuffer(nearcopies._levels(rows), np.uint8)
    assert len(levels) == 512 and (levels > 0).any()
    assert nearcopies._levels(rows.limit(0)) == bytes(512)


def test_tiles_find_all_links_within_the_radius(monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE_ROWS", 40)
    monkeypatch.setattr(nearcopies, "LEAST_ROWS", 40)
    monkeypatch.setattr(nearcopies, "STEP", 16)
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**63, (300, nearcopies.WIDE)).astype(np.uint64)
    for i in range(100, 300):  # one to eighty bits of an earlier one are changed
        fp[i] = fp[rng.integers(0, i)]
        for bit in rng.integers(0, 64 * nearcopies.WIDE, rng.integers(1, 80)):
            fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    sizes = rng.integers(20, 60, 300)
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    first = np.bitwise_count(fp[:, None, :2] ^ fp[None, :, :2]).sum(axis=2)
    alike = np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes)
    links = np.triu(alike & (apart <= nearcopies.RADIUS) & (first <= nearcopies.FIRST), 1)
    counts = [(int(s), int(s), int(s), int((sizes == s).sum())) for s in np.unique(sizes)]
    places, pairs = nearcopies.tile_pairs(counts, 0.8)
    tile_of = {level: (at, subs) for level, at, subs in places}
    tile = np.array([tile_of[s][0] + i % tile_of[s][1] for i, s in enumerate(sizes)])
    names, degree = np.arange(300), np.zeros(300, int)
    for pair in {p for _, p, _ in pairs}:
        sides = {second: t for t, p, second in pairs if p == pair}
        at = np.flatnonzero(np.isin(tile, list(sides.values())))
        assert len(at) <= 80
        second = tile[at] == sides[True] if True in sides else np.zeros(len(at), bool)
        found, least, n = nearcopies.tile_forest(fp[at], sizes[at], second, 0.8)
        degree[at[found]] += n
        nearcopies.settle(names, at[least], at[found])
    want = np.arange(300)
    nearcopies.settle(want, *np.nonzero(links))
    assert links.sum() > 100 and (names == want).all() and (degree == (links + links.T).sum(axis=1)).all()


def test_candidates_come_from_fingerprints_alone(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k")], "row long, text string")
    assert {r["class"] for r in nearcopies.near_copy_classes(rows).collect()} == {1}
    monkeypatch.setattr(nearcopies, "RADIUS", 0)  # similar sets whose fingerprints aren't within the radius aren't compared
    assert {r["class"] for r in nearcopies.near_copy_classes(rows).collect()} == {1, 2}


def test_kept_rows_are_picked_without_moving_texts(spark):
    rows = spark.range(0, 20000, 1, 3).withColumn(ROW, F.monotonically_increasing_id())
    rows = Table(rows, "rows").df
    kept = Table(rows.where("id % 3 = 1 or id % 64 = 63").select(ROW), "kept").df
    found = nearcopies._only(rows, kept)
    assert sorted(r.id for r in found.collect()) == [i for i in range(20000) if i % 3 == 1 or i % 64 == 63]
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and nearcopies._only(rows, kept.limit(0)).count() == 0


def test_set_tiles_find_all_links_between_classes():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 10000, 100)
    sets = [np.unique(np.where(rng.random(100) < rng.uniform(0, 0.3), rng.integers(0, 10000, 100), base)).astype(np.uint64) for _ in range(90)]
    sets += [np.unique(rng.integers(10000, 10300, rng.integers(1, 9))).astype(np.uint64) for _ in range(40)]
    alike = np.array([[len(np.intersect1d(p, q)) >= 0.8 * len(np.union1d(p, q)) for q in sets] for p in sets])
    given = np.where(np.arange(len(sets)) % 9 == 0, 7, 100 + np.arange(len(sets)))
    for second in (np.zeros(len(sets), bool), rng.random(len(sets)) < 0.5):
        want = np.unique(given, return_index=True)[1][np.unique(given, return_inverse=True)[1]]
        got = want.copy()
        apart = len(set(want.tolist()))
        nearcopies.settle(want, *np.nonzero(alike & (second[:, None] < second if second.any() else True)))
        i, j = nearcopies.set_forest(sets, given, second, 0.8)
        nearcopies.settle(got, i, j)
        assert (got == want).all() and len(i) == apart - len(set(want.tolist())) > 10


def test_near_copies_apart_from_their_hub_are_not_expanded_into_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SET_ROWS", 16)
    rng = np.random.default_rng(9)
    say = lambda n: ["w%d" % x for x in rng.integers(0, 5000, n)]
    base, texts = say(200), []
    for k in range(60):  # near copies of a text that isn't there, each with its own change
        texts.append(" ".join(base[: 3 * k] + say(1) + base[3 * k + 1 :]))
    for k in range(3):  # and texts on the way away from it
        words = list(base)
        for at in range(6 + k, 200, 11):
            words[at] = say(1)[0]
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    left = rows.select(F.col("row").alias("node"), F.lit(0).cast("long").alias("component"), F.col("row").alias("c"))
    compared, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, *more: compared.append(pairs.distinct().count()) or similar(pairs, *more))
    sketches = nearcopies._sketches(rows).select(F.col("row").alias("node"), "size", "fp")
    links = [(r.a, r.b) for r in nearcopies._left_links(left, sketches, rows, 0.8).collect()]
    names, want = np.arange(len(texts)), plain(texts)
    nearcopies.settle(names, *np.array(links).T)
    assert names.tolist() == want and want[:60] == [0] * 60 and len(set(want)) == 4
    assert compared[0] <= 4 * len(texts) and len(links) <= 4 * len(texts)
    # All their pairs meet in the filter, which is what was compared before.
    assert nearcopies._rare_pairs(left.select("node", "c"), rows, 0.8).distinct().count() > 60 * 59 / 4
