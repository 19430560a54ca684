import re

import numpy as np
import pytest
import xxhash

from lumenframe.llm.simhash import keep_one, links, simhash_components

SCHEMA = "doc_id long, text string, id string, fp string"


def plain(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in data))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(ids, fps, radius=4):
    names = dict(zip(ids, ids, strict=True))

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                x, y = root(a), root(ids[j])
                names[max(x, y)] = min(x, y)
    return {a: root(a) for a in ids}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = ["w%d" % x for x in rng.integers(0, 900, 700)]
    texts = ["", None, " \t\n ", "one", "One", "a b c", "x\x0by\x1cz Ärger ärger"]
    for k in range(30):
        words = list(base)
        words[10 * k] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join("v%d" % x for x in rng.integers(0, 50, 40)) for _ in range(40)] + texts[8:12]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [plain(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert all(len(got[i].fingerprint) == 16 for i in got)
    assert {i: got[i].component_id for i in got} == classes(list(range(len(texts))), fps)


@pytest.mark.parametrize("tile_rows", [8, 16384])
def test_crowded_fields_are_dealt_out_without_losing_links(spark, tile_rows):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    fps = {centre} | {centre ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 7))) for _ in range(150)}
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**63, 100)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    from lumenframe.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(links(rows, 4, tile_rows)).collect()}
    want = {k: v for k, v in classes(list(range(len(fps))), fps).items()}
    assert {k: found.get(k, k) for k in want} == want


def test_other_radii(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("w%d" % x for x in rng.integers(0, 9, 6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    fps = [plain(t) for t in texts * 2]
    for radius in (0, 9):
        got = {r.doc_id: r.component_id for r in simhash_components(docs, radius).collect()}
        assert got == classes(list(range(120)), fps, radius)


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(5, "a b c d e", "", ""), (5, "a b c d e", "", ""), (None, "a b c d e", "", ""), (None, "q r s t u v", "", ""), (7, "z z", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_components(docs).collect())
    assert got == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in keep_one(docs).collect()) == ["5", "5", "7", "None", "None"]
    assert simhash_components(docs.limit(0)).collect() == []


def test_a_repeated_id_is_judged_by_each_text(spark):
    rows = [(3, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (9, "v w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs).collect())) == [rows[0], rows[2]]


def test_ids_of_any_size(spark):
    rows = [(2**62 + 5, "a b c d e"), (2**63 - 1, "a b c d e"), (-7, "v w x y z"), (2**62, "v w x y z"), (None, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash_components(docs).collect()}
    assert got == {(2**62 + 5, 2**62 + 5), (2**63 - 1, 2**62 + 5), (-7, -7), (2**62, -7), (None, 2**62 + 5)}
    assert sorted(str(r.doc_id) for r in keep_one(docs).collect()) == sorted(map(str, [2**62 + 5, -7, None]))
