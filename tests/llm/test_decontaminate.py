import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import decontaminate
from lumenframe.llm.decontaminate import contamination, drop_contaminated, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(doc, items):
    mine, hit, found = words(doc), set(), []
    for item_id, text in items:
        theirs = words(text)
        size = min(13, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        at = [i for i in range(len(mine) - size + 1) if size and tuple(mine[i : i + size]) in windows]
        hit |= {j for i in at for j in range(i, i + size)}
        if at:
            found.append(str(item_id))
    digest = hashlib.sha256(",".join(sorted(set(found))).encode()).hexdigest()
    return len(mine), len(hit), len(set(found)), digest, bool(hit) and 20 * len(hit) >= len(mine), hit


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)] + ["ÜBER", "naïve", "x9", "9", "中文"]
    say = lambda n: [vocab[i] for i in rng.integers(0, len(vocab), n)]
    items = [(i, " ".join(say(int(rng.integers(0, 40))))) for i in range(25)]
    items += [(90, None), (91, "..."), (92, "w1"), (93, "W1, w2"), (94, " ".join(["w3"] * 30)), (7, items[7][1]), (95, items[5][1])]
    docs = [None, "", " .. ", "w1", "w2 W1-w2", " ".join(["w3"] * 60), " ".join(["w3"] * 12)]
    for i in range(60):
        text = say(int(rng.integers(0, 90)))
        for _ in range(int(rng.integers(0, 3))):
            other = words(items[int(rng.integers(0, 25))][1])
            a = int(rng.integers(0, max(1, len(other))))
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = other[a : a + int(rng.integers(1, 30))]
        docs.append(rng.choice([" ", ", ", "\n"]).join(text))
    docs += [" ".join(say(5000) + words(items[3][1])), docs[9], docs[9]]
    rows = [(i, t, "clash") for i, t in enumerate(docs)]
    for bits in (1 << 27, 64):  # a filter that lets everything through must not change the result
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        got = contamination(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert len(got) == len(docs)
        for r in got:
            want = plain(docs[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[:5], r.doc_id
            assert {j for s in r.spans for j in range(s.lo, s.hi)} == want[5]


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    got = sorted(map(tuple, contamination(docs, items).select("doc_id", "n_hit", "n_items", "contaminated").collect()), key=str)
    assert got == [(1, 3, 0, True), (1, 3, 0, True), (2, 0, 0, False), (None, 3, 0, True)]
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, items).collect()) == ["2", "None"]
    assert contamination(docs.limit(0), items).collect() == []
    assert [r.n_hit for r in contamination(docs, items.limit(0)).collect()] == [0] * 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60), st.integers(1, 15))
def test_every_window_keeps_a_fingerprint(one, two, length):
    hashes = np.array(one + two, np.uint64)
    bounds = np.array([0, len(one), len(one) + len(two)])
    at, _ = winnow(hashes, bounds, length)
    k = min(5, length)
    for lo, hi in ((0, len(one)), (len(one), len(hashes))):
        for i in range(lo, hi - length + 1):
            assert any(i <= p and p + k <= i + length for p in at)


def test_rows_are_dropped_by_their_own_text(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "clean text"), (None, "a b c"), (None, "clean too"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    left = lambda **k: sorted(str(r.text) for r in drop_contaminated(docs, items, **k).collect())
    assert left() == ["None", "a b c", "clean text", "clean too"]
    assert left(keep_without_id=False) == ["None", "clean text", "clean too"]
