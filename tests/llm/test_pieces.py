import math
import time
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import pieces
from lumenframe.llm.pieces import PieceLattice, decode_pieces, encode_pieces, piece_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LATTICE = PieceLattice(MODEL)
PLAIN = sentencepiece.SentencePieceProcessor(model_file=MODEL)
WEIGHT = {LATTICE.raw[a : a + n].tobytes(): w for i, w in zip(LATTICE.ids, LATTICE.weights, strict=True) for a, n in [(LATTICE.raw_start[i], LATTICE.raw_size[i])]}
NUMBER = {LATTICE.raw[LATTICE.raw_start[i] : LATTICE.raw_start[i] + LATTICE.raw_size[i]].tobytes(): int(i) for i in LATTICE.ids}
ODD = [None, "", " ", "  lead and  trail  ", "▁ literal ▁▁", "\n\ttabs\r\n", "<0x41> <s> </s>", "中文字 𝄞 é é", "x" * 30_000, "�\x00​"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.sampled_from(ODD)), max_size=6), st.integers(0, 2**62))
def test_decoding_is_lossless_and_draws_depend_on_the_row_alone(texts, key):
    column, keys = pa.array(texts, pa.string()), np.arange(key, key + len(texts), dtype=np.uint64)
    ids, counts = LATTICE.sample(column, keys)
    assert LATTICE.decode(ids, counts) == [t or "" for t in texts]
    at = 0
    for i, n in enumerate(counts.tolist()):
        alone, _ = LATTICE.sample(column.slice(i, 1), keys[i : i + 1])
        assert alone.tolist() == ids[at : at + n].tolist()
        at += n


def plain_sample(text, key, seed=2024):
    """Forward filtering and backward sampling of one text, a position and a piece at a time."""
    if not text:
        return []

    def scramble(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    data, stream = (" " + text).encode(), scramble(key ^ seed)
    cuts = [0] + [i for i in range(1, len(data)) if data[i] == 32 and data[i - 1] != 32] + [len(data)]
    byte_weight, out = min(WEIGHT.values()), []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        edges = {i: [] for i in range(lo, hi + 1)}  # (begin, piece id, weight) of what may come last, shortest first
        for i in range(lo, hi):
            if data[i] & 0xC0 == 0x80:
                continue
            size = next((n for n in range(1, 5) if i + n >= hi or data[i + n] & 0xC0 != 0x80), 1)
            for j in range(i + 1, min(hi, i + LATTICE.longest) + 1):
                if data[i:j] in WEIGHT:
                    edges[j].append((i, NUMBER[data[i:j]], WEIGHT[data[i:j]]))
            if data[i : i + size] not in WEIGHT:
                for j in range(i, i + size):
                    edges[j + 1].append((j, int(LATTICE.byte_id[data[j]]), byte_weight))
        total, choice = {lo: 0.0}, {}
        for j in range(lo + 1, hi + 1):
            last = sorted(edges[j], key=lambda e: -e[0])
            if not last:
                continue
            w = [e[2] + total[e[0]] for e in last]
            top = max(w)
            total[j] = top + math.log(sum(math.exp(x - top) for x in w))
            u = (scramble((stream + j * 0x9E3779B97F4A7C15) % 2**64) >> 11) * 2.0**-53
            for e, x in zip(last, w, strict=True):
                choice[j] = e
                p = float(np.float32(math.exp(x - total[j])))
                if u < p:
                    break
                u -= p
        path, j = [], hi
        while j > lo:
            path.append(choice[j][1])
            j = choice[j][0]
        out += path[::-1]
    return out


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \u2581é中", max_size=200), st.sampled_from([x for x in ODD if x and len(x) < 100])), st.integers(0, 2**62))
def test_matches_plain_sampling(text, key):
    ids, _ = LATTICE.sample(pa.array([text]), np.array([key], np.uint64))
    assert ids.tolist() == plain_sample(text, key)


def test_long_segments_get_the_same_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["x" * 5000, "中文字é𝄞" * 900, "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 3000)), "".join(rng.choice(list("abcdeinrst.,=/"), 6000)), "the" * 2000 + "▁" + "é" * 40]
    want = [plain_sample(t, 7) for t in texts]
    for part, span in ((256 << 10, 512), (1000, 64)):
        monkeypatch.setattr(pieces, "PART", part)
        monkeypatch.setattr(pieces, "SPAN", span)
        ids, counts = LATTICE.sample(pa.array(texts), np.full(len(texts), 7, np.uint64))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    monkeypatch.setattr(pieces, "LONG", 1 << 30)
    ids, counts = LATTICE.sample(pa.array(texts), np.full(len(texts), 7, np.uint64))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_ten_megabytes_without_a_space():
    rng = np.random.default_rng(9)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3_500_000)))
    began = time.perf_counter()
    ids, counts = LATTICE.sample(pa.array([text]), np.ones(1, np.uint64))
    assert LATTICE.decode(ids, counts) == [text] and time.perf_counter() - began < 120


def test_library_decodes_the_same():
    texts = ["The quick brown fox", "Größe über  alles", "naïve café\n中文"]
    ids, counts = LATTICE.sample(pa.array(texts), np.arange(3, dtype=np.uint64))
    assert [PLAIN.decode(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])] == texts


def test_samples_follow_the_lattice_distribution():
    word = b" banana"

    @cache
    def ways(at):
        if at == len(word):
            return {(): 0.0}
        out = {}
        for n in range(1, len(word) - at + 1):
            if (piece := word[at : at + n]) in WEIGHT:
                out |= {(piece, *rest): w + WEIGHT[piece] for rest, w in ways(at + n).items()}
        return out

    weights = {k: math.exp(v) for k, v in ways(0).items()}
    total = sum(weights.values())
    n = 20_000
    ids, counts = LATTICE.sample(pa.array(["banana"] * n), np.arange(n, dtype=np.uint64))
    spell = {i: LATTICE.raw[LATTICE.raw_start[i] : LATTICE.raw_start[i] + LATTICE.raw_size[i]].tobytes() for i in set(ids.tolist())}
    seen = Counter(tuple(spell[i] for i in x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(weights)
    for k, w in weights.items():
        p = w / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_tables_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", ""), (3, ODD[3], ""), (3, ODD[3], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode_pieces(docs, MODEL)
    got = sorted(map(tuple, decode_pieces(encoded, MODEL).collect()), key=str)
    assert got == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert len({tuple(r.ids) for r in encoded.collect() if r.doc_id == 3}) == 1
    digests = piece_digests(docs, MODEL).collect()
    assert len(digests) == len(rows) and all(r.lossless for r in digests)
    sizes = {r.doc_id: len(r.ids) for r in encoded.collect()}
    assert all(r.n_pieces == sizes[r.doc_id] for r in digests)
    assert piece_digests(docs.limit(0), MODEL).collect() == []
