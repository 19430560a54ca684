import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenframe.llm import langid, quality, toxicity

ODD = [None, "", " \n ", "...", "12 34", "x" * 200_000, "Ωμέγα 中文", "word " * 4000]


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = rows_of(spark, sf_dir.replace("0.001", "0.01"), "documents"), rows_of(spark, sf_dir.replace("0.001", "0.01"), "labels")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in test]) > 0.95
    assert np.mean([a for a, b in test if b == 1]) > 0.98  # clean documents stay


def test_toxicity_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = rows_of(spark, big, "documents"), rows_of(spark, big, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a for a, b in test if b == 1]) > 0.7 and np.mean([a for a, b in test if b == 0]) < 0.01


def test_language_on_held_out_rows(spark, sf_dir):
    docs = rows_of(spark, sf_dir.replace("0.001", "0.01"), "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.language(docs).collect()
    assert len(got) == len(truth)
    test = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert test and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in test)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.95


def test_toxicity_with_stems_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = rows_of(spark, big, "documents"), rows_of(spark, big, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, stems=(4, 5, 6)).collect()}
    test = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a for a, b in test if b == 1]) > 0.85 and np.mean([a for a, b in test if b == 0]) < 0.01


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_texts_and_no_labels(spark, run):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, "a b", 0.5), (1, "", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = run(docs, labels).collect()
    assert len(got) == len(ODD) + 2 and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(3, 1, 1), (4, None, None), (4, 7, 7), (7, 0, 0), (None, 1, 1), (99, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = run(docs, some).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert run(docs.limit(0), some).collect() == []


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(ODD * 3)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.language(docs).collect()}
    assert len(got) == 3 * len(ODD)
    for i, t in enumerate(ODD * 3):
        letters = bool(t and any(c.isalpha() for c in t))
        assert got[i].lang_pred == ("en" if letters else "und") and 0 <= got[i].score <= 1
    nothing = langid.language(docs.withColumn("lang", docs.lang.substr(9, 0)).where("lang is null")).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in nothing)
    assert langid.language(docs.limit(0)).collect() == []


def test_network_gradient_is_that_of_its_loss():
    rng = np.random.default_rng(0)
    model = langid.ByteGRU.fresh(["a", "b", "c"])
    rows, y = rng.integers(0, 256, (6, 64)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    real = np.array([64, 3, 20, 64, 1, 50])
    mask = (np.arange(64)[:, None] < real).astype(np.float32)
    grad, _ = model.gradient(rows, real, mask, y)
    for k, w in model.part.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 0.01
        up = model.gradient(rows, real, mask, y)[1]
        w[at] = old - 0.01
        down = model.gradient(rows, real, mask, y)[1]
        w[at] = old
        assert abs((up - down) / 0.02 - grad[k][at]) < 0.02 * abs(grad[k][at]) + 1e-3


def plain_network(model, text):
    """Label probabilities of a text, one byte and one hidden unit at a time, over the whole text in both directions."""
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    n = langid.HIDDEN

    def run(order, d):
        table, u, h, out = model.part["X" + d].astype(float), model.part["U" + d].astype(float), [0.0] * n, {}
        for t in order:
            x, v = table[data[t]], [sum(u[k, j] * h[j] for j in range(n)) for k in range(3 * n)]
            gate = [1 / (1 + np.exp(-(x[k] + v[k]))) for k in range(2 * n)]
            new = [np.tanh(x[2 * n + k] + gate[n + k] * v[2 * n + k]) for k in range(n)]
            h = [h[k] + gate[k] * (new[k] - h[k]) for k in range(n)]
            out[t] = h
        return out

    ahead, back = run(range(len(data)), "f"), run(range(len(data) - 1, -1, -1), "b")
    total = np.zeros(len(model.labels))
    for t in range(len(data)):
        e = np.exp(model.part["O"].astype(float) @ np.array(ahead[t] + back[t]) + model.part["o"])
        total += e / e.sum()
    return total / len(data)


def test_network_against_a_plain_one():
    model = langid.ByteGRU.fresh(["a", "b", "c"])
    texts = ["A", "Größe und 中文", "x" * langid.INNER, "word " * 60, "The quick brown fox jumps over the lazy dog. " * 9]
    got = model.pooled(pa.array([*texts, "", None]))
    assert (got[-2:] == 0).all()
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_network(model, t), atol=1e-5 if len(t.encode()) <= langid.INNER else 5e-3), t


def test_spans_cover_every_byte_once():
    texts = pa.array([None, "", "é" * 300, "ab", "C" * 1000])
    s = langid.spans(texts, 64, 16)
    for i, t in enumerate(texts.to_pylist()):
        mine = np.flatnonzero(s.owner == i)
        assert b"".join(s.rows[k, s.lo[k] : s.hi[k]].tobytes() for k in mine) == (t or "").lower().encode()
        assert all(s.real[k] <= 64 + 2 * 16 for k in mine)


def test_texts_without_letters_are_und(spark):
    texts = ["½ ²", "Ⅷ ①", "٣٤", "12", "中", "ª", "x½"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, "plain words", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.language(docs).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["und", "und", "und", "und", "en", "en", "en"]
    assert [got[i][1] for i in range(len(texts))] == [False] * 4 + [True] * 3


def test_attention_weighs_the_telling_passage():
    rng = np.random.default_rng(4)
    plain = lambda n: " ".join("w%d" % x for x in rng.integers(0, 50, n))
    texts = [plain(200) if i % 2 else plain(96) + " " + "BAD!! " * 48 + plain(96) for i in range(120)]
    bags = [quality.passages(pa.array([t]))[1] for t in texts]
    y = np.array([i % 2 for i in range(120)])
    model = quality.fit_attention(bags, y)
    assert ((model.scores(pa.array(texts)) >= 0.5) == y).all()
    cuts, weight = model.attention(pa.array(texts))
    assert np.allclose(np.add.reduceat(weight, cuts[:-1]), 1, atol=1e-4)


def test_ftrl_is_sparse_and_ignores_repeats(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).to_pydict()["text"][:200]
    y = np.array([i % 2 for i in range(200)])
    texts = [(t or "") + (" awful" if k else "") for t, k in zip(texts, y, strict=True)]
    owners, found = toxicity.once(*toxicity.features(pa.array(texts)))
    rows = np.split(found, np.searchsorted(owners, np.arange(1, 200)))
    model = toxicity.fit_ftrl(rows, y)
    assert len(model.index) < 0.2 * len(np.unique(found))
    once, twice = model.margins(pa.array(["awful", "awful awful awful", ""]))[[0, 2]]
    assert once > 0 > twice or once > twice


def plain_attention(model, x):
    """The logit of one bag, passage by passage."""
    p = {k: v.astype(float) for k, v in model.part.items()}
    codes, scores = [], []
    for row in (x.astype(float) - model.mean) * model.scale:
        e = np.tanh(row @ p["E"] + p["e"])
        codes.append(e)
        scores.append(sum(np.tanh(e @ p["V"][:, k]) / (1 + np.exp(-(e @ p["U"][:, k]))) * p["w"][k] for k in range(len(p["w"]))))
    weights = np.exp(np.array(scores) - max(scores))
    return sum(w * e for w, e in zip(weights / weights.sum(), codes, strict=True)) @ p["c"] + p["b"]


def plain_features(words, per_text):
    """The features of one passage that count words."""
    n = max(len(words), 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [again / n, len(set(words)) / n, sum(len(w.encode()) for w in words) / n / 10, sum(len(w.encode()) == 1 for w in words) / n, np.log1p(len(words)) / 4, np.log1p(per_text) / 10]


def test_attention_against_a_plain_one_and_its_gradient():
    rng = np.random.default_rng(7)
    texts = [" ".join("w%d" % x for x in rng.integers(0, 60, n)) for n in (1, 48, 49, 130, 700)] + ["", "a"]
    cuts, x = quality.passages(pa.array(texts))
    for i, t in enumerate(texts):
        words = t.split()
        parts = [words[k : k + 48] for k in range(0, len(words), 48)] or [[]]
        assert np.allclose([plain_features(w, len(words)) for w in parts], x[cuts[i] : cuts[i] + len(parts), 36 + quality.BUCKETS :][:, :6], atol=1e-5)
    bags = [x[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    y = np.array([0, 1, 1, 0, 1, 0, 0])
    model = quality.fit_attention(bags, y, epochs=2)
    got = model.forward(x, cuts)["logit"]
    assert np.allclose(got, [plain_attention(model, b) for b in bags], atol=1e-3)
    model.part = {k: v.astype(np.float64) for k, v in model.part.items()}
    grad, _ = model.gradient(x.astype(float), cuts, y)
    for k, w in model.part.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape) if w.shape else ()
        old, sides = float(w[at]), []
        for step in (1e-5, -1e-5):
            model.part[k] = w.copy()
            model.part[k][at] = old + step
            sides.append(model.gradient(x.astype(float), cuts, y)[1])
        model.part[k] = w
        assert abs((sides[0] - sides[1]) / 2e-5 - grad[k][at]) < 1e-4 * abs(grad[k][at]) + 1e-7


def plain_ftrl(rows, y, alpha, beta, l1, epochs, seed):
    """FTRL-proximal with a dictionary a coordinate; coordinate -1 is the intercept, without L1."""
    z, n, order = {}, {}, np.random.default_rng(seed)

    def weight(k):
        bound = 0.0 if k == -1 else l1
        if abs(z.get(k, 0.0)) <= bound:
            return 0.0
        return -(z[k] - np.sign(z[k]) * bound) / ((beta + np.sqrt(n[k])) / alpha)

    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at = [*rows[i].tolist(), -1]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[i]
            for k in at:
                had = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(had + g * g) - np.sqrt(had)) / alpha * w[k]
                n[k] = had + g * g
    return {k: weight(k) for k in z if weight(k) != 0}


def test_ftrl_against_a_plain_one():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 80)
    rows = [np.unique(np.concatenate((rng.integers(0, 200, 20), [7] if k else []))).astype(np.uint32) for k in y]
    model = toxicity.fit_ftrl(rows, y, alpha=0.7, beta=1.0, l1=1.5, epochs=3, seed=2)
    want = plain_ftrl(rows, y, 0.7, 1.0, 1.5, 3, 2)
    assert np.isclose(model.bias, want.pop(-1)) and 7 in want
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_labels_that_disagree_or_repeat(spark):
    from lumenframe.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 9)], "doc_id long, toxic int")
    encode = lambda d: d.selectExpr("doc_id", "cast(concat(cast(doc_id as string), repeat('x', 9)) as binary) encoded")
    texts, y, _ = labelled_sample(docs, labels, "toxic", 10, 99, 2, encode)
    assert [(t[:1], k) for t, k in zip(texts, y, strict=True)] == [(b"1", 1), (b"2", 1), (b"3", 0), (b"4", 0)]
    some, _, _ = labelled_sample(docs, labels, "toxic", 10, 99, 2, encode, most_bytes=25)
    assert len(some) == 2


def test_without_labels_no_row_goes(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 2 and quality.keep_good(docs, labels).count() == 2
