"""The registered queries themselves, over whole tables, against brute force, and texts longer than a block."""

import importlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import langid, queries, quality, toxicity, words
from test_decontaminate import plain as hits
from test_nearcopies import plain as near_copies
from test_neardup_vectors import brute
from test_pieces import plain_sample
from test_simhash import classes
from test_simhash import plain as fingerprint
from test_wordpiece import greedy

WORD = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(WORD)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_counts(rows, texts):
    from lumenframe.llm.wordpiece import byte_vocabulary

    vocabulary = set(byte_vocabulary(WORD))
    longest = max(map(len, vocabulary))
    for r in rows:
        parts = (texts[r.doc_id] or "").encode().translate(LOWER).split()
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(parts), sum(greedy(w, vocabulary, longest) for w in parts), 0)


def check_tokens(rows, texts):
    at = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = PLAIN.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op1(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    ids = sorted(texts)
    want = {i: fingerprint(texts[i]) for i in ids}
    found = classes(ids, [want[i] for i in ids])
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, sf_dir).collect()}
    assert got == {i: (want[i], found[i]) for i in ids}


def test_op2_and_op4(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    for run, check in ((queries.op2_token_files, check_tokens), (queries.op4_token_counts, check_counts)):
        rows = run(spark, sf_dir).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        check(rows, texts)


def test_op6(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    rows = queries.op6_pieces(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(r.lossless for r in rows)
    for r in rows:
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        if len(texts[r.doc_id] or "") < 1500:
            ids = plain_sample(texts[r.doc_id], r.doc_id)
            assert (r.n_pieces, r.ids_crc32) == (len(ids), crc(ids))


def test_op7_and_op10(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    texts = texts_of(spark, sf_dir)
    ids = sorted(texts)
    column = pa.array([texts[i] for i in ids], pa.string())
    first = quality.train_quality(read("documents"), read("labels")).scores(column)
    second = toxicity.sigmoid(toxicity.train_toxicity(read("documents"), read("labels")).margins(column))
    for run, want, modulus, held in ((queries.op7_quality, first, 5, 0), (queries.op10_toxicity, second, 4, 2)):
        got = {r.doc_id: r for r in run(spark, sf_dir).collect()}
        assert sorted(got) == ids
        for i, s in zip(ids, want, strict=True):
            assert abs(got[i].score - s) < 1e-5 and got[i].predicted == (got[i].score >= 0.3)
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % modulus == held)


def test_op8(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    got = {r.doc_id: r for r in queries.op8_language(spark, sf_dir).collect()}
    langs = {r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred in langs if any(c.isalpha() for c in t or "") else got[i].lang_pred == "und"


def test_op9(spark, sf_dir):
    rows = sorted(map(tuple, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()))[:300]
    got = {r.vec_id: r for r in queries.op9_embeddings(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    few = queries.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = brute([v for _, v in rows])
    assert {r.vec_id: (r.n_links, r.component_id) for r in few.collect()} == {rows[i][0]: (n, rows[c][0]) for i, (n, c) in enumerate(want)}


def long_texts():
    """Texts of more than a block, and short ones among them; the last repeats one but for a word."""
    rng = np.random.default_rng(12)
    vocabulary = ["Lorem", "ipsum,", "dolor.", "Größe", "naïve", "it's", "12.5", "中文", "x" * 40] + [f"w{i}" for i in range(400)]
    long = " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), 300_000))
    assert len(long.encode()) > words.BLOCK_BYTES
    return {1: "a b c d e", 2: long, 3: None, 4: "", 5: long.replace("w7 ", "changed ", 1), 6: "a b c d e"}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en" if i < 4 else "fr", "clash", "clash") for i, t in long_texts().items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, score string")


def test_long_texts(spark, long_docs):
    from lumenframe.llm.decontaminate import contamination
    from lumenframe.llm.pieces import piece_digests
    from lumenframe.llm.simhash import simhash_components
    from lumenframe.llm.token_files import token_digests
    from lumenframe.llm.wordpiece import token_counts

    texts = long_texts()
    want = [fingerprint(texts[i]) for i in sorted(texts)]
    got = {r.doc_id: r for r in simhash_components(long_docs).collect()}
    assert [int(got[i].fingerprint, 16) for i in sorted(texts)] == want
    assert {i: got[i].component_id for i in texts} == classes(sorted(texts), want)
    check_tokens(token_digests(long_docs, WORD).collect(), texts)
    check_counts(token_counts(long_docs, WORD).collect(), texts)
    assert all(r.lossless for r in piece_digests(long_docs, queries.PIECE_MODEL).collect())
    middle = texts[2].split()[200_000:200_040]
    items = [(1, " ".join(middle)), (2, "not there at all"), (3, "a b c d e")]
    for r in contamination(long_docs, spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == hits(texts[r.doc_id], items)[:5]


def test_classifiers_on_long_texts(spark, long_docs):
    labels = spark.createDataFrame([(i, int(i in (2, 5)), int(i in (2, 5))) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    texts = long_texts()
    column = pa.array([texts[i] for i in sorted(texts)], pa.string())
    model = quality.train_quality(long_docs, labels)
    got = {r.doc_id: r.score for r in quality.quality(long_docs, labels).collect()}
    assert np.allclose([got[i] for i in sorted(texts)], model.scores(column), atol=1e-5)
    model = toxicity.train_toxicity(long_docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(long_docs, labels).collect()}
    assert np.allclose([got[i] for i in sorted(texts)], toxicity.sigmoid(model.margins(column)), atol=1e-5)
    got = {r.doc_id: r.lang_pred for r in langid.language(long_docs).collect()}
    assert got[3] == got[4] == "und" and all(got[i] in ("en", "fr") for i in (1, 2, 5, 6))


def test_stages_on_long_texts_and_clashing_names(spark, sf_dir, long_docs, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    texts = long_texts()
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, i != 6, i == 6) for i in texts], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[2].split()[100:130]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    named = dict(pipeline.STAGES)
    kept = named["near_duplicates"](spark, long_docs, folder)
    assert kept.columns == long_docs.columns
    ids = sorted(texts)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({ids[k] for k in near_copies([texts[i] for i in ids])}) == [1, 2, 3]
    clean = named["decontamination"](spark, long_docs, folder)
    assert clean.columns == long_docs.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == ids  # 30 words are under a twentieth
    for name in ("quality", "toxicity"):
        some = named[name](spark, long_docs, folder)
        assert some.columns == long_docs.columns and {r.doc_id for r in some.select("doc_id").collect()} <= set(ids)
    assert {r.doc_id: len(r.ids) > 0 for r in named["encoding"](spark, long_docs, folder).collect()} == {i: bool(t) for i, t in texts.items()}
