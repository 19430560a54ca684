import sys

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumenframe.llm import pieces, quality, queries, toxicity

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_decontaminate import plain as hits  # noqa: E402
from test_nearcopies import plain as near_copies  # noqa: E402


def test_stages_against_brute_force(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "encoding"]
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        ids = sorted(before)
        if name == "quality":
            scores = quality.train_quality(kept, labels).scores(pa.array([before[i] for i in ids], pa.string()))
            want = {i for i, s in zip(ids, scores, strict=True) if s >= 0.3}
        elif name == "toxicity":
            scores = toxicity.sigmoid(toxicity.train_toxicity(kept, labels).margins(pa.array([before[i] for i in ids], pa.string())))
            want = {i for i, s in zip(ids, scores, strict=True) if s < 0.3}
        elif name == "near_duplicates":
            want = {ids[k] for k in near_copies([before[i] for i in ids])}
        else:
            want = {i for i in ids if not hits(before[i], items)[4]}
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want and 0 < len(want) < len(ids)
    final = {r.doc_id: list(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(final) == set(texts)
    lattice = pieces.lattice_of(queries.PIECE_MODEL)
    assert all(lattice.decode(np.array(v, np.int64), np.array([len(v)])) == [texts[k]] for k, v in final.items())
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()} == final


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x" * 50_000, None, "s", None), (2, "x" * 50_000, None, "s", None), (None, "x" * 50_000, None, None, None)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    ids = lambda frame: sorted((str(r.doc_id) for r in frame.select("doc_id").collect()))
    # The labels' documents aren't among these, so nothing is learned and nothing rejected.
    nothing = spark.createDataFrame([(10**9 + i, "t") for i in range(2)], "doc_id long, text string")
    assert stages["quality"](spark, nothing, sf_dir).count() == stages["toxicity"](spark, nothing, sf_dir).count() == 2
    assert ids(stages["near_duplicates"](spark, docs, sf_dir)) == ["1", "2"]
    assert ids(stages["decontamination"](spark, docs, sf_dir)) == ["1", "2", "2", "None", "None"]
    coded = [(str(r.doc_id), len(r.ids) > 0) for r in stages["encoding"](spark, docs, sf_dir).collect()]
    assert sorted(coded) == [("1", False), ("2", True), ("2", True), ("None", False), ("None", True)]
