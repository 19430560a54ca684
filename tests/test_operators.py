import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import classify, detector, edits, ocr, passes, reconcile, videos
from lumenframe.schema import DETECTIONS, OCR_RESULT, RECORDS
from lumenframe.session import prepare
from lumenframe.sources import models

STATES = [("manual", "Cats"), ("manual", "Explicit"), ("auto", "Low Text"), ("auto", "High Text"), ("auto", "Explicit"), ("auto-nsfw", "Explicit"), (None, None)]


def record(hash_, **given):
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
    return tuple({"hash": hash_, **given}.get(n) for n in names)


def one_record(by, category, score, words, area, old="old"):
    """The two rules for one record, written out."""
    state = (category, by, old if by else None)
    f = lambda x: None if x is None else np.float32(x)
    score, area = f(score), f(area)
    if by == "manual":
        return state
    if score is not None:
        if score >= np.float32(0.45):
            return state if category == "Explicit" else ("Explicit", "auto-nsfw", "now")
        if by == "auto-nsfw":
            state = (None, None, None)
    if words is not None and area is not None:
        wanted = "Low Text" if words <= 35 and area <= np.float32(0.05) else "High Text"
        if state[0] != wanted:
            state = (wanted, "auto", "now")
    return state


def test_rules_over_the_whole_table(spark):
    prepare(spark)
    cases = list(itertools.product(STATES, [None, 0.44, 0.45, 0.46], [None, 0, 35, 36], [None, 0.04, 0.05, 0.06]))
    rows = [record(str(i), category=c, classified_by=b, classified_at="old" if b else None, nsfw_score=s, ocr_word_count=w, ocr_text_area_ratio=a) for i, ((b, c), s, w, a) in enumerate(cases)]
    once = classify.classify(spark.createDataFrame(rows, RECORDS), F.lit("now"))
    got = {int(r.hash): (r.category, r.classified_by, r.classified_at) for r in once.collect()}
    assert got == {i: one_record(b, c, s, w, a) for i, ((b, c), s, w, a) in enumerate(cases)}
    totals = {}
    for c, b, _ in got.values():
        totals[b, c] = totals.get((b, c), 0) + 1
    assert totals == {("manual", "Cats"): 64, ("manual", "Explicit"): 64, ("auto", "Low Text"): 54, ("auto", "High Text"): 64, ("auto-nsfw", "Explicit"): 135, ("auto", "Explicit"): 46, (None, None): 21}
    assert sum(at == "now" for _, _, at in got.values()) == 168
    again = {int(r.hash): (r.category, r.classified_by, r.classified_at) for r in classify.classify(once, F.lit("later")).collect()}
    assert again == got


def test_closed_gates_change_nothing(spark):
    rows = [record("a", category="Explicit", classified_by="auto-nsfw"), record("b")]
    frame = spark.createDataFrame(rows, RECORDS)
    assert sorted(map(str, classify.classify(frame, F.lit("now")).collect())) == sorted(map(str, frame.collect()))
    assert classify.gates(frame).first().asDict() == {"has_score": False, "has_text": False}
    assert classify.gates(frame.limit(0)).first().asDict() == {"has_score": False, "has_text": False}
    # The text rule alone looks at scores only once some record has words.
    scored = spark.createDataFrame([record("a", nsfw_score=0.9)], RECORDS)
    assert classify.classify(scored, F.lit("now"), rules=("text",)).first().category is None
    with_text = scored.unionAll(spark.createDataFrame([record("b", ocr_word_count=1)], RECORDS))
    assert {r.hash: r.category for r in classify.classify(with_text, F.lit("now"), rules=("text",)).collect()} == {"a": "Explicit", "b": None}
    assert classify.ensure_categories(["Low Text"], True, True) == ["Low Text", "Explicit", "High Text"]


def test_invalidation_keeps_the_time(spark):
    frame = spark.createDataFrame([record("a", category="Gone", classified_by="auto", classified_at="t"), record("b", classified_by="x"), record("c", category="Here", classified_by="auto")], RECORDS)
    for kind in (["Here"], spark.createDataFrame([("Here",)], "name string")):
        got = {r.hash: (r.category, r.classified_by, r.classified_at) for r in classify.invalidate_categories(frame, kind).collect()}
        assert got == {"a": (None, None, "t"), "b": (None, "x", None), "c": ("Here", "auto", None)}


@pytest.mark.parametrize("as_table", [False, True])
def test_purge_never_touches_unscanned_folders(spark, as_table):
    records = spark.createDataFrame([record("seen", last_known_path="f/a.png"), record("gone", last_known_path="f/b.png"), record("away", last_known_path="g/c.png"), record("blank", last_known_path=""), record("top", last_known_path="t.png"), record("null")], RECORDS)
    files = spark.createDataFrame([("f/a.png", 1, 2, "seen"), ("f/z.png", 3, 4, "seen"), ("f/new.png", 5, 6, "new")], "relative_path string, size long, modified_ms long, hash string")
    scanned = spark.createDataFrame([("f",)], "name string") if as_table else ["f"]
    got = {r.hash: (r.last_known_path, r.size) for r in reconcile.reconcile(records, files, scanned).collect()}
    assert got == {"seen": ("f/z.png", 3), "new": ("f/new.png", 5), "away": ("g/c.png", None)}


def test_hash_reuse_needs_all_three_facts(spark):
    records = spark.createDataFrame([record("h", last_known_path="a", size=1, modified_ms=2), record("i", last_known_path="b", size=1), record("j", last_known_path="", size=1, modified_ms=2)], RECORDS)
    files = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 2), ("b", 1, None), ("", 1, 2)], "relative_path string, size long, modified_ms long").selectExpr("*", "cast(null as string) as hash")
    got = sorted((r.relative_path, r.size, str(r.modified_ms), r.hash) for r in reconcile.reuse_hashes(files, reconcile.hash_index(records)).collect())
    assert [x[3] for x in got] == [None, "h", None, None, None]


def test_merge_drops_unknown_and_sets_nulls(spark):
    records = spark.createDataFrame([record("a", nsfw_score=0.5), record("b", nsfw_score=0.5)], RECORDS)
    updates = spark.createDataFrame([("a", None), ("x", 0.1)], "hash string, nsfw_score float")
    assert {r.hash: r.nsfw_score for r in reconcile.merge_columns(records, updates, ["nsfw_score"]).collect()} == {"a": None, "b": 0.5}


def plan_of(spark, frames, n=10, **kind):
    titled = spark.createDataFrame(frames, "hash string, title string")
    return {r.title: r for r in videos.build_plan(titled, n, **kind).collect()}


def frames(title, n):
    return [(f"{title}-h{i:02d}", title) for i in range(n)]


def test_plans(spark):
    a, b = frames("Trip A", 15), frames("Trip B", 3)
    plan = plan_of(spark, a + b + a[:2] + [("x", ""), ("y", None), ("z", "--")])
    assert {t: (len(p.member_hashes), len(p.selected_hashes)) for t, p in plan.items()} == {"Trip A": (15, 10), "Trip B": (3, 3)}
    assert plan_of(spark, list(reversed(a)) + b) == plan
    assert len(plan_of(spark, a, n=0)["Trip A"].selected_hashes) == 1
    first = [h for h, _ in a[:10]]
    before = spark.createDataFrame([("trip a!", first), ("Trip C", ["q"])], "title string, selected_hashes array<string>")
    assert plan_of(spark, a, previous=before)["Trip A"].selected_hashes == first
    assert plan_of(spark, a, previous=before, force=True)["Trip A"].selected_hashes != first
    stale = spark.createDataFrame([("Trip A", [*reversed(first[:5]), "stale"])], "title string, selected_hashes array<string>")
    assert plan_of(spark, a[:12], previous=stale)["Trip A"].selected_hashes == first[:5][::-1]
    gone = spark.createDataFrame([("Trip A", ["stale"])], "title string, selected_hashes array<string>")
    assert len(plan_of(spark, a, previous=gone)["Trip A"].selected_hashes) == 10
    assert videos.plan_summary(videos.build_plan(spark.createDataFrame([], "hash string, title string"))).first().asDict() == {"groups": 0, "members": 0, "selected": 0}


def test_detector(spark):
    nan = float("nan")
    rows = [("a", 0, 2, 0.3), ("a", 1, 2, nan), ("a", 0, 1, 0.5), ("a", 1, 1, 0.2), ("a", 0, 7, -1.0), ("b", 0, 0, nan), ("b", 0, 1, 0.005)]
    maxima = detector.class_maxima(spark.createDataFrame(rows, DETECTIONS))
    assert {(r.hash, r["class"]): round(r.score, 3) for r in maxima.collect()} == {("a", 2): 0.3, ("a", 1): 0.5, ("a", 7): 0.0, ("b", 0): 0.0, ("b", 1): 0.005}
    assert {r.hash: round(r.nsfw_score, 3) for r in detector.explicit_scores(maxima).collect()} == {"a": 0.3, "b": 0.0}
    got = {r.hash: r.nsfw_labels for r in detector.labels(maxima).collect()}
    assert got == {"a": ["explicit BUTTOCKS_EXPOSED 30%", "top FACE_FEMALE 50%", "top BUTTOCKS_EXPOSED 30%"], "b": ["No NudeNet class reached 1% confidence."]}


def test_ocr_results_and_injected_models(spark):
    files = spark.createDataFrame([("h", "r", "path", "n"), ("bad", "r", "bad", "n")], "hash string, relative_path string, absolute_path string, name string")
    word = lambda y, w: {"y": y, "width": w, "height": 2.0}

    def make():
        def engine(path):
            if path == "bad":
                raise OSError("unreadable")
            return {"width": 10.0, "height": 50.0, "lines": [{"text": "My Clip - YouTube", "words": [word(3.0, 5.0), word(9.0, 5.0)]}, {"text": "empty", "words": []}, {"text": "below", "words": [word(3.1, 100.0)]}]}

        return engine

    assert [tuple(r) for r in models.text_stats(make)(files).collect()] == [("h", 3, pytest.approx(0.44))]
    assert [tuple(r) for r in models.video_titles(make)(files).collect()] == [("h", "My Clip")]
    assert [tuple(r) for r in models.text_extract(make)(files).collect()] == [("h", len("My Clip - YouTube\nempty\nbelow"))]
    tall = np.zeros((1, 22, 3), np.float32)
    tall[0, 4 + 3] = [0.2, 0.9, np.nan]
    scores = {r.hash: r for r in models.explicit_scores(lambda: lambda t: tall, lambda p: 1 / 0 if p == "bad" else np.zeros((4, 4, 3)), True)(files).collect()}
    assert scores["h"].nsfw_score == pytest.approx(0.9) and scores["bad"].nsfw_score == 0.0
    assert [r.hash for r in models.explicit_scores(lambda: lambda t: tall, lambda p: 1 / 0 if p == "bad" else np.zeros((4, 4, 3)))(files).collect()] == ["h"]
    client = lambda: lambda body: '{"choices":[{"message":{"content":" seen "}}]}' if "aGk=" in body else "<html>"
    said = {r.hash: (r.description, r.error) for r in models.described(files, client, lambda p: b"hi" if p == "path" else b"no", "", "prompt").collect()}
    assert said == {"h": ("seen", None), "bad": (None, "no text content: <html>")}
    assert spark.createDataFrame([("h", 1.0, 1.0, [])], OCR_RESULT).select(*ocr.result_stats()).first()[0] == 0


def test_vision_eligibility_and_reasons(spark):
    schema = "hash string, relative_path string, source_folder string, nsfw_score float, vision_desc_chars int"
    view = spark.createDataFrame([("a", "1", "f", 0.1, None), ("b", "2", "f", 0.45, None), ("c", "3", "f", None, None), ("d", "4", "f", 0.1, None), ("e", "5", "out", 0.1, None), ("g", "6", "f", 0.1, 5), ("i", "7", "f", 0.9, None)], schema)
    plan = spark.createDataFrame([(["d", "a", "i"], ["a"])], "member_hashes array<string>, selected_hashes array<string>")
    out = spark.createDataFrame([("out",)], "name string")
    chosen = lambda **k: {r.hash for r in passes.vision_eligible(view, excluded=out, **k).collect()}
    assert chosen(plan=plan) == {"a"} and chosen(plan=None) == {"a", "d"} and chosen(plan=plan, force=True) == {"a", "g"}
    assert {r.reason: r.n for r in passes.skip_counts(view, plan, out).collect()} == {"video": 2, "explicit": 1, "unscored": 1}


def test_edits(spark):
    records = spark.createDataFrame([record("a", category="X", classified_by="auto", classified_at="t", last_known_path="p")], RECORDS)
    changes = spark.createDataFrame([("a", "Y", 1), ("a", None, 2), ("new", "Z", 1)], "hash string, category string, at int")
    got = {r.hash: (r.category, r.classified_by, r.classified_at, r.last_known_path) for r in edits.assign(records, changes, F.lit("now")).collect()}
    assert got == {"a": (None, None, None, "p"), "new": ("Z", "manual", "now", "")}
    assert edits.move_to_front(["a", "b"], "b") == ["b", "a"]
    inside, outside = edits.outside_root(spark.createDataFrame([("/r/a",), ("/rx/a",), ("/r",)], "path string"), "/r")
    assert inside.count() == 1 and outside.count() == 2
