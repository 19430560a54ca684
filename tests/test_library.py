import json
import os
import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenframe.library import Busy, Library, scheduled_refresh
from lumenframe.session import prepare
from lumenframe.sinks import store as sinks
from lumenframe.sources import documents, files
from lumenframe.sources.documents import Settings
from lumenframe.streaming.incremental import stream_results
from lumenframe.streaming.progress import PassProgress
from lumenframe.operators.passes import PASSES


@pytest.fixture
def library(spark, tmp_path):
    prepare(spark)
    root = tmp_path / "lib"
    for name, body in {
        "root.PNG": "r", "_u.png": "u", ".dot.png": "d", "notes.txt": "n",
        "2026-01/x.HEIC": "x", "2026-01/copy.png": "x", "2026-01/.hid/y.png": "y", "2026-01/a/b/c/d/deep4.png": "4", "2026-01/a/b/c/d/e/deep5.png": "5",
        "2026-02/k=1/p.png": "p", "2026-02/n.txt": "n", "June 2026/a b.jpg": "ab", "other/o.png": "o",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    lib = Library(spark, str(root), clock=iter(f"2026-01-01T00:00:{i:02d}.000Z" for i in range(1000)).__next__)
    lib.set_source_pattern("YYYY-MM")
    return lib


def found(view):
    return {r.relative_path: r for r in view.images.collect()}


def test_scan_follows_depth_names_and_patterns(library):
    view = library.scan()
    assert set(found(view)) == {"root.PNG", "_u.png", "2026-01/x.HEIC", "2026-01/copy.png", "2026-01/a/b/c/d/deep4.png", "2026-02/k=1/p.png"}
    rows = found(view)
    assert rows["2026-01/x.HEIC"].hash == rows["2026-01/copy.png"].hash != rows["root.PNG"].hash
    folders = {r.name: (r.image_count, r.is_root) for r in view.folders.collect()}
    assert folders == {"2026-01": (3, False), "2026-02": (1, False), "Root": (2, True)}
    library.add_folder("other")
    assert "other/o.png" in found(library.scan())
    library.set_source_pattern("Month YYYY")
    assert set(found(library.scan())) == {"root.PNG", "_u.png", "June 2026/a b.jpg", "other/o.png"}
    for bad in ("(", r"a(?=b)", r"(a)\1"):
        with pytest.raises(ValueError):
            library.set_source_pattern(regex=bad)
    assert set(found(library.scan())) == {"root.PNG", "_u.png", "June 2026/a b.jpg", "other/o.png"}


def test_rescan_keeps_and_purges(library):
    before = found(library.scan())
    library.create_category("Cats")
    library.assign(before["2026-02/k=1/p.png"].hash, "Cats")
    root = Path(library.root)
    shutil.move(root / "2026-02/k=1/p.png", root / "2026-01/moved.png")
    (root / "2026-01/x.HEIC").unlink()
    (root / "root.PNG").unlink()
    after = found(library.scan())
    assert after["2026-01/moved.png"].category == "Cats" and "root.PNG" not in after
    records = {r.hash: r for r in library.store.read()[1].collect()}
    assert before["root.PNG"].hash not in records and records[before["2026-01/x.HEIC"].hash].last_known_path == "2026-01/copy.png"
    library.set_source_pattern("MM-YYYY")  # 2026-01 isn't scanned now, so nothing of it may go
    library.scan()
    kept = {r.hash for r in library.store.read()[1].collect()}
    assert before["2026-02/k=1/p.png"].hash in kept
    again = library.store.read()[1]
    library.scan()
    assert sorted(map(str, library.store.read()[1].collect())) == sorted(map(str, again.collect()))


def test_categories_and_thresholds(library):
    h = found(library.scan())["root.PNG"].hash
    library.create_category(" Trips ")
    for call in (lambda: library.create_category("trips"), lambda: library.rename_category("Trips", "TRIPS"), lambda: library.create_category("a/b"), lambda: library.create_category(""), lambda: library.assign(h, "None such")):
        with pytest.raises(ValueError):
            call()
    library.assign(h, "Trips")
    library.rename_category("Trips", "Tours")
    assert found(library.scan())["root.PNG"].category == "Tours"
    library.delete_category("Tours")
    row = found(library.scan())["root.PNG"]
    assert row.category is None and row.classified_by is None and row.classified_at is not None
    library.assign(h, None)
    assert found(library.scan())["root.PNG"].classified_at is None


def test_passes_plan_and_vision(library):
    def scores(todo):
        low = F.col("relative_path").contains("deep4")
        return todo.select("hash", F.when(low, 0.1).otherwise(0.45).cast("float").alias("nsfw_score"), F.array(F.lit("x")).alias("nsfw_labels"))

    assert library.run_pass("nsfw", scores) == "5 analyzed."
    assert library.run_pass("nsfw", scores) == "0 analyzed."
    view = library.scan()
    assert view.config.categories == ("Explicit",) and {r.category for r in view.images.where("nsfw_score > 0.4").collect()} == {"Explicit"}
    words = lambda todo: todo.select("hash", F.lit(36).alias("ocr_word_count"), F.lit(0.05).cast("float").alias("ocr_text_area_ratio"))
    assert library.run_pass("text", words) == "1 analyzed."
    assert {r.name: r.image_count for r in library.scan().categories.collect()}["High Text"] == 1
    library.set_thresholds(words=36)
    assert {r.name: r.image_count for r in library.scan().categories.collect()}["Low Text"] == 1
    library.set_thresholds(score=0.9)
    assert {r.name: r.image_count for r in library.scan().categories.collect()}["Explicit"] == 0
    title = lambda todo: todo.select("hash", F.when(F.col("relative_path").contains("2026"), "Trip").otherwise("").alias("video_title"))
    library.run_pass("chunk", title)
    plan = library.plan().collect()
    assert len(plan) == 1 and len(plan[0].member_hashes) == 3 == len(plan[0].selected_hashes)
    described = lambda todo: todo.select("hash", F.lit(12).alias("vision_desc_chars"))
    assert library.run_pass("vision", described) == "5 analyzed."
    index = json.loads(Path(library.write_index()).read_text())
    assert len(index["byPath"]) == 5
    library.include_folder("2026-01", False)
    library.include_folder("2026-02", False)
    library.include_folder("Root", False)
    assert library.run_pass("extract", described, True) == "All source folders are excluded from analysis."
    library.include_folder("Root", True)
    assert set(r.relative_path for r in library.scan().search(query="PNG").collect()) == {"root.PNG", "_u.png"}
    library.discard_plan()
    assert library.plan() is None


def test_state_document_round_trip(library, spark, tmp_path):
    library.create_category("Cats")
    library.assign(found(library.scan())["root.PNG"].hash, "Cats")
    path = library.export()
    config, records = documents.read_state(spark, path)
    assert config == library.store.read()[0]
    assert sorted(map(str, records.collect())) == sorted(map(str, library.store.read()[1].collect()))
    other = Library(spark, library.root, state=f"file://{tmp_path}/other")
    assert other.adopt().categories == ("Cats",)
    Path(path).write_text("{ not json")
    with pytest.raises(Exception):  # noqa: B017, PT011
        other.adopt()
    assert other.store.read()[0].categories == ("Cats",)


def test_import_and_move(library, tmp_path):
    drop = tmp_path / "drop"
    (drop / "sub").mkdir(parents=True)
    for name in ("a.png", "sub/a.png", "sub/.b.png", "c.txt"):
        (drop / name).write_text(name)
    report = library.import_images("Imported", [str(drop), f"{library.root}/root.PNG"])
    assert (report.imported, report.skipped) == (2, 1) and sorted(os.listdir(f"{library.root}/Imported")) == ["a (2).png", "a.png"]
    assert "Imported/a (2).png" in found(library.scan())
    with pytest.raises(ValueError):
        library.import_images("Imported", [f"{library.root}/root.PNG"])
    with pytest.raises(ValueError):
        library.import_images(".hidden", [str(drop)])
    h = found(library.scan())["root.PNG"].hash
    assert library.move_image(h, "root.PNG", "Imported") == "Imported/root.PNG"
    assert {r.hash: r.last_known_path for r in library.store.read()[1].collect()}[h] == "Imported/root.PNG"
    with pytest.raises(ValueError):
        library.move_image(h, "../drop/a.png", "Imported")


def test_hash_reuse_opens_no_unchanged_file(library, monkeypatch):
    view = library.scan()
    old = found(view)["2026-02/k=1/p.png"]
    path = Path(library.root, "2026-02/k=1/p.png")
    stat = path.stat()
    path.write_text("P")  # same size; the old time is put back
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert found(library.scan())["2026-02/k=1/p.png"].hash == old.hash
    time.sleep(0.01)
    path.write_text("P")
    assert found(library.scan())["2026-02/k=1/p.png"].hash != old.hash


def test_store_listing_and_streaming(library, spark, tmp_path):
    view = library.scan()
    listed = {r.relative_path for r in files.scan_store(spark, library.root).collect()}
    assert {"2026-01/a/b/c/d/deep4.png", "June 2026/a b.jpg", "root.PNG"} <= listed and "2026-01/a/b/c/d/e/deep5.png" not in listed
    h = found(view)["root.PNG"].hash
    results = tmp_path / "results"
    schema = "hash string, nsfw_score float, nsfw_labels array<string>"
    for k, score in enumerate((0.9, 0.2)):
        spark.createDataFrame([(h, score, ["l"]), ("unknown", score, [])], schema).write.mode("append").parquet(str(results))
        stream_results(spark, str(results), schema, PASSES["nsfw"], library.store, str(tmp_path / "ck"), "now").awaitTermination()
        row = {r.hash: r for r in library.store.read()[1].collect()}
        assert set(row) == {r.hash for r in view.images.collect()}
        assert (row[h].category, row[h].nsfw_score > 0.5) == (("Explicit", True) if k == 0 else (None, False))


def test_scheduled_refresh(library, spark, tmp_path):
    scores = lambda todo: todo.select("hash", F.lit(0.1).cast("float").alias("nsfw_score"), F.array().cast("array<string>").alias("nsfw_labels"))
    after = scheduled_refresh(spark, Settings(auto_refresh_roots=(library.root, str(tmp_path / "none")), auto_refresh_passes=("nsfw",)), {"nsfw": scores})
    assert after.last_auto_refresh_summary == "Completed 1 folder."
    assert scheduled_refresh(spark, Settings(auto_refresh_roots=("a", "b")), {}, lambda: True).last_auto_refresh_summary == "Cancelled after 0 of 2 folders."
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"vision_model": "m", "unknown": 1}))
    assert documents.read_settings(str(path)).vision_model == "m"
    path.write_text("{")
    with pytest.raises(ValueError):
        documents.read_settings(str(path))


def test_text_and_description_files(spark, tmp_path):
    sinks.write_texts(spark.createDataFrame([("h1", "line"), ("h1", "line"), ("h2", None)], "hash string, text string"), str(tmp_path))
    assert (tmp_path / ".media-library-ocr-text/h1.txt").read_text() == "line"
    rows = spark.createDataFrame([("h", "a/b.png", "b.png", "", "Größe")], "hash string, relative_path string, name string, video_title string, description string")
    docs = sinks.description_documents(rows, "m", "now")
    assert docs.first().vision_desc_chars == 5
    sinks.write_descriptions(docs, str(tmp_path))
    stored = json.loads((tmp_path / ".media-library-descriptions/h.json").read_text())
    assert stored == {"schemaVersion": 1, "hash": "h", "relativePath": "a/b.png", "name": "b.png", "videoTitle": None, "description": "Größe", "model": "m", "promptVersion": 1, "analyzedAt": "now"}
    made = sinks.write_thumbnails(spark.createDataFrame([("h", "x"), ("h", "x"), ("bad", "y")], "hash string, absolute_path string"), str(tmp_path), lambda s, t: Path(t).write_text(s) if s == "x" else 1 / 0)
    assert {r.hash: bool(r.thumbnail) for r in made.collect()} == {"h": True, "bad": False}


def test_vision_pass_writes_documents_and_says_what_it_skipped(library):
    low = lambda todo: todo.select("hash", F.when(F.col("relative_path").contains("p.png"), 0.9).otherwise(0.1).cast("float").alias("nsfw_score"), F.array().cast("array<string>").alias("nsfw_labels"))
    client = lambda: lambda body: '{"choices":[{"message":{"content":" a beach "}}]}'

    def encode(path):
        if path.endswith("_u.png"):
            raise OSError("unreadable")
        return b"jpeg"

    settings = Settings(vision_model=" ")
    assert library.run_vision(client, encode, settings, "p") == "Nothing to describe. Skipped: 6 not yet Explicit-analyzed (run Explicit first)."
    library.run_pass("nsfw", low)
    assert library.run_vision(client, encode, settings, "p") == "Described 3 images. 1 failed (see logs; endpoint http://localhost:1234/v1/chat/completions)."
    stored = list(Path(library.root, ".media-library-descriptions").glob("*.txt"))
    assert len(stored) == 3 and stored[0].read_text() == "a beach"
    assert library.run_vision(client, lambda p: b"jpeg", settings, "p") == "Described 1 image."
    assert library.run_vision(client, encode, settings, "p") == "Nothing to describe. Skipped: 1 explicit."


def test_one_pass_of_a_kind_at_a_time(library, spark):
    def again(todo):
        with pytest.raises(Busy):
            Library(spark, library.root).run_pass("nsfw", lambda t: t)
        return todo.select("hash", F.lit(0.1).cast("float").alias("nsfw_score"), F.array().cast("array<string>").alias("nsfw_labels"))

    assert library.run_pass("nsfw", again) == "5 analyzed."
    library.cancel("nsfw")  # nothing runs: nothing happens


def test_settings_and_progress(library, spark, tmp_path):
    settings = documents.remember_root(documents.remember_root(Settings(), "/none"), library.root)
    assert settings.known_roots == (library.root, "/none")
    with pytest.raises(ValueError):
        documents.with_auto_refresh(settings, True, "04:00", ["/none"], [])
    settings = documents.with_auto_refresh(settings, True, "4:05", [library.root], ["text", "vision", "nsfw"])
    assert (settings.auto_refresh_time, settings.auto_refresh_passes) == ("04:05", ("nsfw", "text"))
    documents.write_settings(settings, str(tmp_path / "s.json"))
    assert documents.read_settings(str(tmp_path / "s.json")) == settings
    events = []
    listener = PassProgress(lambda n, rows: events.append(rows), lambda n, error: events.append(error))
    spark.streams.addListener(listener)
    schema = "hash string, ocr_text_chars int"
    spark.createDataFrame([("x", 1), ("y", 2)], schema).write.parquet(str(tmp_path / "r"))
    stream_results(spark, str(tmp_path / "r"), schema, PASSES["extract"], library.store, str(tmp_path / "ck"), "now").awaitTermination()
    for _ in range(100):
        if events[-1:] == [None]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert max(e for e in events if e is not None) == 2 and events[-1] is None


def test_images_stream_under_the_hashes_of_scans(library, spark, tmp_path):
    from lumenframe.streaming.incremental import stream_images

    before = {r.hash for r in library.scan().images.collect()}
    scores = lambda todo: todo.select("hash", F.lit(0.7).cast("float").alias("nsfw_score"), F.array(F.col("name")).alias("nsfw_labels"))
    stream_images(spark, f"{library.root}/2026-01", scores, PASSES["nsfw"], library.store, str(tmp_path / "ck"), "now").awaitTermination()
    rows = [r for r in library.store.read()[1].collect() if r.nsfw_score is not None]
    assert {r.hash for r in rows} <= before and {x for r in rows for x in r.nsfw_labels} & {"x.HEIC", "copy.png"} and len(rows) == 2
    assert all(r.category == "Explicit" for r in rows)


def test_a_crash_between_version_and_pointer_leaves_the_last_version(library, monkeypatch):
    library.scan()
    library.create_category("Cats")
    config, records = library.store.read()
    want = sorted(map(str, records.collect()))
    monkeypatch.setattr(sinks.RecordStore, "_point", lambda self, value: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        library.store.commit(lambda c, r: (c, r.limit(0)))
    monkeypatch.undo()
    monkeypatch.setattr(sinks.RecordStore, "remove", lambda self, path: None)  # a crash before old pointers go
    library.create_category("Dogs")
    monkeypatch.undo()
    after, records = library.store.read()
    assert after.categories == ("Cats", "Dogs") and sorted(map(str, records.collect())) == want
    folder = Path(library.store.folder.removeprefix("file://"))
    for path in folder.glob("CURRENT-*"):
        path.unlink()
    with pytest.raises(ValueError):
        library.store.read()


def test_a_second_driver_cannot_take_the_same_number(library, spark):
    library.scan()
    other = sinks.RecordStore(spark, library.store.folder)
    stale = other._pointer()
    library.create_category("Cats")
    with pytest.raises(RuntimeError):
        other._point(stale)
    assert library.store.read()[0].categories == ("Cats",)


def test_passes_commit_each_batch_and_cancel_keeps_them(library):
    heard = []
    library.events = lambda kind, what: heard.append((kind, what))
    scores = lambda todo: todo.select("hash", F.lit(0.1).cast("float").alias("nsfw_score"), F.array().cast("array<string>").alias("nsfw_labels"))
    calls = []

    def cancelled(todo):
        calls.append(todo.count())
        if len(calls) == 3:
            library.cancel("nsfw")
        return scores(todo)

    said = library.run_pass("nsfw", cancelled, rows=1)
    stored = [r for r in library.store.read()[1].collect() if r.nsfw_score is not None]
    assert said == f"Cancelled: {len(stored)} of 5 analyzed." and sum(calls[:2]) <= len(stored) < 5

    def fails(todo):
        if todo.count() and any(k == "progress" for k, _ in heard[2:]):
            raise OSError("no model")
        return scores(todo)

    with pytest.raises(OSError):
        library.run_pass("nsfw", fails, rows=1)
    assert heard[-1][0] == "finished" and "no model" in heard[-1][1]["error"]
    said = library.run_queue({"extract": lambda t: t.select("hash", F.lit(3).alias("ocr_text_chars")), "nsfw": scores})
    assert list(said) == ["nsfw", "extract"]
    assert all(r.nsfw_score is not None and r.ocr_text_chars == 3 for r in library.store.read()[1].collect())


def test_scans_make_thumbnails_and_show_them(spark, library):
    def shrink(source, target):
        if source.endswith("root.PNG"):
            raise OSError("broken")
        shutil.copyfile(source, target)

    other = Library(spark, library.root, shrink=shrink)
    rows = found(other.scan())
    assert rows["root.PNG"].thumbnail is None
    assert Path(rows["2026-01/x.HEIC"].thumbnail).read_text() == "x" == Path(rows["2026-01/copy.png"].thumbnail).read_text()
    assert found(other.scan())["2026-01/x.HEIC"].thumbnail == rows["2026-01/x.HEIC"].thumbnail


def test_names_differ_beyond_ascii(library):
    library.scan()
    library.create_category("ÄRGER")
    library.create_category("ärger")
    with pytest.raises(ValueError):
        library.create_category("ÄRGEr")


def test_settings_of_the_view(tmp_path):
    settings = documents.with_dark_mode(documents.with_tile_size(documents.with_vision(Settings(), " http://x ", " m "), 9999), False)
    assert (settings.vision_endpoint, settings.vision_model, settings.tile_size, settings.dark_mode) == ("http://x", "m", 280, False)
    assert documents.choose_root(settings, str(tmp_path)).known_roots[0] == str(tmp_path)
    with pytest.raises(ValueError):
        documents.choose_root(settings, str(tmp_path / "none"))


def test_roots_may_have_any_characters(spark, tmp_path):
    root = tmp_path / "a (1)+[x]"
    (root / "2026-01").mkdir(parents=True)
    (root / "2026-01/p.png").write_text("p")
    assert [r.relative_path for r in files.scan(spark, str(root), ["2026-01"]).collect()] == ["2026-01/p.png"]
