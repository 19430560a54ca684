import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import numbers, paths, text
from lumenframe.library import free_name
from lumenframe.session import prepare
from lumenframe.sources.legacy import content_hash, sample
from lumenframe.sources.models import letterboxed


def values(spark, rows, column, schema="x string"):
    """The column over single-column rows, in order."""
    prepare(spark)
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[1] for r in sorted(frame.select("i", column.alias("y")).collect())]


def test_clean_title(spark):
    cases = {
        "Driving across the Pyrenees mountains from France FR to Andorra AD - YouTube": "Driving across the Pyrenees mountains from France FR to Andorra AD",
        "My Road Trip   – YouTube": "My Road Trip",
        "Just a desktop screenshot": None,
        "": None,
        " - YouTube": None,
        "V Road Trip - YouTube": "V Road Trip",
        "A - Vimeo x - YouTube": "A - Vimeo x",
        "a\nb  c - VIMEO - vimeo": "a b c",
        "x — youtube music": "x",
        None: None,
    }
    assert values(spark, list(cases), text.clean_title(F.col("x"))) == list(cases.values())


def test_group_key(spark):
    a, b, c, d, e = values(spark, ["France, FR to Andorra", "france fr  to andorra", "France to Andorra", "--!", "İx Ünï_9"], text.group_key(F.col("x")))
    assert a == b != c and d == "" and e == "i̇x ünï 9"


def test_base64_vectors_on_one_line(spark):
    plain = ["", "f", "fo", "foo", "foob", "fooba", "foobar", "y" * 100]
    want = ["", "Zg==", "Zm8=", "Zm9v", "Zm9vYg==", "Zm9vYmE=", "Zm9vYmFy"]
    got = values(spark, plain, text.base64_text(F.col("x").cast("binary")))
    assert got[:-1] == want and "\n" not in got[-1] and len(got[-1]) == 136


def test_format_bytes(spark):
    cases = {None: "0 B", 0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 10240: "10 KB", 10752: "11 KB", 5 * 1024**2: "5.0 MB", 1024**3 * 5000: "5000 GB", 1048575: "1024 KB"}
    assert values(spark, list(cases), text.format_bytes(F.col("x")), "x bigint") == list(cases.values())


def test_percentages_and_labels(spark):
    assert values(spark, [0.125, 0.345, None, float("nan"), 1.0], text.percent(F.col("x")), "x double") == ["13%", "35%", None, None, "100%"]
    assert values(spark, [0.125, 0.135, 0.875], text.label_percent(F.col("x")), "x float") == ["12%", "14%", "88%"]
    assert values(spark, [1, 0, 2], text.counted(F.col("x"), "image"), "x int") == ["1 image", "0 images", "2 images"]


def test_natural_order(spark):
    prepare(spark)
    names = spark.createDataFrame([(x,) for x in ["img10", "IMG2", "img1", "eb", "Éa", "img002b"]], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["Éa", "eb", "img1", "IMG2", "img002b", "img10"]


def test_search_and_content(spark):
    frame = spark.createDataFrame([("A.png", "x/A.png"), ("b.png", "Y/b.png")], "name string, path string")
    hits = lambda q: [r.name for r in frame.where(text.matches_search(F.col("name"), F.col("path"), q)).collect()]
    assert hits(" a.PNG x/ ") == ["A.png"] and hits("  ") == ["A.png", "b.png"] and hits("%") == []
    bodies = ['{"choices":[{"message":{"content":" hi\\n"}}]}', '{"choices":[{"message":{"content":"  "}}]}', '{"choices":[]}', None]
    assert values(spark, bodies, text.describe_content(F.col("x"))) == ["hi", None, None, None]


def test_paths(spark):
    col = F.col("x")
    assert values(spark, ["a/b/c.png", "c.png", "Root/x.png"], paths.source_folder(col)) == ["a", "Root", "Root"]
    assert values(spark, ["a.PNG", "a.b.HeIf", "png", ".png", "a.", "a.txt", "a.png.bak"], paths.is_image(col)) == [True, True, False, False, False, False, False]
    assert values(spark, ["f/a/b/c/d/x.png", "f/a/b/c/d/e/x.png", "x.png", "f/.h/x.png", "_f/x.png"], paths.in_scan(col)) == [True, False, True, False, True]
    numbered = lambda n: paths.numbered_name(col, F.lit(n))
    assert values(spark, ["a.b.png", "noext", ".dot"], numbered(3)) == ["a.b (3).png", "noext (3)", ".dot (3)"]
    assert values(spark, ["a.png"], numbered(1)) == ["a.png"]
    month = paths.folder_matches(col, paths.effective_pattern("Month YYYY", " "), ["hand"])
    assert values(spark, ["june 2026", "June 2026\n", "Smarch 2026", "hand", ".June 2026", "xJune 2026"], month) == [True, False, False, True, False, False]
    assert paths.effective_pattern("YYYY-MM", "x+") == "x+" and paths.effective_pattern(None, None) is None
    assert values(spark, [dt.date(2026, 3, 5)], paths.import_folder(col), "x date") == ["Imported 03-2026"]
    assert values(spark, ["a/b/c/d", "a/b", None], text.short_path(col)) == ["a\\...\\c\\d", "a\\b", ""]


def test_names_and_times():
    assert paths.check_name(" My folder ") == "My folder"
    for bad in ("", " ", ".", "..", "a.", "a/b", 'a"', "a\x01", ".hidden"):
        with pytest.raises(ValueError):
            paths.check_name(bad)
    assert paths.check_time("4:05") == "04:05"
    for bad in ("24:00", "4:60", "4", "a:b", "1:2:3", "-1:00"):
        with pytest.raises(ValueError):
            paths.check_time(bad)


def test_numbers(spark):
    assert numbers.tile_size(10) == 96 and numbers.tile_size(900) == 280
    assert values(spark, [-1.0, 0.5, 2.0], numbers.unit(F.col("x")), "x float") == [0.0, 0.5, 1.0]
    times = [dt.datetime(2024, 1, 2, 3, 4, 5, 678901, dt.UTC), dt.datetime(1960, 1, 1, tzinfo=dt.UTC)]
    assert values(spark, times, numbers.iso_time(F.col("x")), "x timestamp")[0] == "2024-01-02T03:04:05.678Z"
    assert values(spark, times, numbers.epoch_ms(F.col("x")), "x timestamp") == [1704164645678, 0]
    boxes = values(spark, [(640, 480), (1, 5000), (320, 320), (3000, 1999)], numbers.letterbox(F.col("x.w"), F.col("x.h")), "x struct<w:int,h:int>")
    assert [tuple(b) for b in boxes] == [(320, 240, 0, 40), (1, 320, 159, 0), (320, 320, 0, 0), (320, 213, 0, 53)]


def test_letterbox_pixels():
    import numpy as np

    t = letterboxed(np.full((480, 640, 3), 255, np.uint8))
    assert t.shape == (1, 3, 320, 320) and t[0, 0, 0, 0] == np.float32(114 / 255) and t[0, :, 160, 160].tolist() == [1.0] * 3


def test_legacy_goldens(tmp_path):
    assert [x[-2:] for x in sample([f"hash{i:02d}" for i in range(25)], 10)] == "06 08 09 11 12 15 19 20 21 24".split()
    assert sample([f"hash{i:02d}" for i in range(24, -1, -1)], 10) == sample([f"hash{i:02d}" for i in range(25)], 10)
    assert [x[-2:] for x in sample([f"Trip A-h{i:02d}" for i in range(15)], 10)] == "00 01 04 05 07 08 10 11 12 14".split()
    assert sample(["b", "a", "a"], 10) == ["a", "b"] and content_hash(4, b"data") == "eba34c183c7ef86d"
    (tmp_path / "a.png").write_text("")
    assert free_name(tmp_path, "a.png").name == "a (2).png" and free_name(tmp_path, "b.png").name == "b.png"


def test_messages():
    assert text.skip_notes(1, 0, 2) == "Nothing to describe. Skipped: 1 not yet Explicit-analyzed (run Explicit first), 2 deduped video frames."
    assert text.skip_notes(0, 0, 0) == "No images needed description."
    assert text.described_summary(1, 2, "e") == "Described 1 image. 2 failed (see logs; endpoint e)."


def test_natural_order_of_long_numbers(spark):
    from lumenframe.functions.text import natural_key

    names = ["img" + "2" + "0" * 20 + ".png", "img" + "1" + "0" * 24 + ".png", "img007.png", "img10.png", "img1" + "0" * 30 + ".png"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in rows.orderBy(natural_key(rows.name)).collect()]
    assert got == sorted(names, key=lambda n: int(n[3:-4]))


def test_many_legacy_hashes_are_those_of_one(spark):
    from lumenframe.sources.legacy import siphash13, siphash13_many

    blocks = [bytes(range(n % 256)) * (1 + n % 3) for n in (0, 1, 7, 8, 9, 15, 16, 63, 64, 200, 255, 7)]
    assert siphash13_many(blocks).tolist() == [siphash13(x) for x in blocks]
    assert siphash13(bytes(range(15))) == siphash13_many([bytes(range(15))])[0] and len(siphash13_many([])) == 0
