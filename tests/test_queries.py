import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, found.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_legacy_queries_against_the_plain_functions(spark):
    from lumenframe.sources.legacy import content_hash, sample

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.hash for r in entry.queries()["legacy_content_hash"](spark, SF).collect()}
    assert got == {k: None if t is None else content_hash(len(t.encode()), t.encode()[:65536]) for k, t in texts.items()}
    for r in entry.queries()["legacy_sample"](spark, SF).collect():
        assert r.selected_hashes == sample(r.member_hashes, 10)
