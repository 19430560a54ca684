import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenframe.llm.urlfilter import filter_urls, validity_intervals

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
ENTRIES = "list string, pattern string, action string, day date"
CAPTURES = "id long, url string, fetched date, pattern string"
HOSTS = ["a.b.example.com", "b.example.com", "example.com", "other.net", "com"]


def active(entries, patterns, day):
    found = {}
    for name in {e[0] for e in entries}:
        for p in patterns:
            past = [e for e in entries if e[0] == name and e[1] == p and e[3] <= day]
            if past:
                last = max(e[3] for e in past)
                if any(e[2] == "add" for e in past if e[3] == last):
                    found.setdefault(name, []).append(p)
    return found


def patterns(host, segment):
    labels = host.split(".")
    return {".".join(labels[i:]) for i in range(len(labels))} | ({f"{host}/{segment}"} if segment else set())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["ads", "bad"]), st.sampled_from(HOSTS + ["example.com/x"]), st.sampled_from(["add", "remove"]), st.integers(0, 8).map(DAY)), max_size=25), st.lists(st.tuples(st.sampled_from(HOSTS), st.sampled_from(["", "x", "y"]), st.integers(0, 9).map(DAY)), max_size=20))
def test_each_capture_sees_the_entries_of_its_day(spark, entries, captures):
    rows = [(i, f"https://{h}/{s}?q#f", d, "clash") for i, (h, s, d) in enumerate(captures)]
    got = {r.id: r for r in filter_urls(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()}
    assert len(got) == len(rows)
    for i, (h, s, d) in enumerate(captures):
        want = active(entries, patterns(h, s), d)
        hit = sorted({p for ps in want.values() for p in ps}, key=lambda p: (-len(p), p))
        assert (got[i].lists, got[i].matched, got[i].blocked) == (sorted(want), hit[0] if hit else None, bool(hit))


def test_intervals_merge_repeats(spark):
    rows = [("l", "H.com", "add", DAY(1)), ("l", "h.com", "add", DAY(3)), ("l", "h.com", "remove", DAY(5)), ("l", "h.com", "add", DAY(5)), ("l", "h.com", "remove", DAY(7)), ("l", "h.com", "remove", DAY(9)), ("l", "h.com", "add", DAY(9)), (None, "h.com", "add", DAY(0)), ("l", "h.com", "drop", DAY(0)), ("l", None, "add", DAY(0)), ("l", "h.com", "add", None)]
    got = sorted(tuple(r) for r in validity_intervals(spark.createDataFrame(rows, ENTRIES)).collect())
    assert [(r[2], r[3]) for r in got] == [(DAY(1), DAY(7)), (DAY(9), None)]


def test_odd_urls_and_empty_tables(spark):
    entries = spark.createDataFrame([("l", "example.com", "add", DAY(0)), ("l", "example.com/A", "add", DAY(0))], ENTRIES)
    urls = ["HTTP://User:pw@WWW.Example.COM.:80/A/b", "http://example.com", None, "", "example.com/x", "http:///x", "https://" + "a." * 200 + "example.com/", "http://notexample.com", "http://example.com" + "/" + "x" * 100_000]
    rows = [(i, u, DAY(1), "") for i, u in enumerate(urls)] + [(99, "http://example.com", None, ""), (None, "http://example.com/A", DAY(1), ""), (1, urls[1], DAY(1), "")]
    table = spark.createDataFrame(rows, CAPTURES)
    got = sorted(((str(r.id), r.blocked, r.matched) for r in filter_urls(table, entries).collect()))
    hit, path = (True, "example.com"), (True, "example.com/A")
    assert got == sorted([("0", *hit), ("1", *hit), ("1", *hit), ("6", *hit), ("8", *hit), ("None", *path), *[(str(i), False, None) for i in (2, 3, 4, 5, 7, 99)]])
    assert filter_urls(table.limit(0), entries).collect() == []
    assert [r.blocked for r in filter_urls(table, entries.limit(0)).collect()] == [False] * len(rows)


def test_long_hosts_and_addresses(spark):
    deep = ".".join(["a"] * 5000)
    rows = [("l", f"{deep}.example.com", "add", DAY(0)), ("l", "[::1]", "add", DAY(0)), ("l", "[::1]/x", "add", DAY(0)), ("l", "4]", "add", DAY(0)), ("l", "7.8.9", "add", DAY(0))]
    urls = [f"http://{deep}.example.com/", f"http://b.{deep}.example.com/", f"http://{deep[2:]}.example.com/", "http://[::1]:80/", "http://[::1]/x", "https://u@[::1.2.3.4]/", "ftp://7.8.9/", "http://x7.8.9/"]
    got = {r.id: r.matched for r in filter_urls(spark.createDataFrame([(i, u, DAY(1), "") for i, u in enumerate(urls)], CAPTURES), spark.createDataFrame(rows, ENTRIES)).collect()}
    assert [got[i] for i in range(8)] == [f"{deep}.example.com", f"{deep}.example.com", None, "[::1]", "[::1]/x", None, "7.8.9", None]
