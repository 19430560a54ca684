"""URL filters with dated lists: validity intervals and an as-of join, in DataFrame functions only.

A list entry says that from a day on a pattern is on a list (``add``) or no longer (``remove``).
Entries of one list and pattern become disjoint validity intervals; a capture is evaluated against
those that hold its fetch day, for every pattern its URL can match: its host, each parent domain, and
its host with the first path segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Table, spread


def host_of(url: Column) -> Column:
    """The lower-case host of a URL with a scheme, without user, port and final dot; null if there is none.

    An IPv6 address keeps its brackets.
    """
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))
    host = F.regexp_replace(found, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def segment_of(url: Column) -> Column:
    """The first path segment, as it is written; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)", 1)


def patterns_of(host: Column, segment: Column, most: int) -> Column:
    """The distinct patterns of at most ``most`` labels a URL can match; none without a host.

    An IPv6 address has no parent domains.  ``most`` is that of the longest listed pattern, so that a host
    of very many labels makes no more text than can match.
    """
    labels = F.split(host, r"\.", -1)
    last = F.slice(labels, F.greatest(F.size(labels) - most, F.lit(0)) + 1, most)
    domains = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    whole = F.when(host.startswith("["), F.array(host)).otherwise(domains)
    path = F.when((F.length(segment) > 0) & (F.size(labels) <= most), F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(whole, path)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, pattern, action, day)`` -> disjoint (list, pattern, valid_from, valid_to), valid_to excluded or null.

    An addition of what is on the list and a removal of what isn't change nothing; an addition and a
    removal on one day leave the pattern on the list.  Entries with a null or an action other than
    ``add`` and ``remove`` are ignored; patterns match in lower case up to their first slash.  A pattern
    with more than one path segment (host/a/b) matches no URL.
    """
    slash = F.instr("pattern", "/")
    key = F.when(slash == 0, F.lower("pattern")).otherwise(F.concat(F.lower(F.expr("substring(pattern, 1, instr(pattern, '/') - 1)")), F.expr("substring(pattern, instr(pattern, '/'))")))
    usable = entries.where(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull())
    days = usable.groupBy("list", key.alias("pattern"), F.col("day").cast("date").alias("day")).agg(F.max(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    changed = days.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    return changed.withColumn("valid_to", F.lead("day").over(order)).where("on").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(id, url, fetched)`` -> (id, host, fetched, lists, matched, blocked) for each row.

    lists: the names of all lists with an interval that holds the fetch day for one of the URL's
    patterns, sorted; matched: the longest such pattern (the first in byte order of equally long
    ones); blocked: there is one.  Hosts and patterns may have any length.  A null URL, one without scheme and host, and a null fetch day match
    nothing; repeated rows are each evaluated; no captures give no rows; other columns are ignored.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("uid"), "id", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"), F.col("fetched").cast("date").alias("fetched"))
    rows = Table(rows, "captures").df
    spans = Table(validity_intervals(entries), "intervals").df
    most = spans.agg(F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\.", -1)))).first()[0] or 1
    asked = rows.select("uid", "fetched", F.explode(patterns_of(F.col("host"), F.col("segment"), most)).alias("pattern"))
    asked, spans = spread(asked, spans, ["pattern"], "uid")
    held = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    active = asked.join(spans, ["pattern", "salt"]).where(held)
    best = F.min(F.struct(-F.length("pattern"), "pattern"))["pattern"]
    verdicts = active.groupBy("uid").agg(F.array_sort(F.collect_set("list")).alias("lists"), best.alias("matched"))
    out = rows.join(verdicts, "uid", "left")
    return out.select("id", "host", "fetched", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "matched", F.col("matched").isNotNull().alias("blocked"))
