"""Benchmark decontamination by winnowing.

Of the hashes of all word k-grams those are fingerprints that are least in some run of w of them;
two texts that share a span of k + w - 1 words share the fingerprints of that span.  The test side's
fingerprints and their word contexts become a table; the training side emits a fingerprint with its
context only if a bit filter of bounded size holds it; the join on fingerprints is followed by
comparing words outward from the k-gram, so hash collisions and filter errors never count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .simhash import ROW
from .storage import Table, spread
from .words import blocks, buffers, map_texts, mix, span_hashes

WINDOW = 13
GRAM = 5
#: The filter's bits at most (16 MiB), whatever the size of the test side.
FILTER_BITS = 1 << 27
PART_WORDS = 4096
_KEEP = np.zeros(256, bool)
_KEEP[0x30:0x3A] = _KEEP[0x61:0x7B] = _KEEP[0x80:] = True


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A-Z-lowered bytes, word starts, word ends, bounds of each text's words) of words of 0-9, a-z and non-ASCII."""
    offsets, data = buffers(pc.ascii_lower(pc.fill_null(texts, "")))
    keep = np.concatenate(([False], _KEEP[data], [False]))
    inside = keep[1:-1]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # a text starts here
    starts = np.flatnonzero(inside & (~keep[:-2] | fresh[:-1]))
    ends = np.flatnonzero(inside & (~keep[2:] | fresh[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def _slide(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + size] for each i that has so many; doubling, so log(size) passes."""
    done = 1
    out = values
    while 2 * done <= size:
        out, done = best(out[: len(out) - done], out[done:]), 2 * done
    return out if done == size else best(out[: len(values) - size + 1], out[size - done : size - done + len(values) - size + 1])


def winnow(hashes: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, fingerprints) that windows of ``length`` words select in texts of these word hashes.

    Every window of a text has its least k-gram hash selected; ties are all selected, so that the
    choice depends on the window's words alone.
    """
    k, n = min(gram, length), len(hashes)
    w = length - k + 1
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - k + 1, np.uint64)
    for t in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[t : n - k + 1 + t]
    grams = mix(grams)
    last = np.repeat(bounds[1:], np.diff(bounds))[: len(grams)]  # end of the text of each word
    within = np.arange(len(grams)) + k <= last
    grams = np.where(within, grams, np.uint64(2**64 - 1))
    padded = np.concatenate((np.full(w - 1, 2**64 - 1, np.uint64), grams, np.full(w - 1, 2**64 - 1, np.uint64)))
    least = _slide(padded, w, np.minimum)
    chosen = np.flatnonzero((_slide(least, w, np.maximum) == grams) & within)
    return chosen, mix(grams[chosen] + np.uint64(length * 64 + k))


CONTEXT = "fp long, length int, pos int, mid string, before array<string>, after array<string>"


def _contexts(data, starts, ends, bounds, text_of, chosen, prints, length, gram) -> list[tuple]:
    """Rows of CONTEXT for chosen word positions, with the words that a window around the k-gram may hold."""
    k, rows = min(gram, length), []
    for p, fp in zip(chosen.tolist(), prints.view(np.int64).tolist(), strict=True):
        lo, hi = bounds[text_of[p]], bounds[text_of[p] + 1]
        first, last = max(lo, p + k - length), min(hi, p + length)
        words = [data[starts[i] : ends[i]].tobytes().decode() for i in range(first, last)]
        at = p - first
        rows.append((fp, length, int(p - lo), " ".join(words[at : at + k]), words[:at][::-1], words[at + k :]))
    return rows


_PRINT = pa.struct([("fp", pa.int64()), ("length", pa.int32()), ("pos", pa.int32()), ("mid", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def scan(texts: DataFrame, lengths: list[int] | None, bits: np.ndarray | None, gram: int, window: int) -> DataFrame:
    """``texts(uid, id, text)`` -> (uid, id, n_words, prints): the fingerprints of windows of ``lengths`` words that ``bits`` may hold.

    Without ``lengths`` a text's windows are those of an item: ``window`` words, or all of fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                data, starts, ends, bounds = word_spans(part.column("text"))
                counts = np.diff(bounds)
                text_of = np.repeat(np.arange(len(counts)), counts)
                hashes = span_hashes(data, starts, ends)
                prints: list[list[tuple]] = [[] for _ in counts]
                own = np.minimum(counts, window)
                for length in lengths if lengths is not None else np.unique(own[own > 0]).tolist():
                    chosen, found = winnow(hashes, bounds, length, gram)
                    if lengths is None:
                        mine = own[text_of[chosen]] == length
                        chosen, found = chosen[mine], found[mine]
                    if bits is not None:
                        held = np.ones(len(found), bool)
                        for place in filter_places(found, len(bits)):
                            held &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                        chosen, found = chosen[held], found[held]
                    for p, row in zip(chosen.tolist(), _contexts(data, starts, ends, bounds, text_of, chosen, found, length, gram), strict=True):
                        prints[text_of[p]].append(row)
                listed = pa.array([[dict(zip(_PRINT.names, r, strict=True)) for r in x] for x in prints], pa.list_(_PRINT))
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array(counts), listed], ["uid", "id", "n_words", "prints"])

    return map_texts(texts, run, f"uid long, id long, n_words long, prints array<struct<{', '.join(x.replace(' ', ':', 1) for x in CONTEXT.split(', '))}>>")


def filter_places(prints: np.ndarray, words: int) -> list[np.ndarray]:
    """The two bit places of each fingerprint in a filter of so many 64-bit words (a power of two)."""
    mask = np.uint64(64 * words - 1)
    return [prints & mask, (prints >> np.uint64(32)) & mask]


def bit_filter(prints: DataFrame) -> np.ndarray:
    """A two-hash bit filter of ``prints(fp)``: 64 bits an entry up to FILTER_BITS, gathered in parts of PART_WORDS words."""
    n = prints.select("fp").distinct().count()
    bits = min(FILTER_BITS, 1 << max(12, (64 * n - 1).bit_length() if n else 12))
    places = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1))))
    one = prints.select(places.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = one.groupBy("word").agg(F.bit_or("bit").alias("bit")).withColumn("part", F.shiftright("word", PART_WORDS.bit_length() - 1))

    def pack(group: pa.Table) -> pa.Table:
        held = np.zeros(PART_WORDS, np.int64)
        held[group["word"].to_numpy() % PART_WORDS] = group["bit"].to_numpy()
        return pa.table({"part": group["part"].slice(0, 1), "held": pa.array([held.tobytes()], pa.binary())})

    out = np.zeros(max(bits // 64, PART_WORDS), np.uint64)
    for part, held in words.groupBy("part").applyInArrow(pack, "part long, held binary").collect():
        out[part * PART_WORDS : (part + 1) * PART_WORDS] = np.frombuffer(held, np.uint64)
    return out[: bits // 64]


def _agreeing(one: str, other: str):
    """Leading elements that two word arrays share."""
    same = F.zip_with(one, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first.cast("int") - 1)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of ``docs(doc_id, text)``.

    A window is ``window`` consecutive words of an item of ``items(item_id, text)``, or all words of
    a shorter one; a word of a document inside any occurrence of a window is hit.  ``spans`` are the
    disjoint hit word ranges (lo, hi), hi excluded.  contaminated: some word is hit and
    ``share * n_hit >= n_words``.

    Null, empty and wordless texts have no words and no hits; wordless items never match; an item
    without id hits words but isn't listed; repeated rows are each judged; no documents give no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("id"), "text")
    return _verdicts(rows, items, window, gram, share).drop("uid")


def _verdicts(rows: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = 20) -> DataFrame:
    """The columns of ``contamination`` and the uid of each row of ``rows(uid, id, text)``."""
    items = items.select(F.lit(0).cast("long").alias("uid"), F.col("item_id").cast("long").alias("id"), "text")
    own = scan(items, None, None, gram, window).select(F.col("id").alias("item_id"), F.explode("prints").alias("p")).select("item_id", "p.*")
    own = Table(own.distinct(), "items").df
    lengths = sorted(r[0] for r in own.select("length").distinct().collect())  # 1 .. window
    bits = bit_filter(own)
    seen = Table(scan(rows, lengths, bits, gram, window), "prints").df
    found = seen.where(F.size("prints") > 0).select("uid", F.explode("prints").alias("p")).select("uid", "p.*")
    # Items that share a fingerprint's whole context are one context until it is verified.
    parts = ["fp", "length", "mid", "before", "after"]
    named = own.withColumn("context", F.sha2(F.to_json(F.struct(*parts)), 256))
    contexts = named.select("context", "fp", "length", "mid", F.col("before").alias("item_before"), F.col("after").alias("item_after")).distinct()
    found, contexts = spread(found, contexts, ["fp", "length", "mid"], "uid")
    both = found.join(contexts, ["fp", "length", "mid", "salt"])
    k = F.least(F.lit(gram), F.col("length"))
    back, ahead = _agreeing("before", "item_before"), _agreeing("after", "item_after")
    hits = both.select("uid", "context", "length", (F.col("pos") - back).alias("lo"), (F.col("pos") + k + ahead).alias("hi")).where(F.col("hi") - F.col("lo") >= F.col("length"))
    hits = Table(hits.select("uid", "context", "lo", "hi").distinct(), "hits").df
    in_order = Window.partitionBy("uid").orderBy("lo", "hi")
    reached = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = hits.select("uid", "lo", "hi").distinct().withColumn("fresh", F.coalesce(F.col("lo") > reached, F.lit(True)))
    ranges = ranges.withColumn("nth", F.sum(F.col("fresh").cast("int")).over(in_order)).groupBy("uid", "nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    each = ranges.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    one, other = spread(hits.select("uid", "context").distinct(), named.select("context", F.col("item_id").cast("string").alias("item")).distinct(), ["context"], "uid")
    listed = one.join(other, ["context", "salt"]).groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = each.join(listed, "uid")
    out = seen.select("uid", F.col("id").alias("doc_id"), "n_words").join(each, "uid", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"]), F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("uid", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    return out.select("uid", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, keep_without_id: bool = True) -> DataFrame:
    """``docs`` without the rows whose own text is contaminated; those without doc_id stay unless ``keep_without_id`` is false.

    Rows are judged one by one, repeated ones each; null, empty and wordless texts stay; without items, or
    with an empty table, nothing goes; other columns may have any name.
    """
    numbered = Table(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered").df
    gone = _verdicts(numbered.select(F.col(ROW).alias("uid"), F.col("doc_id").cast("long").alias("id"), "text"), items).where("contaminated")
    gone = gone.where("doc_id is not null") if keep_without_id else gone
    return numbered.join(Table(gone.select(F.col("uid").alias(ROW)), "contaminated").df, ROW, "left_anti").select(docs.columns)
