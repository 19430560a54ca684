"""Bounded training samples of labelled documents, and the train / held-out split by doc_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Table
from .words import blocks, map_texts

#: Bytes of encoded texts that a classifier's training sample takes at most.
SAMPLE_BYTES = 32 << 20


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(modulus: int, held: int, id_col: str = "doc_id") -> Column:
    """Whether labels of this id may not be learned; a null id can't be labelled and is not held out."""
    return F.coalesce(remainder(modulus, id_col) == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, encode: Callable[[DataFrame], DataFrame], most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray, float]:
    """(encoded texts, labels 0 / 1, log odds to add for the true class shares) of a bounded training sample.

    At most ``per_class`` labelled documents of each class, in the order of a hash of their ids, none of
    them held out; of these, in the same order, those whose encoded texts still fit into ``most_bytes``
    together.  ``encode`` makes (doc_id, encoded binary) of (doc_id, text).  Labels other than 0 and 1,
    labels of documents that aren't there and documents labelled both 0 and 1 count for nothing; a
    repeated label counts once, and of a repeated doc_id one text is taken.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(modulus, held) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    usable = Table(usable.join(there, "doc_id", "left_semi"), "labels").df
    share = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    mark = {}
    for y in (0, 1):
        rows = usable.where(F.col("label") == y).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(per_class).collect()
        mark |= {r.doc_id: y for r in rows}
    ids = docs.sparkSession.createDataFrame([(x,) for x in mark], "doc_id long")
    # At most 2 * per_class ids, so the broadcast is bounded.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    sample = Table(encode(chosen).groupBy("doc_id").agg(F.min("encoded").alias("encoded")), "sample")
    fits, held_bytes = [], 0
    for r in sample.df.select("doc_id", F.octet_length("encoded").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        if held_bytes + r.n <= most_bytes:
            fits.append((r.doc_id,))
            held_bytes += r.n
    taken = F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long"))
    found = sorted(((r.doc_id, bytes(r.encoded)) for r in sample.df.join(taken, "doc_id").toLocalIterator()), key=lambda x: x[0])
    sample.drop()
    y = np.array([mark[i] for i, _ in found], np.int64)
    ones, zeros = int(y.sum()), int((1 - y).sum())
    shift = np.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 0.5)) - np.log((ones + 0.5) / (zeros + 0.5))
    return [x for _, x in found], y, float(shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, np.float64)))


def keep_rows(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text's score ``keep`` accepts, all columns as they are; no shuffle.

    Null and empty texts are scored like any other, repeated rows each; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield part.filter(pa.array(keep(score(part.column("text")))))

    return map_texts(docs, run, docs.schema)
