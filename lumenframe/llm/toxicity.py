"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its words, of neighbouring words and of words one apart, each
counted once.  Callers may add ``stems``, the first so many bytes of longer words, by which inflected
forms not seen in training count too; the registered queries and the pipeline don't.  The L1 term of FTRL
leaves few non-zero weights, which is all that executors get; scoring drops every feature without one
before it is counted once a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import word_spans
from .labelled import held_out, keep_rows, labelled_sample, sigmoid
from .words import blocks, map_texts, mix, span_hashes

BITS = 20
#: Labelled rows of each class that training takes at most.
PER_CLASS = 4000
THRESHOLD = 0.3


def features(texts: pa.Array, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(text position, feature) of every word, word pair and skip pair, and stem if asked for, repeats included."""
    data, starts, ends, bounds = word_spans(texts)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = span_hashes(data, starts, ends)
    owners, found = [doc], [h]
    for size in stems:
        long = ends - starts > size
        owners.append(doc[long])
        found.append(mix(span_hashes(data, starts[long], starts[long] + size) + np.uint64(size)))
    for gap, seed in ((1, 0x51), (2, 0x52)):
        same = doc[gap:] == doc[:-gap]
        owners.append(doc[gap:][same])
        found.append(mix((h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(seed))[same]))
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.uint32)


def once(owners: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of each text once."""
    both = np.unique((owners.astype(np.uint64) << np.uint64(32)) | found)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class SparseModel:
    """Non-zero weights by feature, the intercept, the stems that are features, and whether there were labels at all."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    stems: tuple[int, ...] = ()
    learned: bool = True

    def margins(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.index] = self.weight
        owners, found = features(texts, self.stems)
        live = dense[found] != 0
        owners, found = once(owners[live], found[live])
        return np.bincount(owners, dense[found], len(texts)) + self.bias


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, shift: float = 0.0, alpha: float = 3.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = 8, seed: int = 7) -> SparseModel:
    """FTRL-proximal over rows of distinct features; each coordinate has its own learning rate.

    ``shift`` is added to the intercept.  Without rows of both classes every score is the share of ones.
    """
    if len(y) == 0 or y.min() == y.max():
        return SparseModel(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0 if len(y) == 0 else 9.0 * (2 * int(y[0]) - 1), learned=len(y) > 0)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        kept = np.maximum(np.abs(z[at]) - np.where(at == 1 << BITS, 0.0, l1), 0.0)
        return -np.sign(z[at]) * kept / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at = np.append(rows[i].astype(np.int64), 1 << BITS)  # the last is the intercept
            w = weights(at)
            g = float(sigmoid(w.sum())) - y[i]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1])
    return SparseModel(index, w[index].astype(np.float32), float(w[-1]) + shift)


def train_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = PER_CLASS, stems: tuple[int, ...] = ()) -> SparseModel:
    """Learns ``labels(doc_id, toxic)`` from at most ``per_class`` rows a class that are not held out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                owners, found = once(*features(part.column("text"), stems))
                cuts = np.searchsorted(owners, np.arange(1, part.num_rows))
                rows = [x.astype("<u4").tobytes() for x in np.split(found, cuts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "encoded"])

    rows, y, shift = labelled_sample(docs, labels, "toxic", modulus, held, per_class, lambda d: map_texts(d, encode, "doc_id long, encoded binary"))
    model = fit_ftrl([np.frombuffer(x, "<u4") for x in rows], y, shift)
    model.stems = stems
    return model


def score_toxicity(docs: DataFrame, model: SparseModel) -> DataFrame:
    """(doc_id, score) of every row's whole text; a null, empty or wordless text scores the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(model.margins(part.column("text"))))], ["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD, stems: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``; other columns are ignored.

    Without usable labels all scores are 0.5.  Repeated rows are each scored; no rows give none.
    """
    scored = score_toxicity(docs, train_toxicity(docs, labels, modulus, held, stems=stems))
    return scored.select("doc_id", held_out(modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that toxicity() predicts as 0, with all their columns, of any names.

    Null, empty and wordless texts score the intercept; without usable labels nothing is rejected.
    """
    model = train_toxicity(docs, labels, modulus, held)
    return keep_rows(docs, lambda texts: sigmoid(model.margins(texts)), lambda s: s < threshold) if model.learned else docs
