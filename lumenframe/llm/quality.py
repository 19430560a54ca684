"""Document quality: attention-based multiple-instance learning over passages.

A document is the bag of its passages (runs of ``PASSAGE`` words).  Each passage is encoded by how
its bytes, byte pairs and words look; gated attention, learned with the document labels alone, weighs
the passages' representations, and their weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, keep_rows, labelled_sample, sigmoid
from .words import blocks, buffers, map_texts, split, string_hashes

PASSAGE = 48
PER_CLASS = 2000
THRESHOLD = 0.3
BUCKETS = 48
#: Byte classes: white space, a-z, A-Z, 0-9, other ASCII, non-ASCII.
_CLASS = np.full(256, 4, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
WIDTH = 36 + BUCKETS + 8


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each text's passages, a row of WIDTH features a passage); a text without words is one passage of zeros."""
    bounds, flat = split(texts)
    counts = np.diff(bounds)
    per = np.maximum(-(-counts // PASSAGE), 1)
    cuts = np.concatenate(([0], np.cumsum(per)))
    n = int(cuts[-1])
    doc = np.repeat(np.arange(len(counts)), counts)
    words = np.arange(len(flat))
    owner = cuts[doc] + (words - bounds[doc]) // PASSAGE
    held = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float64)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(flat):
        return cuts, out
    offsets, data = buffers(flat)
    lengths = np.diff(offsets)
    of_byte = np.repeat(owner, lengths)
    kind = _CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[offsets[:-1]] = True
    before = np.concatenate(([0], kind[:-1]))
    before[begins] = 0
    size = np.maximum(np.bincount(of_byte, minlength=n), 1).astype(np.float64)
    out[:, :36] = np.sqrt(np.bincount(of_byte * 36 + before * 6 + kind, minlength=36 * n).reshape(n, 36) / size[:, None])
    low = np.where(kind == 2, data + 32, data).astype(np.uint32)
    two = (np.concatenate(([0], low[:-1])).astype(np.uint32) * ~begins) * np.uint32(2654435761) + low * np.uint32(40503)
    out[:, 36 : 36 + BUCKETS] = np.sqrt(np.bincount(of_byte * BUCKETS + ((two >> np.uint32(11)) % BUCKETS).astype(np.int64), minlength=BUCKETS * n).reshape(n, BUCKETS) / size[:, None])
    h = string_hashes(flat)
    rows = out[:, 36 + BUCKETS :]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    rows[:, 0] = np.bincount(owner, again, n) / held
    rows[:, 1] = _distinct(h, owner, (words - bounds[doc]) % PASSAGE, n) / held
    rows[:, 2] = np.bincount(owner, lengths, n) / held / 10
    rows[:, 3] = np.bincount(owner, lengths == 1, n) / held
    rows[:, 4] = np.log1p(np.bincount(owner, minlength=n)) / 4
    rows[:, 5] = (np.repeat(counts, per) > 0) * np.log1p(np.repeat(counts, per)) / 10
    rows[:, 6] = np.bincount(owner, kind[offsets[1:] - 1] == 4, n) / held
    rows[:, 7] = np.bincount(owner, kind[offsets[:-1]] == 2, n) / held
    return cuts, out


def _distinct(h: np.ndarray, owner: np.ndarray, place: np.ndarray, n: int, step: int = 16384) -> np.ndarray:
    """How many different hashes each passage has; ``owner`` is sorted and ``place`` is a word's place in its passage."""
    out = np.zeros(n, np.int64)
    for lo in range(0, n, step):
        a, b = np.searchsorted(owner, (lo, lo + step))
        table = np.full((min(step, n - lo), PASSAGE), np.uint64(2**64 - 1))
        table[owner[a:b] - lo, place[a:b]] = h[a:b]
        table.sort(axis=1)
        filled = np.bincount(owner[a:b] - lo, minlength=len(table))
        fresh = np.ones(table.shape, bool)
        fresh[:, 1:] = table[:, 1:] != table[:, :-1]
        out[lo : lo + len(table)] = (fresh & (np.arange(PASSAGE) < filled[:, None])).sum(axis=1)
    return out


@dataclass
class AttentionModel:
    """Weights of the encoder (E), the gated attention (V, U, w) and the scorer (c, b); mean and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    part: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    def forward(self, x: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers' values for bags of passages; every bag has a passage."""
        p = self.part
        x = (x - self.mean) * self.scale
        e = np.tanh(x @ p["E"] + p["e"])
        a, g = np.tanh(e @ p["V"]), sigmoid(e @ p["U"]).astype(e.dtype)
        s = (a * g) @ p["w"]
        starts, sizes = cuts[:-1], np.diff(cuts)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        s = s / np.repeat(np.add.reduceat(s, starts), sizes)
        bag = np.add.reduceat(s[:, None] * e, starts, axis=0)
        return {"x": x, "e": e, "a": a, "g": g, "s": s, "bag": bag, "logit": bag @ p["c"] + p["b"]}

    def gradient(self, x: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """The gradient of the mean logistic loss of bags labelled ``y``, and the loss."""
        p, f, sizes = self.part, self.forward(x, cuts), np.diff(cuts)
        d = ((sigmoid(f["logit"]) - y) / len(y)).astype(f["e"].dtype)
        grad = {"c": f["bag"].T @ d, "b": d.sum()}
        of = np.repeat(d, sizes)[:, None] * p["c"]
        back = (of * f["e"]).sum(axis=1)  # d loss / d attention
        ds = f["s"] * (back - np.repeat(np.add.reduceat(f["s"] * back, cuts[:-1]), sizes))
        grad["w"] = (f["a"] * f["g"]).T @ ds
        dg = ds[:, None] * p["w"]
        da, du = dg * f["g"] * (1 - f["a"] ** 2), dg * f["a"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["e"].T @ da, f["e"].T @ du
        de = (f["s"][:, None] * of + da @ p["V"].T + du @ p["U"].T) * (1 - f["e"] ** 2)
        grad["E"], grad["e"] = f["x"].T @ de, de.sum(axis=0)
        return grad, float(np.logaddexp(0, np.where(y == 1, -f["logit"], f["logit"])).mean())

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.part:
            return sigmoid(np.full(len(texts), self.shift))
        cuts, x = passages(texts)
        return sigmoid(self.forward(x, cuts)["logit"].astype(np.float64) + self.shift)

    def attention(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, weight of each passage); the weights of a text sum to 1."""
        cuts, x = passages(texts)
        return cuts, self.forward(x, cuts)["s"]


def fit_attention(bags: list[np.ndarray], y: np.ndarray, shift: float = 0.0, hidden: int = 24, gates: int = 12, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 11) -> AttentionModel:
    """Adam on the logistic loss of whole documents.  Without both classes every score is the share of ones."""
    if len(y) == 0 or y.min() == y.max():
        return AttentionModel(np.zeros(0), np.zeros(0), shift=0.0 if len(y) == 0 else 9.0 * (2 * int(y[0]) - 1))
    everything = np.concatenate(bags).astype(np.float64)
    mean, spread = everything.mean(axis=0), everything.std(axis=0)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    part = {"E": draw(WIDTH, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gates), "U": draw(hidden, gates), "w": draw(gates), "c": draw(hidden), "b": np.zeros((), np.float32)}
    model = AttentionModel(mean.astype(np.float32), (1 / np.maximum(spread, 0.02)).astype(np.float32), part)
    first = {k: np.zeros_like(v) for k, v in part.items()}
    second = {k: np.zeros_like(v) for k, v in part.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            cuts = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
            grad, _ = model.gradient(np.concatenate([bags[i] for i in pick]), cuts, y[pick])
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k in part:
                g = grad[k] + (1e-4 * part[k] if k in ("E", "V", "U", "c") else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                part[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.shift = shift
    return model


def train_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> AttentionModel:
    """Learns ``labels(doc_id, quality)`` from at most ``per_class`` rows a class that are not held out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                cuts, x = passages(part.column("text"))
                rows = [x[a:b].astype("<f2").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "encoded"])

    rows, y, shift = labelled_sample(docs, labels, "quality", modulus, held, per_class, lambda d: map_texts(d, encode, "doc_id long, encoded binary"))
    return fit_attention([np.frombuffer(x, "<f2").reshape(-1, WIDTH).astype(np.float32) for x in rows], y, shift)


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """(doc_id, score) of every row's whole text; null, empty and blank texts are scored as one empty passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")), pa.float64())], ["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``; other columns are ignored.

    Without usable labels all scores are 0.5.  Repeated rows are each scored; no rows give none.
    """
    scored = score_quality(docs, train_quality(docs, labels, modulus, held))
    return scored.select("doc_id", held_out(modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that quality() predicts as 1, with all their columns, of any names.

    Null and empty texts are scored as one empty passage; without usable labels all rows stay.
    """
    model = train_quality(docs, labels, modulus, held)
    return keep_rows(docs, model.scores, lambda s: s >= threshold)
