"""Language identification: a bidirectional gated recurrent network over bytes.

Every byte position gets label probabilities from the hidden states of both directions; a document's
probabilities are the means over all its positions.  So that a long text doesn't run alone, byte after
byte, it is cut into spans of ``INNER`` bytes that run side by side: each is read together with the
``MARGIN`` bytes before and after it, which bring the states up, and only the span's own positions
count.  Training is plain numpy: backpropagation through time with Adam on the mean cross entropy of
positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, remainder
from .words import blocks, buffers, map_texts

INNER = 192
MARGIN = 32
#: The same of the spans that training draws.
TRAIN_INNER = 64
TRAIN_MARGIN = 16
HIDDEN = 8
#: Spans that run side by side: their states fit a core's cache.
SIDE = 2048
#: Rows of each language, bytes of texts, and languages (the most frequent ones) that training takes at most.
PER_LANGUAGE = 400
TRAIN_BYTES = 16 << 20
MOST_LANGUAGES = 1024


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category; digits, numerals and fractions are none."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Spans:
    """Spans as rows of bytes, padded after ``real`` bytes, whose columns ``lo`` to ``hi`` are the span's own; ``owner`` is its text."""

    rows: np.ndarray
    real: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    owner: np.ndarray

    def take(self, pick: np.ndarray) -> Spans:
        """Some of the spans, in rows as long as the longest of them."""
        real = self.real[pick]
        return Spans(self.rows[pick, : int(real.max(initial=0))], real, self.lo[pick], self.hi[pick], self.owner[pick])

    @property
    def own(self) -> np.ndarray:
        """(position, span): whether the position counts."""
        at = np.arange(self.rows.shape[1])[:, None]
        return (at >= self.lo) & (at < self.hi)


def spans(texts: pa.Array, inner: int = INNER, margin: int = MARGIN) -> Spans:
    """The spans of A-Z-lowered texts; null and empty texts have none."""
    offsets, data = buffers(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = np.diff(offsets)
    per = -(-sizes // inner)
    cuts = np.concatenate(([0], np.cumsum(per)))
    owner = np.repeat(np.arange(len(sizes)), per)
    begin = (np.arange(cuts[-1]) - cuts[owner]) * inner
    end = np.minimum(begin + inner, sizes[owner])
    first, last = np.maximum(begin - margin, 0), np.minimum(end + margin, sizes[owner])
    real = last - first
    width = int(real.max(initial=0))
    at = np.arange(width)
    inside = at < real[:, None]
    source = np.minimum((offsets[owner] + first)[:, None] + at, max(len(data) - 1, 0))
    rows = np.where(inside, data[source] if len(data) else 0, 0).astype(np.uint8)
    return Spans(rows, real, begin - first, end - first, owner)


@dataclass
class ByteGRU:
    """For each direction d: input rows X_d (a row a byte: update, reset, candidate), recurrent U_d; scorer O, o."""

    labels: list[str]
    part: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(labels: list[str], seed: int = 5, hidden: int = HIDDEN) -> ByteGRU:
        rng = np.random.default_rng(seed)
        part = {}
        for d in "fb":
            part["X" + d] = (0.3 * rng.standard_normal((256, 3 * hidden))).astype(np.float32)
            part["U" + d] = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        part["O"] = (rng.standard_normal((len(labels), 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        part["o"] = np.zeros(len(labels), np.float32)
        return ByteGRU(labels, part)

    def states(self, rows: np.ndarray, real: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """Hidden states (position, hidden, span) of one direction, 0 after a span's end; ``kept`` gets what backpropagation needs."""
        table, u = np.ascontiguousarray(self.part["X" + d].T), self.part["U" + d]
        n, h = u.shape[1], np.zeros((u.shape[1], len(rows)), np.float32)
        out = np.empty((rows.shape[1], n, len(rows)), np.float32)
        steps = range(rows.shape[1]) if d == "f" else range(rows.shape[1] - 1, -1, -1)
        columns = np.ascontiguousarray(rows.T)
        shortest = int(real.min(initial=rows.shape[1]))
        for t in steps:
            x = np.take(table, columns[t], axis=1)
            v = u @ h
            gates = np.tanh(0.5 * (x[: 2 * n] + v[: 2 * n]))
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            c = np.tanh(x[2 * n :] + r * v[2 * n :])
            if kept is not None:
                kept.append((t, h, v, z, r, c))
            h = h + z * (c - h)
            if t >= shortest:
                h = h * (t < real)
            out[t] = h
        return out

    def probabilities(self, rows: np.ndarray, real: np.ndarray, both: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """(position, label, span) probabilities."""
        forward, backward = both or (self.states(rows, real, "f"), self.states(rows, real, "b"))
        n = forward.shape[1]
        p = np.matmul(self.part["O"][:, :n], forward)
        p += np.matmul(self.part["O"][:, n:], backward)
        p += self.part["o"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """(text, label): mean probabilities over all byte positions; zeros for an empty text."""
        every = spans(texts)
        total = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(every.real, kind="stable")  # so that short spans run with short ones
        for k in range(0, len(order), SIDE):
            part = every.take(order[k : k + SIDE])
            p = self.probabilities(part.rows, part.real)
            p *= part.own[:, None, :]
            sums = p.sum(axis=0, dtype=np.float64)
            for label in range(len(self.labels)):
                total[:, label] += np.bincount(part.owner, sums[label], len(texts))
        size = pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False)
        return total / np.maximum(size, 1)[:, None]

    def gradient(self, rows: np.ndarray, real: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean cross entropy of unmasked positions; mask is (position, span)."""
        kept = {"f": [], "b": []}
        both = tuple(self.states(rows, real, d, kept[d]) for d in "fb")
        p = self.probabilities(rows, real, both)
        scale = (mask / mask.sum()).astype(np.float32)
        at = np.arange(len(y))
        loss = -float((np.log(p[:, y, at] + 1e-12) * scale).sum())
        p[:, y, at] -= 1
        p *= scale[:, None, :]
        n = both[0].shape[1]
        grad = {"o": p.sum(axis=(0, 2)), "O": np.concatenate([np.einsum("tlw,thw->lh", p, x, optimize=True) for x in both], axis=1)}
        columns = np.ascontiguousarray(rows.T)
        for d, o in (("f", self.part["O"][:, :n]), ("b", self.part["O"][:, n:])):
            u = self.part["U" + d]
            gu, dh = np.zeros_like(u), np.zeros((n, len(rows)), np.float32)
            into = np.zeros((3 * n, *columns.shape), np.float32)
            for t, before, v, z, r, c in reversed(kept[d]):
                dh = (dh + o.T @ p[t]) * (t < real)
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                dr = dc * v[2 * n :] * r * (1 - r)
                into[:, t] = np.concatenate((dz, dr, dc))
                dv = np.concatenate((dz, dr, dc * r))
                gu += dv @ before.T
                dh = dh * (1 - z) + u.T @ dv
            flat = columns.reshape(-1)
            grad["X" + d] = np.stack([np.bincount(flat, x.reshape(-1), 256) for x in into], axis=1).astype(np.float32)
            grad["U" + d] = gu
        return grad, loss


def fit_bytes(every: Spans, y: np.ndarray, labels: list[str], steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 5) -> ByteGRU:
    """Adam on spans drawn evenly over languages; ``y`` has the label of each text."""
    model = ByteGRU.fresh(labels, seed)
    rng = np.random.default_rng(seed)
    of = y[every.owner]
    groups = [g for g in (np.flatnonzero(of == k) for k in range(len(labels))) if len(g)]
    first = {k: np.zeros_like(v) for k, v in model.part.items()}
    second = {k: np.zeros_like(v) for k, v in model.part.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])
        part = every.take(pick)
        grad, _ = model.gradient(part.rows, part.real, part.own, of[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = (g / max(1.0, size)).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            now = rate * (1 - step / (steps + 1))
            model.part[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train_langid(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = PER_LANGUAGE, label: str = "lang", most_bytes: int = TRAIN_BYTES) -> ByteGRU | None:
    """Learns from whole texts of at most ``per_language`` rows of each language that are not held out and have a letter.

    The rows are the first of each language by a hash of doc_id (equal rows count once) whose texts
    still fit into that language's share of ``most_bytes``; only the MOST_LANGUAGES most frequent
    languages are learned.  None if no row can be learned from.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(label).cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(remainder(modulus) != held, F.lit(False)))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    cut = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(int(min(1.0, 1.3 * per_language / r["count"]) * (1 << 30))))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut[F.col("lang")])

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(x.as_py()) for x in batch.column("text")], pa.bool_()))

    drawn = map_texts(drawn, lettered, "doc_id long, text string, lang string")
    drawn = drawn.select(F.xxhash64("doc_id", "lang", "text").alias("uid"), F.xxhash64("doc_id").alias("h"), "lang", F.octet_length("text").alias("n"), "text")
    known = drawn.select("uid", "h", "lang", "n").distinct().orderBy("h", "uid").limit(2 * per_language * len(counts)).collect()
    labels = sorted({r.lang for r in known})
    room, places, taken = {x: most_bytes // max(1, len(labels)) for x in labels}, dict.fromkeys(labels, per_language), {}
    for r in known:
        if places[r.lang] and r.n <= room[r.lang]:
            places[r.lang] -= 1
            room[r.lang] -= r.n
            taken[r.uid] = labels.index(r.lang)
    if not taken:
        return None
    # At most per_language rows a language and most_bytes of texts.
    uids = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in taken], "uid long"))
    found = drawn.join(uids, "uid").groupBy("uid").agg(F.min("text").alias("text")).orderBy("uid").collect()
    every = spans(pa.array([r.text for r in found]), TRAIN_INNER, TRAIN_MARGIN)
    return fit_bytes(every, np.array([taken[r.uid] for r in found]), labels)


def language(docs: DataFrame, modulus: int = 4, held: int = 2, label: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs(doc_id, text, lang)``.

    A null text or one without a letter (Unicode category L) is ``und`` with score 0, as is every text if
    nothing could be learned; score is otherwise the mean probability of the predicted language.  Repeated rows are
    each judged; other columns are ignored; no rows give none.
    """
    model = train_langid(docs, modulus, held, label=label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                texts = part.column("text")
                known = np.array([bool(model) and has_letter(x.as_py()) for x in texts], bool)
                names, scores = ["und"] * len(known), np.zeros(len(known))
                if known.any():
                    p = model.pooled(texts)
                    best = p.argmax(axis=1)
                    names = [model.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                    scores = np.where(known, np.minimum(p[np.arange(len(best)), best], 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    scored = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(modulus, held).alias("held_out"), "lang_pred", "score")
