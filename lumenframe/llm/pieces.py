"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text, with one space put before it, is cut before every run of spaces; no piece of the vocabulary
reaches across such a cut, so the lattice of the text is the chain of its segments' lattices and
sampling segment by segment samples the text.  The forward pass gives every position of every
distinct segment the log weight of all its segmentations; the backward pass draws, from a segment's
end to its start, each last piece with its share of that weight.  The draw of a position depends on the
row's key and the position alone, so a row gets the same pieces in any partition and on any retry.

A long segment is filtered a chunk at a time and isn't remembered.  The spans of a chunk are filtered
side by side from guessed weights before them, then again from the weights their predecessors ended
with, until those stay the same; what was guessed is forgotten within a span, so that two rounds do
as a rule.  Every position of a chunk draws its last piece at once, and the path is followed back.

A character without a piece goes byte by byte; so does a literal U+2581, which in pieces stands for
the space.  Decoding joins the pieces' bytes and takes the first space off, and so restores the text.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trie import ByteTrie
from .words import blocks, buffers, map_texts, mix

SEED = 2024
#: Weight of a piece: (2 + its rank among merges) ** -THETA; larger is closer to the best segmentation.
THETA = 1.0
BLOCK = 512 << 10
#: Bytes of segments that are filtered together, and segments that a worker remembers before it starts anew.
PART = 32 << 10
REMEMBERED = 60_000
REMEMBERED_EDGES = 2 << 20
#: A segment of more bytes is filtered alone; bytes of a span of it; how far weights before a span may be off.
LONG = 256
SPAN = 512
EXACT = 1e-10
_GOLD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 / golden ratio


class Column:
    """A growing array."""

    def __init__(self, kind: type):
        self._data, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self._data):
            self._data = np.concatenate((self._data, np.zeros(len(self._data) // 2, self._data.dtype)))
        self._data[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._data[: self.size]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _choose(first: np.ndarray, last: np.ndarray, share: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edge that u draws among the edges first .. last of each node, by their shares."""
    edge, u = first.copy(), u.copy()
    open_ = np.flatnonzero(edge < last)
    while len(open_):
        p = share[edge[open_]]
        over = u[open_] >= p
        open_, p = open_[over], p[over]
        u[open_] -= p
        edge[open_] += 1
        open_ = open_[edge[open_] < last[open_]]
    return edge


def _uniform(stream: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each place of a stream."""
    return (mix(stream + (place + 1).astype(np.uint64) * _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class PieceLattice:
    """The vocabulary of a SentencePiece model as a byte trie with log weights."""

    def __init__(self, model_file: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.byte_id = np.full(256, -1, np.int64)
        raw = [b""] * n
        entries, ids, weights = [], [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {i} reaches across a segment's start")
                raw[i] = piece.replace("▁", " ").encode()
                entries.append(raw[i])
                ids.append(i)
                weights.append(-theta * np.log(2.0 - min(0.0, model.get_score(i))))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        self.trie = ByteTrie(entries)
        self.ids, self.weights = np.array(ids, np.int64), np.array(weights)
        self.byte_weight = float(self.weights.min())
        self.longest = max(map(len, entries))
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def edges(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first edge of each node, and of each edge its last byte, first byte, piece id and log weight), by last byte."""
        size = len(data)
        sizes = np.diff(offsets)
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        end_of = np.repeat(offsets[1:], sizes)
        # All pieces of all positions: a position walks the trie until it has no child.
        ends, starts, names, logs = [], [], [], []
        covered = np.zeros(size, bool)  # lead bytes of characters that are a piece
        at = np.flatnonzero(lead)
        state = np.zeros(len(at), np.int64)
        step = 0
        begin = at
        while len(at):
            state = self.trie.child(state, data[at])
            live = state >= 0
            at, state, begin = at[live], state[live], begin[live]
            step += 1
            value = self.trie.value[state]
            whole = np.flatnonzero(value >= 0)
            ends.append(at[whole])
            starts.append(begin[whole])
            names.append(self.ids[value[whole]])
            logs.append(self.weights[value[whole]])
            covered[begin[whole][width[begin[whole]] == step]] = True
            more = at + 1 < end_of[at]
            at, state, begin = at[more] + 1, state[more], begin[more]
        owner = np.cumsum(lead) - 1  # a byte's character
        bare = np.flatnonzero(~covered[np.flatnonzero(lead)][owner]) if size else np.zeros(0, np.int64)
        ends.append(bare)
        starts.append(bare)
        names.append(self.byte_id[data[bare]])
        logs.append(np.full(len(bare), self.byte_weight))
        end, start, name, log = (np.concatenate(x) for x in (ends, starts, names, logs))
        order = np.argsort(end, kind="stable")  # a node's edges: shortest piece first, its byte last
        end, start, name, log = end[order], start[order], name[order], log[order]
        return np.searchsorted(end, np.arange(size + 1)), end, start, name, log

    def lattice(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filter of all segments at once.

        Returns (edges of each node, edge lengths in bytes, edge piece ids, edge probabilities); the nodes
        are the bytes of ``data``, node k standing for the position after byte k; the edges of a node
        are the pieces that may come last before it, with their shares of its weight.
        """
        size, sizes = len(data), np.diff(offsets)
        first, end, start, name, log = self.edges(offsets, data)
        # Nodes by their distance from their segment's start: all nodes of one distance at once.
        count = np.diff(first)
        depth = np.arange(size) - np.repeat(offsets[:-1], sizes)
        by_depth = np.argsort(depth, kind="stable")
        level = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=-1)) + 2))
        total = np.zeros(size)
        share = np.zeros(len(end))
        for k in range(len(level) - 1):
            nodes = by_depth[level[k] : level[k + 1]]
            nodes = nodes[count[nodes] > 0]
            total_k = count[nodes]
            edges = ragged(first[nodes], total_k)
            cuts = np.cumsum(total_k) - total_k
            before = start[edges]
            w = log[edges] + np.where(depth[before] > 0, total[before - 1], 0.0)
            if not len(cuts):
                continue
            top = np.maximum.reduceat(w, cuts)
            p = np.exp(w - np.repeat(top, total_k))
            sums = np.add.reduceat(p, cuts)
            total[nodes] = top + np.log(sums)
            share[edges] = p / np.repeat(sums, total_k)
        return count, end - start + 1, name, share

    def _chunk(self, data: np.ndarray, lo: int, hi: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first edges, lengths, ids, shares) of the bytes lo .. hi - 1 of one segment, and the weights of its last ``longest`` nodes.

        ``before``: those of the nodes before it; both cuts are between characters.
        """
        reach = self.longest
        back = max(0, lo - reach)
        while back < lo and data[back] & 0xC0 == 0x80:
            back += 1
        _, end, start, name, log = self.edges(np.array([0, hi - back]), data[back:hi])
        mine = end >= lo - back
        end, start, name, log = end[mine] - (lo - back), start[mine] - (lo - back), name[mine], log[mine]
        size = hi - lo
        first = np.searchsorted(end, np.arange(size + 1))
        count = np.diff(first)
        n_spans = -(-size // SPAN)
        weight = np.full((n_spans, reach + SPAN), -np.inf)
        share = np.zeros(len(end))
        used = np.zeros((n_spans, reach))  # a guess: all weights alike
        used[0] = before
        todo = np.arange(n_spans)
        while len(todo):
            weight[todo, :reach] = used[todo]
            for t in range(min(SPAN, size)):
                node = todo * SPAN + t
                live = node < size
                live[live] = count[node[live]] > 0
                node, row = node[live], todo[live]
                if not len(node):
                    continue
                per = count[node]
                which = ragged(first[node], per)
                cuts = np.cumsum(per) - per
                own = np.repeat(row, per)
                w = log[which] + weight[own, reach + start[which] - 1 - own * SPAN]
                top = np.maximum.reduceat(w, cuts)
                p = np.exp(w - np.repeat(top, per))
                sums = np.add.reduceat(p, cuts)
                weight[row, reach + t] = top + np.log(sums)
                share[which] = p / np.repeat(sums, per)
            ends = weight[:-1, SPAN:]
            ends = ends - np.max(ends, axis=1, initial=-np.inf, keepdims=True)
            known = np.isfinite(ends)
            old = np.where(known, used[1:], -np.inf)
            old = old - np.max(old, axis=1, initial=-np.inf, keepdims=True)
            off = np.abs(np.where(known, ends, 0.0) - np.where(known, old, 0.0)).max(axis=1, initial=0.0) > EXACT
            todo = np.flatnonzero(off) + 1
            used[todo] = ends[todo - 1]
        filled = size - (n_spans - 1) * SPAN
        tail = weight[-1, filled : filled + reach]
        return first, end - start + 1, name, share.astype(np.float32), tail - np.max(tail)

    def walk(self, data: np.ndarray, stream: np.uint64, place: int) -> np.ndarray:
        """The sampled piece ids of one segment that begins at byte ``place`` of its text."""
        lengths, names = np.zeros(len(data), np.uint8), np.zeros(len(data), np.int32)
        before = np.full(self.longest, -np.inf)
        before[-1] = 0.0  # the segment's start
        lo = 0
        while lo < len(data):
            hi = min(lo + PART, len(data))
            while hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi -= 1
            first, length, name, share, before = self._chunk(data, lo, hi, before)
            nodes = np.flatnonzero(np.diff(first))
            edge = _choose(first[nodes], first[nodes + 1] - 1, share, _uniform(stream, place + lo + nodes))
            lengths[lo + nodes], names[lo + nodes] = length[edge], name[edge]
            lo = hi
        path, node, steps = array("q"), len(data) - 1, lengths.tobytes()
        while node >= 0:
            path.append(node)
            node -= steps[node]
        return names[np.frombuffer(path, np.int64)[::-1]]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first = Column(np.int64)
        self.length, self.name, self.share = Column(np.uint8), Column(np.int32), Column(np.float32)
        self.first.add(np.zeros(1, np.int64))

    def _segments(self, strings: pa.Array) -> np.ndarray:
        """The number of each distinct segment among those filtered already; the others are filtered now, a part at a time."""
        if len(self.known) > REMEMBERED or self.length.size > REMEMBERED_EDGES:
            self._forget()
        words = strings.to_pylist()
        out = np.array([self.known.get(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = strings.take(pa.array(fresh))
            offsets, data = buffers(new)
            parts = np.concatenate(([0], np.unique(np.searchsorted(offsets, np.arange(PART, len(data) + PART, PART), "left")).clip(1, len(new)), [len(new)]))
            for i, j in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
                if i < j:
                    at = self.first.size - 1
                    own = offsets[i : j + 1] - offsets[i]
                    count, length, name, share = self.lattice(own, data[offsets[i] : offsets[j]])
                    self.first.add(self.length.size + np.cumsum(count))
                    for column, values in ((self.length, length), (self.name, name), (self.share, share)):
                        column.add(values)
                    self.low = np.concatenate((self.low, at + own[:-1]))
                    self.high = np.concatenate((self.high, at + own[1:]))
            out[fresh] = len(self.known) + np.arange(len(fresh))
            self.known |= dict(zip([words[k] for k in fresh.tolist()], out[fresh].tolist(), strict=True))
        return out

    def sample(self, texts: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, pieces of each text); null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        offsets, data = buffers(spaced)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        cut[heads] = True
        bounds = np.concatenate((np.flatnonzero(cut), [len(data)]))
        segments = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        per_text = np.searchsorted(bounds[:-1], offsets)
        text_of = np.repeat(np.arange(len(texts)), np.diff(per_text))
        stream = mix(keys.astype(np.uint64) ^ np.uint64(seed))[text_of]
        place = bounds[:-1] - offsets[text_of]  # where in its text a segment begins
        pieces = np.zeros(len(text_of), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        long = np.diff(bounds) > LONG
        active = np.flatnonzero(~long)
        if len(active):
            coded = segments.take(pa.array(active)).dictionary_encode() if long.any() else segments.dictionary_encode()
            which = self._segments(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            low, node = np.zeros(len(text_of), np.int64), self.high[which] - 1
            low[active] = self.low[which]
            first, length, name, share = self.first.values, self.length.values, self.name.values, self.share.values
        while len(active):
            u = _uniform(stream[active], place[active] + node - low[active])
            edge = _choose(first[node], first[node + 1] - 1, share, u)
            drawn.append((active, name[edge]))
            pieces[active] += 1
            node = node - length[edge]
            more = node >= low[active]
            active, node = active[more], node[more]
        walked = {int(k): self.walk(data[bounds[k] : bounds[k + 1]], stream[k], int(place[k])) for k in np.flatnonzero(long)}
        for k, ids in walked.items():
            pieces[k] = len(ids)
        ends = np.cumsum(pieces)
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - k] = ids
        for k, ids in walked.items():
            out[ends[k] - len(ids) : ends[k]] = ids
        return out, np.diff(np.concatenate(([0], ends))[per_text])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of pieces; bytes that are no UTF-8 become U+FFFD."""
        size = self.raw_size[ids]
        data = memoryview(self.raw[ragged(self.raw_start[ids], size)])
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return [bytes(data[a + 1 : b]).decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LATTICES: dict[tuple[str, float], PieceLattice] = {}


def lattice_of(model_file: str, theta: float = THETA) -> PieceLattice:
    """This worker's lattice of the file."""
    if (model_file, theta) not in _LATTICES:
        _LATTICES[model_file, theta] = PieceLattice(model_file, theta)
    return _LATTICES[model_file, theta]


def _keys(ids: pa.Array) -> np.ndarray:
    return pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def encode_pieces(docs: DataFrame, model_file: str, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text, sampled with the row's doc_id as key.

    Null and empty texts have no pieces; a null doc_id samples as key 0; repeated rows get the same
    pieces; other columns are ignored; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, most=BLOCK):
                ids, counts = lattice_of(model_file, theta).sample(part.column("text"), _keys(part.column("doc_id")), seed)
                cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids): the very text that was encoded, null as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = lattice_of(model_file).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_texts(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_file: str, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text_crc32, lossless): each row encoded and decoded again in one pass.

    ids_crc32 is of the ids as little-endian 32-bit integers, text_crc32 of the decoded UTF-8;
    lossless: the decoded text is the text (the empty text for a null one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, most=BLOCK):
                lattice = lattice_of(model_file, theta)
                ids, counts = lattice.sample(part.column("text"), _keys(part.column("doc_id")), seed)
                view = memoryview(ids.astype("<u4")).cast("B")
                cuts = (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
                crc = [zlib.crc32(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                texts = lattice.decode(ids, counts)
                same = pc.equal(pa.array(texts, pa.string()), pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(crc, pa.int64()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), same], ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
