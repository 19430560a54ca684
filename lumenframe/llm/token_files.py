"""Token-id files: concatenated ids with Elias-Fano coded document ids and boundaries.

One file is

    8 bytes   magic
    ids       little-endian, 2 bytes each if the vocabulary allows, else 4
    sequence  doc_ids of the documents that have one, ascending (Elias-Fano)
    sequence  end offset of every document, in ids (Elias-Fano)
    32 bytes  documents without doc_id (they come first), ids, bytes an id, place of the first sequence

so a document's ids are found by two selects and one ranged read, without a table of 64-bit offsets.
Tasks write under a name of their own and rename, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import eliasfano
from .storage import new_folder
from .words import blocks, buffers, map_texts, split

MAGIC = b"LFTOKID\x01"
TAIL = "<QQQQ"
BLOCK = 8 << 20
#: Distinct units a worker remembers at most before it starts anew.
REMEMBERED = 500_000
#: Fixed value: the pre-tokenizer under which ASCII white space always separates and is dropped.
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
TRAILING = ".,;:!?|$%&*#\")"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and path of a URI; a bare path is local."""
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class ChunkEncoder:
    """Ids of white-space-separated chunks; the library encodes each distinct one once.

    Under the word pre-tokenizer no token reaches across ASCII white space, nor from an ASCII letter
    or digit into the punctuation at a chunk's end, and neither normal form nor lower case look
    across; so the ids of a text are those of its chunks and their ends, one after the other.  With
    any other pre-tokenizer whole texts are encoded.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.chunked = steps == ["NFC", "Replace", "Lowercase"] and cut.get("pattern", {}).get("Regex") == WORD_SPLIT and cut.get("behavior") == "Removed" and not spec.get("post_processor") and all("<|" in x["content"] for x in spec.get("added_tokens", []))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {"": 0}
        self.flat, self.start, self.count = np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, new: list[str]) -> None:
        """Many units share a call, with a mark after each that no unit holds."""
        marked, odd = [x for x in new if "\x01" not in x], [x for x in new if "\x01" in x]
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids[0]
        runs = [" \x01 ".join(marked[i : i + 200]) + " \x01" for i in range(0, len(marked), 200)]
        ids = np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in self.encode_whole(runs)]])
        marks = np.flatnonzero(ids == mark)
        alone = self.encode_whole(odd)
        counts = np.concatenate((np.diff(np.concatenate(([-1], marks))) - 1, np.array([len(x) for x in alone], np.int64)))
        self.units |= {x: len(self.start) + i for i, x in enumerate(marked + odd)}
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.flat = np.concatenate([self.flat, ids[ids != mark].astype(self.kind), *[np.array(x, self.kind) for x in alone]])

    def _places(self, strings: pa.Array) -> np.ndarray:
        """The unit of each string; unknown ones are encoded first."""
        coded = strings.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [x for x in words if x not in self.units]:
            self._add(new)
        return np.fromiter(map(self.units.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each text); a null text has none."""
        if not self.chunked:
            found = self.encode_whole(pc.fill_null(texts, "").to_pylist())
            counts = np.array([len(x) for x in found], np.int64)
            return np.concatenate([np.array(x, self.kind) for x in found] or [np.zeros(0, self.kind)]), counts
        if len(self.units) > REMEMBERED:
            self._forget()
        special = pc.any(pc.match_substring(pc.fill_null(texts, ""), "<|")).as_py()
        bounds, flat = split(texts, lower=not special)
        core, tails, ended = cut_tails(flat)
        units = np.zeros((len(flat), 2), np.int64)
        if len(flat):
            units[:, 0] = self._places(core)
            units[ended, 1] = self._places(tails)
        lengths = self.count[units.ravel()]
        ids = self.flat[ragged(self.start[units.ravel()], lengths)]
        return ids, np.diff(np.concatenate(([0], np.cumsum(lengths)))[2 * bounds])


def cut_tails(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(words without the TRAILING characters after an ASCII letter or digit, those cut off, which words had some)."""
    if not len(words):
        return words, words, np.zeros(0, np.int64)
    core = pc.ascii_rtrim(words, characters=TRAILING)
    offsets, data = buffers(core)
    whole, all_bytes = buffers(words)
    last = data[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(len(words), np.uint8)
    plain = (last >= 48) & (last < 58) | (last >= 65) & (last < 91) | (last >= 97) & (last < 123)
    short, long = np.diff(offsets), np.diff(whole)
    ended = np.flatnonzero(plain & (short > 0) & (short < long))
    keep = np.zeros(len(words), bool)
    keep[ended] = True
    ends = np.concatenate(([0], np.cumsum((long - short)[ended]))).astype(np.int32)
    cut = all_bytes[ragged(whole[ended] + short[ended], (long - short)[ended])]
    tails = pa.StringArray.from_buffers(len(ended), pa.py_buffer(ends), pa.py_buffer(cut))
    return pc.if_else(pa.array(keep), core, words), tails, ended


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(tokenizer_file: str) -> ChunkEncoder:
    """This worker's encoder of the file; later tasks find what earlier ones encoded."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = ChunkEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes one file a range of ids into ``folder``, documents ascending by id over all files.

    Returns a row a file (shard, file, n_docs, n_ids), in order.  A null or empty text is only the
    end id; rows without doc_id come first; equal ids are ordered by a hash of their texts; a range
    without rows has no file.  Other columns are ignored.
    """
    store, path = filesystem(folder)
    store.create_dir(path)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, own = None, None, ""
        store, path = filesystem(folder)
        shard = TaskContext.get().partitionId()
        ids, counts = [], []
        for batch in batches:
            for part in blocks(batch, most=BLOCK):
                if encoder is None:
                    encoder, own = encoder_of(tokenizer_file), f"{path}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(own)
                    out.write(MAGIC)
                found, lengths = encoder.encode(part.column("text"))
                whole = np.full(len(found) + len(lengths), end_id, encoder.kind)
                whole[np.arange(len(found)) + np.repeat(np.arange(len(lengths)), lengths)] = found
                out.write(whole.tobytes())
                ids.append(part.column("id"))
                counts.append(lengths + 1)
        if out is None:
            return
        column, counts = pa.chunked_array(ids), np.concatenate(counts)
        ends = np.cumsum(counts)
        known = column.drop_null().to_numpy()
        place = len(MAGIC) + int(ends[-1]) * encoder.width
        out.write(eliasfano.encode(known) + eliasfano.encode(ends) + struct.pack(TAIL, column.null_count, int(ends[-1]), encoder.width, place))
        out.close()
        file = f"{path}/{shard:08d}.ids"
        if store.get_file_info(file).type != pyarrow.fs.FileType.NotFound:
            store.delete_file(file)
        store.move(own, file)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(counts)], "n_ids": [int(ends[-1])]}, pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = map_texts(dealt, run, "shard long, n_docs long, n_ids long").collect()
    return [{"shard": r.shard, "file": f"{folder}/{r.shard:08d}.ids", "n_docs": r.n_docs, "n_ids": r.n_ids} for r in sorted(rows)]


class TokenFile:
    """One file opened for reading: documents by position or by doc_id, or in order."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self._in = store.open_input_file(path)
        size = self._in.size()
        self.nulls, self.n_ids, self.width, place = struct.unpack(TAIL, self._in.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        data = self._in.read_at(size - struct.calcsize(TAIL) - place, place)
        self.doc_ids = eliasfano.Sequence(data)
        self.ends = eliasfano.Sequence(data, self.doc_ids.end)

    def __len__(self) -> int:
        return len(self.ends)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at offsets first .. last - 1."""
        return np.frombuffer(self._in.read_at((last - first) * self.width, len(MAGIC) + first * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, end id included."""
        return self.ids(self.ends[i - 1] if i else 0, self.ends[i])

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with this doc_id, by binary search over selects."""
        lo, hi = 0, len(self.doc_ids)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.doc_ids[mid] < doc_id else (lo, mid)
        return self.document(self.nulls + lo) if lo < len(self.doc_ids) and self.doc_ids[lo] == doc_id else None


def read_digests(spark: SparkSession, files: list[dict], block: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone, a file a task.

    Rows that were written without doc_id have a null one and come first; no files give no rows.
    """
    starts = np.concatenate(([0], np.cumsum([f["n_ids"] for f in files]))).astype(np.int64)
    places = [f["file"] for f in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                file = TokenFile(places[k])
                ends = file.ends.all()
                begins = np.concatenate(([0], ends[:-1]))
                names = pa.array([None] * file.nulls, pa.int64())
                names = pa.concat_arrays([names, pa.array(file.doc_ids.all())])
                i = 0
                while i < len(ends):  # about block ids at a time, one document at least
                    j = max(i + 1, int(np.searchsorted(ends, begins[i] + block, "right")))
                    ids = file.ids(int(begins[i]), int(ends[j - 1])).astype("<u4")
                    view, low = memoryview(ids).cast("B"), int(begins[i])
                    crc = [zlib.crc32(view[4 * (a - low) : 4 * (b - low)]) for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([names.slice(i, j - i), pa.array(begins[i:j] + starts[k]), pa.array(ends[i:j] - begins[i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    index = spark.range(0, len(files), 1, max(1, len(files)))
    return index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs(doc_id, text)`` as token files in the shared folder and returns what reading them back gives.

    A null or empty text has its end id alone; repeated rows are each written; other columns are ignored;
    no documents give no rows.
    """
    spark = docs.sparkSession
    return read_digests(spark, write_token_files(docs, new_folder(spark, "tokens"), tokenizer_file, end_id))
