"""Words of whole Arrow text columns as flat numpy arrays, a bounded number of bytes at a time."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Text bytes handled together; one longer text is handled alone.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python, so that neither side holds tens of megabytes a task.
BATCH_BYTES = 4 << 20


def _trim() -> None:
    """Gives freed memory back, since a worker lives on between stages beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over rows that may be long: the session's batches are bounded by bytes, not by rows alone.

    A session whose bound is larger gets BATCH_BYTES and keeps it, since the plan reads it only when it runs.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    most = frame.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if most > BATCH_BYTES or most <= 0:
        conf.set(key, str(BATCH_BYTES))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return frame.mapInArrow(trimmed, schema)


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: (offsets of each text's words, the words of all texts).

    A null, empty or blank text has no words.  ``lower`` maps A-Z only.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        counts = np.where(blank, 0, counts)
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return np.concatenate(([0], np.cumsum(counts))), flat


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; the first offset is 0."""
    if len(strings) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


#: An odd multiplier, so that its powers can be divided out modulo 2**64 (fixed value: Knuth's MMIX multiplier).
BASE = np.uint64(6364136223846793005)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of the usual block are kept."""
    most = BLOCK_BYTES + 1
    if n <= most and int(base) in _POWERS:
        return _POWERS[int(base)][:n]
    out = np.full(max(n, most), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= most:
        _POWERS[int(base)] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing permutation of splitmix64 (fixed values: its published shifts and multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial, from differences of one running sum, then mixed with the length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, INVERSE)[starts] + (ends - starts).astype(np.uint64))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """span_hashes of whole strings."""
    offsets, data = buffers(strings)
    return span_hashes(data, offsets[:-1], offsets[1:])
