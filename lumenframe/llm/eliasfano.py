"""Elias-Fano coding of non-decreasing integer sequences, with select from sampled 32-bit positions."""

from __future__ import annotations

import struct

import numpy as np

#: Elements between two remembered positions of the upper bits.
SAMPLE = 256
HEAD = "<QQqBQQQ"  # count, universe, base, low width, low bytes, high bytes, samples


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of int64 (about 2 + log2(range / n) bits an element)."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n and (values[1:] < values[:-1]).any():
        raise ValueError("the sequence decreases")
    base = int(values[0]) if n else 0
    offsets = (values - base).astype(np.uint64)
    universe = int(offsets[-1]) + 1 if n else 1
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    low = offsets & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (offsets >> np.uint64(width)).astype(np.int64) + np.arange(n)
    if n and ones[-1] >= 1 << 32:
        raise ValueError("too many elements for one 32-bit select table")
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    highs = np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, universe, base, width, len(lows), len(highs), len(samples)) + lows + highs + samples


class Sequence:
    """A view of an encoded sequence inside ``data`` from ``at`` on; nothing is unpacked until asked for."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.universe, self.base, self.width, lows, highs, samples = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        self._low = np.frombuffer(data, np.uint8, lows, at)
        self._high = np.frombuffer(data, np.uint8, highs, at + lows)
        self._samples = np.frombuffer(data, "<u4", samples // 4, at + lows + highs)
        self.end = at + lows + highs + samples

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Element i by select: from the sample before it, over the bytes of the upper bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, byte, at = i % SAMPLE, 0, int(self._samples[i // SAMPLE])
        bits = int(self._high[at >> 3]) >> (at & 7)
        byte, shift = at >> 3, at & 7
        while (seen := bits.bit_count()) <= left:
            left -= seen
            byte, shift = byte + 1, 0
            bits = int(self._high[byte])
        while left:
            bits &= bits - 1
            left -= 1
        place = byte * 8 + shift + (bits & -bits).bit_length() - 1
        first = i * self.width
        chunk = int.from_bytes(self._low[first >> 3 : (first + self.width + 7) >> 3].tobytes(), "little")
        low = (chunk >> (first & 7)) & ((1 << self.width) - 1)
        return self.base + ((place - i) << self.width) + low

    def all(self) -> np.ndarray:
        """The whole sequence as int64."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.width
        if self.width:
            bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
            out = out | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out + self.base
