"""Hashes and samples that agree bit for bit with libraries that exist already.

Both are public algorithms with fixed constants: SipHash-1-3 with a zero key over the file's length
and prefix, and an FNV-1a-seeded xorshift shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Byte strings that are hashed side by side.
SIDE = 256
# SipHash's initial state, FNV-1a's offset basis and prime, the xorshift triple.
SIP_STATE = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
XORSHIFT = (13, 7, 17)


def _left(x: int, by: int) -> int:
    return ((x << by) | (x >> (64 - by))) & MASK


def siphash13(data: bytes) -> int:
    """SipHash with one round a word and three to finish, under the zero key."""
    a, b, c, d = SIP_STATE

    def turn(a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
        a, c = (a + b) & MASK, (c + d) & MASK
        b, d = _left(b, 13) ^ a, _left(d, 16) ^ c
        a = _left(a, 32)
        c, a = (c + b) & MASK, (a + d) & MASK
        b, d = _left(b, 17) ^ c, _left(d, 21) ^ a
        return a, b, _left(c, 32), d

    padded = data + bytes(7 - len(data) % 8) + bytes([len(data) & 0xFF])
    for at in range(0, len(padded), 8):
        word = int.from_bytes(padded[at : at + 8], "little")
        a, b, c, d = turn(a, b, c, d ^ word)
        a ^= word
    c ^= 0xFF
    for _ in range(3):
        a, b, c, d = turn(a, b, c, d)
    return a ^ b ^ c ^ d


def siphash13_many(blocks: list[bytes]) -> np.ndarray:
    """siphash13 of many byte strings side by side, a word a step."""
    padded = [x + bytes(7 - len(x) % 8) + bytes([len(x) & 0xFF]) for x in blocks]
    order = sorted(range(len(padded)), key=lambda i: -len(padded[i]))  # what still has words stays in front
    sizes = np.array([len(padded[i]) // 8 for i in order])
    out = np.zeros(len(blocks), np.uint64)
    if not len(blocks):
        return out
    words = np.zeros((len(blocks), int(sizes[0])), np.uint64)
    for row, i in enumerate(order):
        words[row, : sizes[row]] = np.frombuffer(padded[i], "<u8")
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    state = [np.full(len(blocks), x, np.uint64) for x in SIP_STATE]

    def rounds(n: int, times: int = 1) -> None:
        a, b, c, d = (x[:n] for x in state)
        for _ in range(times):
            a, c = a + b, c + d
            b, d = turn(b, 13) ^ a, turn(d, 16) ^ c
            a = turn(a, 32)
            c, a = c + b, a + d
            b, d = turn(b, 17) ^ c, turn(d, 21) ^ a
            c = turn(c, 32)
        for held, now in zip(state, (a, b, c, d), strict=True):
            held[:n] = now

    lanes = np.ascontiguousarray(words.T)
    for t, live in enumerate(np.searchsorted(-sizes, -np.arange(lanes.shape[0]), "left").tolist()):
        state[3][:live] ^= lanes[t, :live]
        rounds(live)
        state[0][:live] ^= lanes[t, :live]
    state[2] ^= np.uint64(0xFF)
    rounds(len(blocks), 3)
    out[order] = state[0] ^ state[1] ^ state[2] ^ state[3]
    return out


def content_hash(size: int, head: bytes) -> str:
    """16 hex digits over the size and the length-prefixed head of a file."""
    return f"{siphash13(size.to_bytes(8, 'little') + len(head).to_bytes(8, 'little') + head):016x}"


def sample(members: list[str], n: int) -> list[str]:
    """n of the distinct members, sorted; the same ones for any order of the members."""
    pool = sorted(set(members))
    if len(pool) <= n:
        return pool
    state = FNV_BASIS
    for byte in "".join(pool).encode():
        state = ((state ^ byte) * FNV_PRIME) & MASK
    state |= 1
    first, second, third = XORSHIFT
    for last in range(len(pool) - 1, 0, -1):
        state ^= (state << first) & MASK
        state ^= state >> second
        state ^= (state << third) & MASK
        pick = state % (last + 1)
        pool[last], pool[pick] = pool[pick], pool[last]
    return sorted(pool[:n])


def content_hash_column(size: Column, head: Column) -> Column:
    """content_hash of a size and a binary column; null for a null head."""

    @F.pandas_udf("string")
    def run(sizes: pd.Series, heads: pd.Series) -> pd.Series:
        known = [i for i, h in enumerate(heads) if h is not None]
        out = pd.Series([None] * len(heads), dtype=object)
        for lo in range(0, len(known), SIDE):
            some = known[lo : lo + SIDE]
            found = siphash13_many([int(sizes[i]).to_bytes(8, "little") + len(heads[i]).to_bytes(8, "little") + bytes(heads[i]) for i in some])
            for i, x in zip(some, found.tolist(), strict=True):
                out[i] = f"{x:016x}"
        return out

    return run(size, head)


def sample_column(members: Column, n: int) -> Column:
    """sample of an array column."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else sample(list(x), n))

    return run(members)
