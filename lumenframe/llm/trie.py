"""A byte trie in numpy arrays, whose children are found for many states at once."""

from __future__ import annotations

import numpy as np

EMPTY = -1
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 / golden ratio, for multiplicative hashing


class ByteTrie:
    """States are numbered breadth first from the root 0; ``value[s]`` is the entry that ends in s, or -1.

    Of entries given twice the first counts.
    """

    def __init__(self, entries: list[bytes]):
        kids: list[dict[int, int]] = [{}]
        value = [EMPTY]
        for n, entry in enumerate(entries):
            s = 0
            for b in entry:
                if b not in kids[s]:
                    kids[s][b] = len(kids)
                    kids.append({})
                    value.append(EMPTY)
                s = kids[s][b]
            if s and value[s] == EMPTY:
                value[s] = n
        order, place = [0], [0] * len(kids)
        for s in order:
            order.extend(kids[s][b] for b in sorted(kids[s]))
        for i, s in enumerate(order):
            place[s] = i
        self.size = len(kids)
        self.value = np.array([value[s] for s in order], np.int64)
        self.parent = np.zeros(len(kids), np.int64)
        self.byte = np.zeros(len(kids), np.int64)
        self.depth = np.zeros(len(kids), np.int64)
        for s, below in enumerate(kids):
            for b, t in below.items():
                self.parent[place[t]], self.byte[place[t]] = place[s], b
        for i in range(1, len(order)):
            self.depth[i] = self.depth[self.parent[i]] + 1
        self._fill()

    def _fill(self) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        self._bits = max(4, (4 * self.size).bit_length())
        self._keys, self._next = np.full(1 << self._bits, EMPTY, np.int64), np.zeros(1 << self._bits, np.int32)
        keys, states = self.parent[1:] * 256 + self.byte[1:], np.arange(1, self.size)
        slots = self._slot(keys)
        while len(keys):
            free = self._keys[slots] == EMPTY
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)[1]] = True
            put = free & first
            self._keys[slots[put]], self._next[slots[put]] = keys[put], states[put]
            keys, states, slots = keys[~put], states[~put], (slots[~put] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self._bits)).astype(np.int64)

    def child(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol, or -1."""
        keys = states.astype(np.int64) * 256 + symbols
        slots = self._slot(keys)
        found = self._keys[slots]
        out = np.where(found == keys, self._next[slots], EMPTY).astype(np.int64)
        left = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(left):
            slots = (slots if len(slots) == len(left) else slots[left]) + 1 & ((1 << self._bits) - 1)
            found = self._keys[slots]
            hit = found == keys[left]
            out[left[hit]] = self._next[slots[hit]]
            more = ~hit & (found != EMPTY)
            left, slots = left[more], slots[more]
        return out
