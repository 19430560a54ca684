"""Token counts by greedy longest match, from a linear-time automaton.

The vocabulary's trie gets a failure link for every state: where to go on after popping the tokens
that greedy matching has settled by then, and how many those are.  A word's count is the sum of the
popped counts along its walk; no piece is ever built.  All distinct words of a block walk side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trie import ByteTrie
from .words import blocks, buffers, map_texts, split

DEAD = -1
#: Longer words walk alone, so that a few of them don't hold up a block.
SIDE_BYTES = 256


def byte_vocabulary(tokenizer_file: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary, its end-of-word suffix taken off, each once, sorted."""
    from tokenizers import Tokenizer

    # The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = set()
    for token in Tokenizer.from_file(tokenizer_file).get_vocab():
        token = token.removesuffix("</w>")
        if token and all(c in letters for c in token):
            out.add(bytes(letters[c] for c in token))
    return sorted(out)


class LongestMatch:
    """The automaton of a vocabulary.  A word that greedy matching can't cover counts as one unknown token."""

    def __init__(self, vocabulary: list[bytes]):
        self.trie = trie = ByteTrie(vocabulary)
        n = trie.size
        fail, pops = np.full(n, DEAD, np.int64), np.zeros(n, np.int64)
        kids: dict[tuple[int, int], int] = {(int(trie.parent[s]), int(trie.byte[s])): s for s in range(1, n)}
        for s in range(1, n):  # breadth first, so a parent's link is known
            if trie.value[s] >= 0:
                fail[s], pops[s] = 0, 1
                continue
            up, b = int(trie.parent[s]), int(trie.byte[s])
            z, count = int(fail[up]), int(pops[up])
            while z != DEAD and (z, b) not in kids:
                count += int(pops[z])
                z = int(fail[z])
            if z != DEAD:
                fail[s], pops[s] = kids[z, b], count
        self.fail, self.pops, self._kids = fail, pops, kids
        # What is popped when a word ends in a state; -1 if it can't be covered.
        rest = np.zeros(n, np.int64)
        for s in range(1, n):
            rest[s] = -1 if fail[s] == DEAD or rest[fail[s]] < 0 else pops[s] + rest[fail[s]]
        if (np.arange(n)[1:] <= fail[1:]).any():
            raise AssertionError("a failure link leads deeper")
        self.rest = rest

    def count(self, word: bytes) -> int:
        """Tokens of one word, one byte after the other; -1 if it can't be covered."""
        s = total = 0
        for b in word:
            while (t := self._kids.get((s, b), DEAD)) == DEAD:
                if self.fail[s] == DEAD:
                    return -1
                total += int(self.pops[s])
                s = int(self.fail[s])
            s = t
        return -1 if self.rest[s] < 0 else total + int(self.rest[s])

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Tokens of each word, -1 for those that can't be covered."""
        sizes = np.diff(offsets)
        total = np.zeros(len(sizes), np.int64)
        long = np.flatnonzero(sizes > SIDE_BYTES)
        order = np.argsort(-np.where(sizes > SIDE_BYTES, 0, sizes), kind="stable")
        left = np.where(sizes > SIDE_BYTES, 0, sizes)[order]
        state = np.zeros(len(order), np.int64)
        alive = len(order)
        for at in range(int(left[0]) if len(left) else 0):
            alive = int(np.searchsorted(-left[:alive], -at, "left"))  # words longer than at
            pending = np.flatnonzero(state[:alive] != DEAD)
            symbols = data[offsets[:-1][order[pending]] + at]
            while len(pending):
                now = state[pending]
                after = self.trie.child(now, symbols)
                hit = after != DEAD
                state[pending[hit]] = after[hit]
                pending, symbols, now = pending[~hit], symbols[~hit], now[~hit]
                total[order[pending]] += self.pops[now]
                state[pending] = self.fail[now]
                lost = self.fail[now] == DEAD
                pending, symbols = pending[~lost], symbols[~lost]
        ends = np.where(state == DEAD, -1, self.rest[np.maximum(state, 0)])
        total[order] = np.where(ends < 0, -1, total[order] + ends)
        for i in long:
            total[i] = self.count(data[offsets[i] : offsets[i + 1]].tobytes())
        return total


_AUTOMATA: dict[str, LongestMatch] = {}


def automaton_of(tokenizer_file: str) -> LongestMatch:
    """This worker's automaton of the file."""
    if tokenizer_file not in _AUTOMATA:
        _AUTOMATA[tokenizer_file] = LongestMatch(byte_vocabulary(tokenizer_file))
    return _AUTOMATA[tokenizer_file]


def token_counts(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row's whole text.

    Words are what white space separates, A-Z lowered; n_tokens counts an uncovered word once.
    Null, empty and blank texts have none; repeated rows are each counted; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, most=4 << 20):
                automaton = automaton_of(tokenizer_file)
                bounds, flat = split(part.column("text"), lower=True)
                coded = flat.dictionary_encode()
                each = automaton.counts(*buffers(coded.dictionary))
                each = each[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sums(np.abs(each))), pa.array(sums(each < 0).astype(np.int64))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_tokens long, n_unknown long")
