"""Cover trees over unit vectors and their dual traversal for all pairs within a distance.

Distances are chords: |x - y|^2 = 2 - 2 cos.  A tree's levels are nets of halving radii; every node
keeps the largest distance from its centre to a vector below it, so a pair of nodes whose centres
are further apart than both of these and the threshold together holds no pair and is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Nodes with so few vectors aren't split.
LEAF = 24
#: Added to every bound, well above the rounding of distances in double precision.
SLACK = 1e-7
CHUNK = 1 << 20


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def net(x: np.ndarray, radius: float, most: int) -> tuple[list[int], np.ndarray] | None:
    """A greedy net: centres further apart than ``radius``, and the first centre within it of every row.

    None as soon as it takes more than ``most`` centres.
    """
    owner = np.full(len(x), -1)
    left = np.arange(len(x))
    centres: list[int] = []
    while len(left):
        if len(centres) == most:
            return None
        c = left[0]
        near = chords(x[left], x[c : c + 1])[:, 0] <= radius
        near[0] = True
        owner[left[near]] = len(centres)
        centres.append(int(c))
        left = left[~near]
    return centres, owner


@dataclass
class CoverTree:
    """Rows in tree order, and for each node its rows [lo, hi), children [first, last), centre and covering radius."""

    order: np.ndarray
    vectors: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @staticmethod
    def build(x: np.ndarray) -> CoverTree:
        """The tree of unit rows ``x``; a node whose next net would hardly be smaller than itself stays a leaf."""
        order = np.arange(len(x))
        nodes = [(0, len(x), 0, 2.0)]  # rows, centre, radius of its net
        spans = [(0, 0)]
        at = 0
        while at < len(nodes):
            lo, hi, _, radius = nodes[at]
            rows, parts = order[lo:hi].copy(), None  # order is permuted below
            while hi - lo > LEAF and radius > 1e-3 and parts is None:
                radius /= 2  # halving radii; levels that don't split the node are skipped
                found = net(x[rows], radius, max(2, (hi - lo) // 2))
                if found is None:
                    break
                if len(found[0]) > 1:
                    parts = found
            if parts is not None:
                centres, owner = parts
                spans[at] = (len(nodes), len(nodes) + len(centres))
                order[lo:hi] = rows[np.argsort(owner, kind="stable")]
                ends = lo + np.cumsum(np.bincount(owner, minlength=len(centres)))
                for c, a, b in zip(centres, np.concatenate(([lo], ends[:-1])).tolist(), ends.tolist(), strict=True):
                    nodes.append((a, b, int(rows[c]), radius))
                    spans.append((0, 0))
            at += 1
        lo, hi, centre = (np.array([n[k] for n in nodes]) for k in range(3))
        vectors = x[order]
        reach = np.array([chords(vectors[a:b], x[c : c + 1]).max() if b > a else 0.0 for a, b, c in zip(lo, hi, centre, strict=True)])
        first, last = np.array(spans).T
        return CoverTree(order, vectors, lo, hi, first, last, x[centre] if len(x) else x, reach)


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in tree order) of all pairs of rows of ``a`` and ``b`` with at least this cosine, in chunks.

    ``same``: both are one tree, and each pair of different rows is found once.
    """
    if not len(a.vectors) or not len(b.vectors):
        return
    limit = np.sqrt(2.0 - 2.0 * cosine) + SLACK
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        split_p, split_q = a.last[p] > a.first[p], b.last[q] > b.first[q]
        if not split_p and not split_q:
            x, y = a.vectors[a.lo[p] : a.hi[p]], b.vectors[b.lo[q] : b.hi[q]]
            step = max(1, CHUNK // len(y))
            for k in range(0, len(x), step):
                i, j = np.nonzero(x[k : k + step] @ y.T >= cosine)
                i, j = i + a.lo[p] + k, j + b.lo[q]
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
            continue
        left = np.arange(a.first[p], a.last[p]) if split_p else np.array([p])
        right = np.arange(b.first[q], b.last[q]) if split_q else np.array([q])
        step = max(1, CHUNK // len(right))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            near = chords(a.centre[rows], b.centre[right]) <= a.radius[rows][:, None] + b.radius[right][None, :] + limit
            if same and p == q:
                near &= rows[:, None] <= right[None, :]
            i, j = np.nonzero(near)
            todo.extend(zip(rows[i].tolist(), right[j].tolist(), strict=True))
