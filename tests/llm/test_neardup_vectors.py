import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm.covertree import CoverTree, dual_pairs
from lumenframe.llm.neardup_vectors import embedding_components


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 160), st.integers(1, 160), st.sampled_from([0.001, 0.05, 0.3, 3.0]), st.sampled_from([0.5, 0.95, 0.999]))
def test_dual_traversal_finds_exactly_the_threshold_pairs(seed, n, m, spread, cosine):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 6))
    x, y = (unit(centres[rng.integers(0, 5, k)] + spread * rng.standard_normal((k, 6))) for k in (n, m))
    a, b = CoverTree.build(x), CoverTree.build(y)
    got = {(int(a.order[i]), int(b.order[j])) for p, q in dual_pairs(a, b, cosine) for i, j in zip(p, q, strict=True)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(x @ y.T >= cosine), strict=True)}
    own = sorted(tuple(sorted((int(a.order[i]), int(a.order[j])))) for p, q in dual_pairs(a, a, cosine, True) for i, j in zip(p, q, strict=True))
    assert own == sorted((i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True))


def brute(rows, cosine=0.95):
    """(n_links, component) of each row."""
    good = [v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) for v in rows]
    names, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i], np.float32).astype(float), np.array(rows[j], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    names[max(x, y)] = min(x, y)
    return [(links[i], root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("block_rows", [5, 16, 4096])
def test_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 8))
    rows = [(centres[k % 20] * rng.uniform(0.1, 9) + rng.choice([0.01, 0.25]) * rng.standard_normal(8)).tolist() for k in range(180)]
    rows += [rows[3], rows[3], (2 * np.array(rows[3])).tolist(), None, [], [0.0] * 8, [float("nan")] + rows[1][1:], [None] + rows[1][1:], [float("inf")] + [0.0] * 7, rows[4][:5], rows[4][:5]]
    table = spark.createDataFrame([(i, v, i % 3, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, node int")
    got = {r.vec_id: r for r in embedding_components(table, block_rows=block_rows).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == brute(rows)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_ids_may_be_null_or_repeat(spark):
    rows = [(7, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [-1.0, 0.0]), (3, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_components(table).collect()), key=str)
    assert got == sorted([(7, 1, 7, True), (None, 1, 7, False), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, False), (3, 0, 3, True)], key=str)
    assert embedding_components(table.limit(0)).collect() == []


def test_centres_lie_in_their_nodes_within_the_nets_radius():
    rng = np.random.default_rng(8)
    x = unit(np.repeat(rng.standard_normal((12, 6)), 60, axis=0) + 0.05 * rng.standard_normal((720, 6)))
    tree = CoverTree.build(x)
    assert len(tree.lo) > 12
    for k in range(1, len(tree.lo)):
        inside = tree.vectors[tree.lo[k] : tree.hi[k]]
        assert (inside == tree.centre[k]).all(axis=1).any()
    for k in np.flatnonzero(tree.last > tree.first):
        children = np.arange(tree.first[k], tree.last[k])
        centres = tree.centre[children]
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[np.triu_indices(len(children), 1)]
        assert tree.radius[children].max() < apart.min()
