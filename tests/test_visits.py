"""Only points visit other boxes that may have an edge there."""

from __future__ import annotations

import brute
import numpy as np
import pytest

from voxmill.operators import spanning_tree as st


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vid bigint, x array<double>")


def test_few_pairs_of_boxes_are_compared_whole(spark, monkeypatch):
    """In five dimensions each box touches most others: all pairs were compared."""
    x = np.random.default_rng(4).normal(size=(16_000, 5))
    compare, asked = st.compare, []

    def told(packed, pairs):
        asked.append(len(pairs) if isinstance(pairs, list) else pairs.count())
        return compare(packed, pairs)

    monkeypatch.setattr(st, "compare", told)
    assert st.spanning_tree(table(spark, x), 1_000).count() == len(x) - 1
    assert sum(asked) <= 32  # of 120


@pytest.mark.parametrize("case", ["blobs", "lattices", "spread"])
def test_tree_of_boxes_with_parts(spark, case):
    rng = np.random.default_rng(6)
    if case == "spread":
        x = rng.normal(size=(200, 2)) ** 3
    else:  # each box holds points of several
        x = rng.integers(0, 6, (240, 2)) if case == "lattices" else rng.normal(size=(240, 2))
        x = np.unique(x + 100.0 * rng.permutation(np.arange(240) % 5)[:, None], axis=0)
    want = brute.tree_edges(x)
    found = [(r.w, r.lo, r.hi) for r in st.spanning_tree(table(spark, x), 64).collect()]
    assert np.allclose(sorted(w for w, _, _ in found), sorted(w for w, _, _ in want))
    if case != "lattices":
        assert {e[1:] for e in found} == {e[1:] for e in want}


def test_middles_and_parts():
    ends = np.array([[0, 1], [1, 2], [2, 3], [3, 4], [4, 5], [5, 6]])
    squares = np.array([1.0, 2.0, 1.0, 9.0, 1.0, 4.0])
    middle, reach = st._middles(7, ends, squares, 7)
    assert len(set(middle.tolist())) == 1
    assert reach[[4, 5, 6]].tolist() == [9.0] * 3 and reach[:4].max() == 2.0
    middle, reach = st._middles(7, ends, squares, 2)
    assert len(set(middle[:4].tolist())) == len(set(middle[4:].tolist())) == 1 != len(set(middle.tolist()))
    assert reach.max() == 4.0
