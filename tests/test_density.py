"""Clustering against definitions written apart from the library."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import density
from voxmill.operators.components import components
from voxmill.operators.spanning_tree import spanning_tree, split_into_boxes


def table(spark, x, key="vid", point="x"):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, f"{key} bigint, {point} array<double>")


def labels_of(spark, x, smallest, **options):
    found = density.cluster(table(spark, x, "row_id", "point"), "row_id", smallest, **options)
    by_row = {r.row_id: r.cluster_id for r in found.collect()}
    assert sorted(by_row) == list(range(len(x)))
    return [None if by_row[i] == -1 else by_row[i] for i in range(len(x))]


def blobs(seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 1, 2)])


@pytest.mark.parametrize("one_task_edges", [0, 10_000])
def test_components_of_paths_stars_and_loops(spark, one_task_edges):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)]
    edges += [(200, 201), (201, 202), (202, 200), (202, 202)]
    found = components(spark.createDataFrame(edges, "a long, b long"), one_task_edges).collect()
    assert components(spark.createDataFrame([], "a long, b long"), one_task_edges).collect() == []
    assert len(found) == 31 + 20 + 3
    for row in found:
        assert row.component == (0 if row.vertex < 100 else row.vertex // 100 * 100)


def test_boxes_are_small_and_keep_every_point(spark):
    rng = np.random.default_rng(5)
    # Most points on one line, many ties on the other axes.
    x = np.unique(np.column_stack([rng.integers(0, 40, 200), rng.integers(0, 2, 200)]), axis=0)
    found, _ = split_into_boxes(table(spark, x), 8)
    assert found.count() == len(x)
    assert found.groupBy("box").count().agg(F.max("count")).first()[0] <= 8


@pytest.mark.parametrize("case", ["uniform", "lattice"])
def test_spanning_tree_over_many_boxes(spark, case):
    rng = np.random.default_rng(11)
    if case == "uniform":
        x = rng.random((70, 3))
    else:  # many equal lengths
        x = np.unique(rng.integers(0, 12, (80, 2)).astype(float), axis=0)
    want = brute.tree_edges(x)
    found = [(r.w, r.lo, r.hi) for r in spanning_tree(table(spark, x), block_rows=12).collect()]
    assert len(found) == len(want) == len(x) - 1
    assert np.allclose(sorted(w for w, _, _ in found), sorted(w for w, _, _ in want))
    if case == "uniform":
        assert {e[1:] for e in found} == {e[1:] for e in want}


@pytest.mark.parametrize("smallest", [2, 3, 5])
def test_clusters_match_brute_force(spark, smallest):
    x = np.random.default_rng(smallest).random((60, 2))
    want = brute.density_labels(x, [1] * len(x), smallest)
    assert brute.same_partition(labels_of(spark, x, smallest), want)


def test_clusters_in_many_pieces_match_brute_force(spark):
    x = np.random.default_rng(8).random((40, 2))
    want = brute.density_labels(x, [1] * len(x), 2)
    assert brute.same_partition(labels_of(spark, x, 2, piece_rows=8), want)


def test_equal_points_count_with_their_number(spark):
    x = np.random.default_rng(9).random((25, 2))
    weight = [1, 2, 4, 1, 1] * 5
    want = brute.density_labels(x, weight, 3)
    found = labels_of(spark, np.repeat(x, weight, axis=0), 3)
    first = np.concatenate([[0], np.cumsum(weight)[:-1]])
    assert brute.same_partition([found[i] for i in first], want)
    assert [found[i] for i in np.repeat(first, weight)] == found


def test_blobs_and_row_order(spark):
    x = blobs()
    labels = labels_of(spark, x, 5)
    assert [len({*labels[i : i + 20]} - {None}) for i in (0, 20, 40)] == [1, 1, 1]
    assert len(set(labels) - {None}) == 3
    sizes = [labels.count(c) for c in set(labels) - {None}]
    assert min(sizes) >= 5
    turned = np.random.default_rng(1).permutation(len(x))
    again = labels_of(spark, x[turned], 5)
    assert brute.same_partition([labels[i] for i in turned], again)


def test_fallbacks(spark):
    assert labels_of(spark, np.zeros((1, 2)), 2) == [0]
    assert labels_of(spark, np.zeros((5, 2)), 2) == [0, 0, 1, 1, 1]
    assert labels_of(spark, np.array([[0.0, 0.0], [1.0, 0.0]]), 2) == [0, 1]


def chain_tree(spark, length, seed):
    """A caterpillar: every node has one leaf and one long child."""
    rng = np.random.default_rng(seed)
    rows, node, free = [(0, None, 0.0)], 0, 1
    for _ in range(length):
        rows += [(free, node, float(rng.random())), (free + 1, node, float(rng.random() * 2))]
        node, free = free + 1, free + 2
    return spark.createDataFrame(rows, "node long, parent long, stability double")


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_by_joins_equals_selection_in_one_task(spark, seed):
    tree = chain_tree(spark, 25, seed)
    one = {r.node: r.chosen for r in density.select_clusters(tree, 1000).collect()}
    many = {r.node: r.chosen for r in density.select_clusters(tree, 10).collect()}
    assert one == many and len(one) == 51 and any(one.values())
