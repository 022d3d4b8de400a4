"""Spanning trees and clusters of points whose distances tie, over box and piece sizes."""

from __future__ import annotations

import brute
import numpy as np
import pytest

from voxmill.operators import density, selection
from voxmill.operators.spanning_tree import spanning_tree
from pyspark.sql import functions as F

NEAR_TIE = [(0.0, 0.0), (-0.05, 0.0), (1.0, 0.03), (0.9999999999999999, -0.03)]
LATTICE = [(0.1 * i, 0.1 * j) for i in range(7) for j in range(5)]


def _points(spark, x, key="vid", point="x"):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], f"{key} bigint, {point} array<double>")


@pytest.mark.parametrize("block_rows", [2, 5, 8192])
@pytest.mark.parametrize("x", [NEAR_TIE, LATTICE], ids=["four", "lattice"])
def test_ties_make_one_tree(spark, x, block_rows):
    found = {(r.lo, r.hi) for r in spanning_tree(_points(spark, x), block_rows).collect()}
    whole = {(r.lo, r.hi) for r in spanning_tree(_points(spark, x), 8192).collect()}
    assert len(found) == len(x) - 1 and found == whole
    total = sum(w for w, _, _ in brute.tree_edges(np.array(x)))
    assert np.isclose(sum(np.linalg.norm(np.subtract(x[a], x[b])) for a, b in found), total)


def test_numbering_of_sparse_ids(spark):
    rows = spark.range(0, 1_000_000).select((F.col("id") * 1_000_003 % 999_983_000_017).alias("k")).repartition(5)
    found = selection.numbered(rows, [F.col("k")], "n")
    assert found.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 999_999, 1_000_000)
    low = found.orderBy("n").limit(3).collect()
    assert [r.k for r in low] == sorted(r.k for r in low) and low[0].k == 0


@pytest.mark.parametrize("options", [{"block_rows": 6, "piece_rows": 5}, {}], ids=["parts", "whole"])
def test_lattice_clusters(spark, options):
    rows = [(i, list(p)) for i, p in enumerate(LATTICE + [(x + 9, y) for x, y in LATTICE])]
    table = spark.createDataFrame(rows, "row_id bigint, point array<double>")
    found = {r.row_id: r.cluster_id for r in density.cluster(table, "row_id", 5, **options).collect()}
    assert [found[i] for i in range(70)] == [0] * 35 + [1] * 35
