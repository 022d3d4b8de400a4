"""The tree that is kept up to date against the tree of the rows that are left."""

from __future__ import annotations

from datetime import datetime, timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import spanning_tree as st
from voxmill.operators.growing_tree import GrowingTree
from voxmill.session import folder_names

START = datetime(2024, 1, 1)


def _rows(spark, numbered, day):
    rows = [(int(i), [float(v) for v in x], START + timedelta(days=day)) for i, x in numbered]
    return spark.createDataFrame(rows, "row_id long, x array<double>, at timestamp")


def _edges(x):
    return {(a, b) for _, a, b in brute.tree_edges(x)}


@pytest.mark.parametrize("width", [1, 2, 5])
def test_tree_over_many_boxes_and_levels(spark, width, monkeypatch):
    monkeypatch.setattr(st, "GROUP_LEVELS", 1)
    monkeypatch.setattr(st, "LEAF_ROWS", 3)
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.random((90, width)), 5 + rng.random((60, width)) / 10])
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vid long, x array<double>")
    found = {(r.lo, r.hi): r.w for r in st.spanning_tree(points, 11).collect()}
    assert set(found) == _edges(x)


def test_few_points_are_compared(spark, data_dir, monkeypatch):
    """Five-dimensional points without clusters, the hardest case: four times the points, far from 16 times the work."""
    monkeypatch.setattr(st, "LEAF_ROWS", 16)
    vectors = np.array([r.embedding[:5] for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").orderBy("vec_id").collect()])
    rng = np.random.default_rng(0)
    counts = []
    for copies in (8, 32):
        x = np.concatenate([vectors + rng.normal(0, 0.05, vectors.shape) for _ in range(copies)])
        points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vid long, x array<double>")
        packed = st.pack(st.split_into_boxes(points, 2_000)[0]).cache()
        boxes = st.Boxes.of(packed)
        compared = 0
        for pairs in boxes.rounds():
            between = st.compare(packed, pairs).cache()
            boxes.learn(between)
            compared += between.agg(F.sum("compared")).first()[0]
        counts.append(compared)
    assert counts[1] < 10 * counts[0] and counts[1] < len(x) ** 2 / 100


@pytest.mark.parametrize("case", ["spread", "blobs"])
def test_batches_give_the_tree_of_what_is_left(spark, tmp_path, case):
    rng = np.random.default_rng(4)
    if case == "spread":
        parts = [rng.random((40, 3)) for _ in range(4)]
    else:  # one far blob a batch, the last batch within the first blob
        parts = [np.array([9.0 * k, 0.0]) + rng.random((40, 2)) for k in (0, 1, 2, 0)]
    state = GrowingTree(spark, str(tmp_path / "state"), block_rows=16)
    told = []
    for batch, part in enumerate(parts):
        ids = range(40 * batch, 40 * batch + 40)
        told.append(state.advance(batch, _rows(spark, zip(ids, part, strict=True), batch)))
        x = np.concatenate(parts[: batch + 1])
        assert {(r.lo, r.hi) for r in state.tree(batch).collect()} == _edges(x)
    if case == "blobs":  # the last batch leaves the other blobs' boxes alone
        assert told[3]["boxes"] - told[3]["touched"] >= 5
    # A batch that is run again changes nothing.
    again = state.advance(3, _rows(spark, zip(range(120, 160), parts[3], strict=True), 3))
    assert again["compared"] == told[3]["compared"]
    assert {(r.lo, r.hi) for r in state.tree(3).collect()} == _edges(np.concatenate(parts))
    # Rows before the third day go; edges between what they kept apart come in.
    since = F.lit(START + timedelta(days=2))
    state.advance(4, _rows(spark, [(200, parts[0][0]), (201, parts[2][0])], 4), since)
    left = [*range(80, 160), 200]
    x = np.concatenate([parts[2], parts[3], parts[0][:1]])
    assert {(r.lo, r.hi) for r in state.tree(4).collect()} == {(left[a], left[b]) for a, b in _edges(x)}
    rows = {r.row_id: r.vid for r in state.rows(4).collect()}
    assert rows == {**{i: i for i in left}, 201: 80}
    assert folder_names(spark, str(tmp_path / "state" / "index")) == ["batch=3", "batch=4"]
    # Nothing comes, everything goes.
    state.advance(5, _rows(spark, [], 5), F.lit(START + timedelta(days=9)))
    assert state.tree(5).collect() == [] and state.rows(5).collect() == []
    state.advance(6, _rows(spark, [(7, parts[0][5]), (8, parts[0][5])], 6))
    assert state.tree(6).collect() == [] and {r.vid for r in state.rows(6).collect()} == {7}


def test_a_batch_without_its_mark_did_not_happen(spark, tmp_path):
    state = GrowingTree(spark, str(tmp_path), block_rows=8)
    x = np.random.default_rng(1).random((20, 2))
    state.advance(0, _rows(spark, enumerate(x), 0))
    state._write(_rows(spark, [(99, [9.0, 9.0])], 0).withColumn("box", F.lit(1).cast("long")), "rows", 1)
    state._commit(1, "cuts", [], "box bigint, axis int, at double")
    assert state.batches() == [0]
    state.advance(1, _rows(spark, [(30, [0.5, 0.5])], 1))
    assert {(r.lo, r.hi) for r in state.tree(1).collect()} == {
        tuple(sorted(30 if i == 20 else i for i in e)) for e in _edges(np.vstack([x, [0.5, 0.5]]))
    }
