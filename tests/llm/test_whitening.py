"""Contour integration against a dense decomposition, and the whole query against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import whitening
from voxmill.llm.queries import QUERIES
from voxmill.llm.shared import read_table


def _spectrum(kind: int, width: int, draw: np.random.Generator) -> np.ndarray:
    return [
        draw.random(width) * 100,
        np.sort(draw.random(width)) ** 8 * 1e6,
        np.round(draw.random(width) * 5),
        1 + 1e-9 * draw.random(width),
        2.0 ** -np.arange(width),
    ][kind]


@pytest.mark.parametrize("kind", range(5))
def test_components_of_spectra(kind):
    """Spread, steep, repeated, nearly equal and halving eigenvalues."""
    draw = np.random.default_rng(kind)
    for _ in range(25):
        width = int(draw.integers(1, 70))
        axes, _ = np.linalg.qr(draw.standard_normal((width, width)))
        matrix = (axes * _spectrum(kind, width, draw)) @ axes.T
        matrix = (matrix + matrix.T) / 2
        dense = np.linalg.eigvalsh(matrix)[::-1]
        values, vectors = whitening.leading_components(matrix, 8)
        assert len(values) == min(8, (dense > 1e-12 * dense[0]).sum())
        assert np.abs(values - dense[: len(values)]).max(initial=0) <= 1e-12 * dense[0]
        assert np.abs(matrix @ vectors - vectors * values).max(initial=0) <= 1e-12 * dense[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) <= 1e-12


def test_inertia_counts():
    draw = np.random.default_rng(5)
    for width in (1, 2, 3, 8, 40):
        half = draw.standard_normal((width, width))
        matrix = half + half.T
        values = np.linalg.eigvalsh(matrix)
        for shift in (-3.0, 0.0, 0.5, float(values[0]) - 1, float(values[-1]) + 1):
            assert whitening.inertia_above(matrix, shift) == (values > shift).sum()
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert whitening.inertia_above(swap, 0.0) == 1
    assert whitening.leading_components(np.zeros((4, 4)), 8)[0].size == 0


def _check(found, vectors: dict[int, list[float]], components: int = 8) -> None:
    ids = sorted(vectors)
    x = [[math.floor(1024 * c) + 100_000 for c in vectors[i]] for i in ids]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(row, sums, strict=True)] for row in x], dtype=float) / n
    matrix = centred.T @ centred / n
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    white = centred @ axes / np.sqrt(values)
    got = np.zeros_like(white)
    place = {key: k for k, key in enumerate(ids)}
    for row in found:
        k = place[row.vec_id]
        got[k, row.component - 1] = row.whitened
        assert row.n == n
        assert row.deviation == sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))
        assert abs(row.explained / (values[row.component - 1] / np.trace(matrix)) - 1) < 1e-9
        assert row.identity_error < 1e-9
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    assert len(found) == white.size


def test_query(spark, data_dir):
    rows = read_table(spark, data_dir, "embeddings").collect()
    _check(QUERIES["op11_contour_whitening"](spark, data_dir).collect(), {r.vec_id: r.embedding for r in rows})


def test_odd_rows(spark):
    draw = np.random.default_rng(9)
    good = {k: draw.standard_normal(3).round(3).tolist() for k in range(20)}
    bad = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 1.0]),
        (105, [1e30, 0.0, 0.0]), (106, [1.0, 2.0]), (107, [1.0, 2.0, 3.0, 4.0]),
    ]
    schema = "vec_id long, embedding array<double>, v string, n int"
    table = spark.createDataFrame([(*row, "x", 1) for row in [*good.items(), *bad]], schema)
    _check(whitening.whiten(table).collect(), good, 3)
    # The order of rows and their split into tasks change no bit of what is fitted.
    rows = whitening.usable(table)
    one, many = whitening.fit(rows.repartition(1)), whitening.fit(rows.repartition(7, "vec_id"))
    assert (one.axes == many.axes).all() and (one.values == many.values).all()
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.where("vec_id = 3")).collect() == []
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []
    line = spark.createDataFrame([(None, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    found = whitening.whiten(line).collect()
    assert sorted((r.component, round(r.whitened**2, 9)) for r in found) == [(1, 0.0), (1, 1.5), (1, 1.5)]
    assert {round(r.explained, 12) for r in found} == {1.0}


def test_large_entries_stay_exact(spark):
    rows = {k: [float(2**28 * (k % 3)), float(k * 2**20), float(k % 2)] for k in range(40)}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = whitening.whiten(table).collect()
    n, x = 40, [[math.floor(1024 * c) + 100_000 for c in row] for row in rows.values()]
    sums = [sum(column) for column in zip(*x, strict=True)]
    exact = {k: sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for k, row in enumerate(x)}
    assert all(r.deviation == exact[r.vec_id] for r in found) and max(exact.values()) > 2**63
    as_long = whitening.whiten(table).select(whitening.as_long(F.col("deviation")).alias("d")).collect()
    assert any(r.d is None for r in as_long)
