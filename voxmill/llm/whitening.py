"""Whitening of embeddings by their leading principal components (FEAST).

1. Vectors become whole numbers.  Sums, and then products of the centred
   numbers, are added up in whole numbers too, task by task; so the covariance
   does not depend on the order of rows, tasks or retries.
2. The covariance (width squared, however many rows there are) is taken apart
   in the driver.  Inertia counts of shifted factorisations say how many
   eigenvalues lie above a value; bisection with them cuts out intervals that
   together hold the leading components.  On each interval, a quadrature over a
   contour of complex shifted solves projects random vectors onto the
   interval's eigenspace (Polizzi: "Density-matrix-based algorithm for solving
   eigenvalue problems", 2009), Rayleigh-Ritz extracts the eigenpairs, and the
   inertia counts verify that none is missed.
3. One pass projects all rows.  Another one measures the covariance of the
   result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LIMIT = 2.0**40  # of an entry times SCALE; beyond, sums of long could overflow
QUADRATURE = 8  # nodes of the upper half of a contour
ROUNDS = 30  # of refining one interval
EXACT = 2.0**53  # whole numbers below are exact as double

_ROWS = 4_096  # rows multiplied at once


# --- sums over all rows -------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows ``(vec_id, v)`` whose vector has only finite entries that fit; ``v`` holds whole numbers.

    An entry ``c`` becomes ``floor(1024 * c) + 100000``.  Entries of 2 ** 30
    and more in size count as not finite.  An empty vector goes.
    """
    values = F.col("v").cast("array<double>")
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LIMIT))
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    rows = only(vectors, vec_id=vec_id, v=embedding).withColumn("v", values)
    # A condition of the value itself: filters may be moved, and large entries would overflow.
    kept = F.when((F.size("v") > 0) & fits, whole)
    return rows.select(F.col("vec_id").cast("long"), kept.alias("v")).where(F.col("v").isNotNull())


def _matrix(column: pa.ListArray, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """The commonest width (the larger of equally common ones), its rows and exact sums by dimension."""
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width"))
    found = widths.first()
    if found is None:
        return 0, 0, []
    width, n = found
    sums = (
        rows.where(F.size("v") == width)
        .select(F.posexplode("v").alias("i", "x"))
        .groupBy("i")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
        .collect()
    )
    return width, n, [int(row.s) for row in sorted(sums)]


def _multiplier(width: int, centre: list[int]):
    """Upper triangle of the sum of products of centred rows, in two whole parts per entry."""

    def exact_products(x: np.ndarray) -> np.ndarray:
        most = float(np.abs(x).max(initial=1))
        step = int(min(_ROWS, EXACT // (most * most)))
        if step < 1:  # entries too large for exact doubles
            wide = x.astype(object)
            return wide.T @ wide
        total = np.zeros((width, width), object)
        for at in range(0, len(x), step):
            part = x[at : at + step].astype(float)
            total = total + (part.T @ part).astype(np.int64)
        return total

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, np.int64)
        total = np.zeros((width, width), object)
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                total = total + exact_products(_matrix(batch.column(0), width) - middle)
        if seen:
            i, j = np.triu_indices(width)
            values = total[i, j]
            columns = [
                pa.array(i, pa.int32()),
                pa.array(j, pa.int32()),
                pa.array([int(v) >> 30 for v in values], pa.int64()),
                pa.array([int(v) & ((1 << 30) - 1) for v in values], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])

    return multiply


def covariance(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor ``n``) of the whole numbers, correctly rounded entry by entry.

    Rows are centred at the whole number next to the mean before they are
    multiplied; what is left of the mean is taken off exactly.
    """
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    products = (
        rows.where(F.size("v") == width)
        .select("v")
        .mapInArrow(_multiplier(width, centre), "i int, j int, high long, low long")
        .groupBy("i", "j")
        .agg(*(F.sum(F.col(part).cast("decimal(38,0)")).alias(part) for part in ("high", "low")))
        .collect()
    )
    matrix = np.zeros((width, width))
    for i, j, high, low in products:
        exact = n * ((int(high) << 30) + int(low)) - rest[i] * rest[j]
        matrix[i, j] = matrix[j, i] = exact / (n * n)
    return matrix


# --- eigenpairs of the covariance ---------------------------------------------


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``: positive pivots of a symmetric factorisation.

    Diagonal pivoting with blocks of one and two (Bunch and Parlett, 1971), so
    the count is stable for indefinite matrices.
    """
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    alpha = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        largest = off.max()
        if diagonal[r] == 0 and largest == 0:
            break
        keep = np.ones(len(a), bool)
        if diagonal[r] >= alpha * largest:
            above += a[r, r] > 0
            keep[r] = False
            column = a[keep, r]
            a = a[np.ix_(keep, keep)] - np.outer(column, column) / a[r, r]
        else:
            p, q = np.unravel_index(off.argmax(), off.shape)
            pivot = a[np.ix_([p, q], [p, q])]
            above += int((np.linalg.eigvalsh(pivot) > 0).sum())
            keep[[p, q]] = False
            columns = a[np.ix_(keep, [p, q])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(pivot, columns.T)
    return int(above)


def _intervals(matrix: np.ndarray, wanted: int, largest: int) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, count)`` from the top that hold at least ``wanted`` eigenvalues.

    An interval holds at most ``largest``, unless its eigenvalues are equal to
    working precision.
    """
    radius = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    smallest = 1e-13 * radius
    wanted = min(wanted, inertia_above(matrix, smallest))
    found: list[tuple[float, float, int]] = []
    held = 0
    open_ = [(smallest, radius * (1 + 1e-6), inertia_above(matrix, smallest))]
    while open_ and held < wanted:
        low, high, count = open_.pop()
        if count <= largest or high - low <= smallest:
            found.append((low, high, count))
            held += count
            continue
        middle = (low + high) / 2
        upper = inertia_above(matrix, middle) - held
        # The upper half is looked at first.
        open_.extend(part for part in ((low, middle, count - upper), (middle, high, upper)) if part[2])
    return found


def _contour(matrix: np.ndarray, low: float, high: float, count: int, size: int) -> tuple[float, np.ndarray]:
    """A subspace of ``count`` vectors for the eigenvalues within ``(low, high]``, and its largest residual."""
    width = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    # Gauss-Legendre nodes on the upper half circle; the lower half is its conjugate.
    nodes, weights = np.polynomial.legendre.leggauss(QUADRATURE)
    turns = np.exp(1j * np.pi / 2 * (1 - nodes))
    basis = np.random.default_rng(7).standard_normal((width, size))
    best, space = np.inf, basis[:, :0]
    for _ in range(ROUNDS):
        projected = np.zeros((width, size))
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(width) - matrix, basis.astype(complex))
            projected += weight / 2 * (radius * turn * solved).real
        basis, _ = np.linalg.qr(projected)
        values, basis = _rayleigh_ritz(matrix, basis)
        residuals = np.abs(matrix @ basis - basis * values).max(axis=0)
        # A subspace larger than the eigenspace has stray values too, of large residual.
        inside = np.flatnonzero((values > low) & (values <= high))
        inside = inside[np.argsort(residuals[inside], kind="stable")][:count]
        if len(inside) == count:
            residual = float(residuals[inside].max())
            if residual >= best / 2:
                break
            best, space = residual, basis[:, inside]
    return best, space


def _rayleigh_ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of the matrix within the span of an orthonormal basis."""
    inner = basis.T @ matrix @ basis
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return values, basis @ vectors


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """Orthonormal vectors that span the eigenspaces of the ``count`` eigenvalues within ``(low, high]``."""
    width = len(matrix)
    enough = 1e-13 * np.abs(matrix).sum(axis=1).max()
    size = min(width, count + max(4, count // 2))
    best, space = _contour(matrix, low, high, count, size)
    # Eigenvalues just outside slow the refinement down; a larger subspace takes them in.
    while best > enough and size < width:
        size = min(width, 2 * size)
        again, other = _contour(matrix, low, high, count, size)
        if again < best:
            best, space = again, other
    if best > 1e3 * enough:
        raise RuntimeError(f"{count} eigenvalues lie in ({low}, {high}], not all were found")
    return space


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by fall and unit eigenvectors as columns: ``wanted``, or all above rounding if fewer."""
    wanted = min(wanted, len(matrix))
    spaces = [feast(matrix, *interval) for interval in _intervals(matrix, wanted, max(wanted, 8))]
    if not spaces:
        return np.empty(0), np.empty((len(matrix), 0))
    # Once more over all intervals: eigenvalues close to each other may lie in two of them.
    basis, _ = np.linalg.qr(np.concatenate(spaces, axis=1))
    values, vectors = _rayleigh_ritz(matrix, basis)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    rounding = 1e-12 * float(np.abs(matrix).sum(axis=1).max())
    if inertia_above(matrix, float(values[-1]) + rounding) > len(values):
        raise RuntimeError("the inertia counts more eigenvalues than were found")
    return values, vectors


# --- projection ---------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted whitening: what ``apply`` needs, a few numbers per dimension."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues by fall
    axes: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float = float("nan")

    @property
    def width(self) -> int:
        return len(self.sums)


def _whitened(column: pa.ListArray, fitted: Whitening) -> np.ndarray:
    # n * x - S would overflow for many rows, x minus the whole part of the mean does not.
    n = fitted.n
    whole = np.array([s // n for s in fitted.sums], np.int64)
    rest = np.array([(s % n) / n for s in fitted.sums])
    centred = (_matrix(column, fitted.width) - whole).astype(float) - rest
    return centred @ fitted.axes / np.sqrt(fitted.values)


def _checker(fitted: Whitening):
    size = len(fitted.values)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            rows = _whitened(batch.column(0), fitted)
            total += rows.sum(axis=0)
            products += rows.T @ rows
        i, j = np.indices((size, size))
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(products.ravel())]
        columns.append(pa.array(np.repeat(total, size)))
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "product", "total"])

    return check


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to all rows of ``usable``; None without any."""
    width, n, sums = _sums(rows)
    if not n:
        return None
    matrix = covariance(rows, width, n, sums)
    values, axes = leading_components(matrix, components)
    fitted = Whitening(n, sums, values, axes, float(np.trace(matrix)))
    if len(values):
        same = rows.where(F.size("v") == width).select("v")
        measured = same.mapInArrow(_checker(fitted), "i int, j int, product double, total double")
        found = measured.groupBy("i", "j").agg(F.sum("product"), F.sum("total")).collect()
        means = {i: total / n for i, j, _, total in found}
        errors = [abs(product / n - means[i] * means[j] - (i == j)) for i, j, product, _ in found]
        fitted.identity_error = max(errors)
    return fitted


_WHITENED = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


def _applier(fitted: Whitening):
    size = len(fitted.values)

    def deviations(x: np.ndarray) -> list[int]:
        """Sum of (n * x - S) squared: whole numbers of any length where they don't fit into long."""
        n, most = fitted.n, max(int(np.abs(x).max(initial=0)), max(map(abs, fitted.sums)) // fitted.n)
        if len(fitted.sums) * (2 * n * (most + 1)) ** 2 < 2**63:
            apart = n * x - np.array(fitted.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = n * x.astype(object) - np.array(fitted.sums, object)
        return (apart * apart).sum(axis=1).tolist()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        explained = np.asarray(fitted.values) / fitted.trace
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            apart = deviations(_matrix(batch.column(1), fitted.width))
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), size))),
                pa.array(np.tile(np.arange(1, size + 1), rows), pa.int32()),
                pa.array(np.full(rows * size, fitted.n), pa.int64()),
                pa.array([Decimal(d) for d in apart for _ in range(size)], pa.decimal128(38, 0)),
                pa.array(_whitened(batch.column(1), fitted).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * size, fitted.identity_error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return apply


def apply(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """Each row of ``usable`` on each component."""
    same = rows.where(F.size("v") == fitted.width)
    return same.mapInArrow(_applier(fitted), _WHITENED)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Rows without a vector, with null, non-finite or too large entries, or of
    another width than the commonest one (of equally common ones: the largest)
    are left out and not fitted to.  A null id stays null, rows that repeat an
    id stay rows of their own.  A component without variance beyond rounding is
    left out, so fewer than ``components`` come from few distinct rows, and no
    rows from one.  ``deviation`` is exact up to 38 digits.
    """
    rows = usable(vectors, vec_id, embedding)
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], _WHITENED)
    return apply(rows, fitted)


def as_long(value: Column) -> Column:
    """Null where a whole number is too long for long."""
    return value.try_cast("long")
