"""Exact Euclidean minimum spanning tree of a point table.

1. Points are cut into boxes of at most ``block_rows`` points by the cuts of a
   k-d tree, which a bounded sample of the points suggests.  Each box orders
   its points by small leaves and makes its own tree, once, by halves.
2. The tree of all points lies within the boxes' trees and, for each two boxes,
   the edges between them of the tree of both.  Each box has one point amid most
   others, its middle; a box whose tree falls into large parts is one box for
   each.  Near boxes tell by how long steps one gets from middle to middle.
3. An edge between two points is in the tree only if it is no longer than the
   longest step on the way over both their middles.  So a point visits only
   boxes within its longest step to its middle, or within that between the
   middles, and meets only the points there that are as near.
4. Two boxes of which one would visit the other with most of its points are not
   compared point by point.  Their edges and pairs of leaves are taken by rising
   length; a pair of leaves that is one component by then is skipped, and one of
   two components gives one edge.
5. The edges that may be in the tree meet by groups of neighbouring boxes.  What
   closes a circle within a group goes; what can be in no other circle is sure;
   and each way between points with edges to other groups becomes one edge for
   the next, larger groups.

Only the boxes (their bounds, at most ``MOST_BOXES``) visit the driver.

Edges have one total order everywhere: squared length, then smaller end, then
larger end.  Squares are summed axis by axis in all places, bounds included, so
an edge has the same square wherever it is met; roots are taken at the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.joins import lookup_join
from voxmill.session import cut_lineage, scratch, ship_with_tasks

BLOCK_ROWS = 8192
LEAF_ROWS = 64
SMALL_ROWS = 192  # whose tree is made point by point
MOST_BOXES = 65_536  # of one tree; with more points, boxes have more rows than ``block_rows``
SAMPLE_ROWS = 200_000  # points that suggest cuts at once
NEAR_BOXES = 6  # compared with each box at first
GROUP_LEVELS = 5  # boxes of 2 ** this meet in one group
PART_LEVELS = 3  # a part of a box has more than one in 2 ** this of its points
VISIT_BYTES = 16_000_000  # that a task hands over at once
_POINTS = ("ids", "xs", "ends", "squares")
_TREE = "lo bigint, hi bigint, w double"
_PACKED = (
    "box bigint, n bigint, ids binary, xs binary, ends binary, squares binary, "
    "low array<double>, high array<double>, longest double"
)
_BETWEEN = "a bigint, b bigint, compared bigint, edges array<struct<w:double,lo:bigint,hi:bigint>>"
_VISITS = "b bigint, a bigint, ids binary, xs binary, ends binary, squares binary, reach binary"
_GRAPH = "u bigint, v bigint, w double, lo bigint, hi bigint, sure boolean, grp bigint"

ship_with_tasks(__name__)


def spanning_tree(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(lo, hi, w)`` of the minimum spanning tree of ``(vid, x)``.

    ``x`` are distinct points of equal width, ``vid`` distinct whole numbers.
    Equal lengths are ordered by their end points.
    """
    return tree_of_boxes(split_into_boxes(points, block_rows)[0])


def tree_of_boxes(boxed: DataFrame) -> DataFrame:
    """The same of points ``(vid, x, box)`` as ``split_into_boxes`` gives them."""
    with scratch(boxed.sparkSession) as hand_over:
        whole = cut_lineage(pack(boxed))
        packed = cut_lineage(whole.mapInArrow(_parts, _PACKED))
        boxes = Boxes.of(packed)
        between = []
        if len(boxes.number) > 1:
            steps = boxes.known(steps_between(packed, boxes.first()))
            visits = cut_lineage(visiting(packed, boxes, steps))
            between.append(cut_lineage(visited(packed, visits, len(boxes.number))))
            most = visits.where(F.col("ids").isNull())
            pairs = most.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            between.append(cut_lineage(compare(packed, pairs)))
        tree = hand_over(solve(packed, between, boxes.depth))
    edges = tree.count()
    if edges != max(boxes.points - 1, 0):
        raise RuntimeError(f"{edges} edges for {boxes.points} points: no tree")
    return tree.withColumn("w", F.sqrt("w"))


# --- boxes ------------------------------------------------------------------


def _depth(box: Column) -> Column:
    return F.length(F.bin(box)) - 1


def _ancestor(box: Column, level: int) -> Column:
    """The box ``level`` levels below the top that contains ``box`` (or ``box`` itself)."""
    down = F.greatest(_depth(box) - level, F.lit(0))
    return F.call_function("shiftright", box, down)


def _matrix(column: pa.ListArray) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1 if rows else 0)


@dataclass
class Cuts:
    """Where boxes are cut in two, by box number: 1 is cut into 2 and 3, these into 4 to 7, ..."""

    at: dict[int, tuple[int, float]] = field(default_factory=dict)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The box of each point."""
        box = np.ones(len(x), np.int64)
        if not self.at or not len(x):
            return box
        known = np.array(sorted(self.at), np.int64)
        axis = np.array([self.at[b][0] for b in known.tolist()])
        cut = np.array([self.at[b][1] for b in known.tolist()])
        open_ = np.arange(len(x))
        while len(open_):
            place = np.minimum(np.searchsorted(known, box[open_]), len(known) - 1)
            inner = known[place] == box[open_]
            open_, place = open_[inner], place[inner]
            box[open_] = 2 * box[open_] + (x[open_, axis[place]] > cut[place])
        return box

    def grow(self, box: int, x: np.ndarray, rows: int) -> None:
        """Cut a box until no part holds more than ``rows`` of the points ``x`` (or just equal ones)."""
        open_ = [(box, x)]
        while open_:
            box, x = open_.pop()
            if len(x) <= rows:
                continue
            sides = x.max(axis=0) - x.min(axis=0)
            axis = int(sides.argmax())
            if not sides[axis] > 0:
                continue
            values = x[:, axis]
            middle = (len(x) - 1) // 2
            cut = np.partition(values, middle)[middle]
            if cut == values.max():  # both halves must have points
                cut = values[values < cut].max()
            self.at[box] = axis, float(cut)
            upper = values > cut
            open_.extend([(2 * box, x[~upper]), (2 * box + 1, x[upper])])

    def boxed(self, points: DataFrame) -> DataFrame:
        """``(vid, x, box)`` of ``(vid, x)``."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                box = pa.array(self.find(_matrix(batch.column(1))), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, box], ["vid", "x", "box"])

        rows = points.select(F.col("vid").cast("bigint"), F.col("x").cast("array<double>"))
        return rows.mapInArrow(place, "vid bigint, x array<double>, box bigint")


def split_into_boxes(points: DataFrame, block_rows: int, cuts: Cuts | None = None) -> tuple[DataFrame, Cuts]:
    """``(vid, x, box)`` with at most ``block_rows`` points a box, and the cuts.

    Cuts come from a sample of at most about ``SAMPLE_ROWS`` points of the boxes
    that are still too large, until none is; given ``cuts`` are kept.  With more
    than ``MOST_BOXES / 2`` times ``block_rows`` points, boxes get larger.
    """
    cuts = Cuts(dict(cuts.at)) if cuts else Cuts()
    while True:
        boxed = cuts.boxed(points)
        sizes = dict(map(tuple, boxed.groupBy("box").agg(F.count("*")).collect()))
        limit = max(block_rows, -(-2 * sum(sizes.values()) // MOST_BOXES))
        full = sorted(box for box, n in sizes.items() if n > limit)
        if not full:
            return boxed, cuts
        step = -(-sum(sizes[box] for box in full) // SAMPLE_ROWS)
        some = boxed.where(F.col("box").isin(full) & (F.pmod(F.xxhash64("vid"), F.lit(step)) == 0))
        sample = some.select("box", "x").toArrow()
        where = sample.column("box").to_numpy()
        x = _matrix(sample.column("x").combine_chunks())
        for box in full:
            cuts.grow(box, x[where == box], max(1, int(limit * 0.9 / step)) if step > 1 else limit)
        for box in (b for b in full if b not in cuts.at):  # no two sampled points differ
            ends = boxed.where(F.col("box") == box).select(F.posexplode("x").alias("i", "c"))
            low, high, axis = max(
                (low, high, i) for i, low, high in ends.groupBy("i").agg(F.min("c"), F.max("c")).collect() if low < high
            )
            half = low + (high - low) / 2
            cuts.at[box] = axis, half if half < high else low


# --- one box ----------------------------------------------------------------


def _squares(differences: np.ndarray) -> np.ndarray:
    """Squared lengths of the last axis, summed from first to last."""
    total = np.zeros(differences.shape[:-1])
    for axis in range(differences.shape[-1]):
        total += differences[..., axis] ** 2
    return total


def _gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances between bounds."""
    return _squares(np.maximum(0.0, np.maximum(other_low - high, low - other_high)))


def _small_tree(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (by place) and squares of the spanning tree of a few points (Prim); equal lengths go by ends."""
    by_id = np.argsort(ids)
    x = x[by_id]
    n = len(x)
    best = np.full(n, np.inf)
    nearest = np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    current, ends, squares = 0, [], []
    for _ in range(n - 1):
        d2 = _squares(x - x[current])
        closer = outside & ((d2 < best) | ((d2 == best) & (current < nearest)))
        best[closer], nearest[closer] = d2[closer], current
        open_ = np.where(outside, best, np.inf)
        tied = np.flatnonzero(open_ == open_.min())
        lo, hi, current = min((min(i, nearest[i]), max(i, nearest[i]), i) for i in tied)
        outside[current] = False
        ends.append((lo, hi))
        squares.append(float(best[current]))
    return by_id[np.array(ends, np.int64).reshape(-1, 2)].astype(np.int32), np.array(squares)


def _own_tree(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the points of a box in leaf order: the trees of two halves and the edges between them."""
    if len(ids) <= SMALL_ROWS:
        return _small_tree(ids, x)
    half = _half(len(ids))
    sides = [_Box(i, y, *_own_tree(i, y)) for i, y in ((ids[:half], x[:half]), (ids[half:], x[half:]))]
    tree, _, _ = joined_tree(*sides)
    return np.array([edge[3:] for edge in tree], np.int32), np.array([edge[0] for edge in tree])


def _half(rows: int) -> int:
    """A whole number of leaves, about half of the rows."""
    return (rows + 2 * LEAF_ROWS - 1) // (2 * LEAF_ROWS) * LEAF_ROWS




def _leaf_order(x: np.ndarray) -> np.ndarray:
    """Places of the points such that each run of LEAF_ROWS lies close together."""
    order = np.arange(len(x))
    open_ = [(0, len(x))]
    while open_:
        start, end = open_.pop()
        if end - start <= LEAF_ROWS:
            continue
        part = order[start:end]
        values = x[part]
        axis = (values.max(axis=0) - values.min(axis=0)).argmax()
        half = _half(end - start)
        order[start:end] = part[np.argpartition(values[:, axis], half)]
        open_.extend([(start, start + half), (start + half, end)])
    return order


def _pack_box(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["vid"].to_numpy(np.int64)
    x = np.stack(rows["x"].to_numpy()).astype(float)
    # By id first, so that the order of the rows is of no account.
    order = np.argsort(ids)
    order = order[_leaf_order(x[order])]
    ids, x = ids[order], x[order]
    ends, squares = _own_tree(ids, x)
    return pd.DataFrame([{"box": rows["box"].iloc[0], **_told(ids, x, ends, squares)}])


def _told(ids: np.ndarray, x: np.ndarray, ends: np.ndarray, squares: np.ndarray) -> dict[str, object]:
    return {
        "n": len(ids),
        "ids": ids.tobytes(),
        "xs": x.tobytes(),
        "ends": ends.tobytes(),
        "squares": squares.tobytes(),
        "low": x.min(axis=0),
        "high": x.max(axis=0),
        "longest": float(squares.max(initial=0.0)),
    }


def pack(boxed: DataFrame) -> DataFrame:
    """One row per box: its points in leaf order, its own tree and its bounds."""
    return boxed.groupBy("box").applyInPandas(_pack_box, _PACKED)


class _Box:
    """Points in leaf order with their tree."""

    @classmethod
    def unpack(cls, ids: bytes, xs: bytes, ends: bytes, squares: bytes) -> _Box:
        names = np.frombuffer(ids, np.int64)
        x = np.frombuffer(xs).reshape(len(names), -1)
        return cls(names, x, np.frombuffer(ends, np.int32).reshape(-1, 2), np.frombuffer(squares))

    def __init__(self, ids: np.ndarray, x: np.ndarray, ends: np.ndarray, squares: np.ndarray) -> None:
        self.ids, self.x, self.ends, self.squares = ids, x, ends, squares
        starts = range(0, len(self.ids), LEAF_ROWS)
        self.leaves = [slice(start, start + LEAF_ROWS) for start in starts]
        self.low = np.array([self.x[leaf].min(axis=0) for leaf in self.leaves])
        self.high = np.array([self.x[leaf].max(axis=0) for leaf in self.leaves])
        # The tree edges within each leaf, from either end: (from, to, square), by their first end.
        leaf = self.ends // LEAF_ROWS
        inside = np.flatnonzero(leaf[:, 0] == leaf[:, 1])
        ways = np.concatenate([self.ends[inside], self.ends[inside][:, ::-1]])
        squares = np.concatenate([self.squares[inside]] * 2)
        order = np.argsort(ways[:, 0], kind="stable")
        ways, squares = ways[order], squares[order]
        bounds = np.searchsorted(ways[:, 0], [leaf.start for leaf in self.leaves] + [len(self.ids)])
        self.within = [
            (ways[i:j] - leaf.start, squares[i:j]) for leaf, i, j in zip(self.leaves, bounds, bounds[1:], strict=False)
        ]

    @cached_property
    def reach(self) -> np.ndarray:
        """The longest square on each point's way to the middle."""
        return _middles(len(self.ids), self.ends, self.squares, len(self.ids))[1]

    def beaten(self, leaf: int, some: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Which entries of ``d2`` (other points by ``some`` points of the leaf) another of these points beats.

        That is so if it lies closer to the other point and has a tree edge, shorter too, to this one.
        """
        out = np.zeros(d2.shape, bool)
        ways, squares = self.within[leaf]
        place = np.full(LEAF_ROWS, -1)
        place[some] = np.arange(len(some))
        ways = place[ways]
        both = (ways >= 0).all(axis=1)
        ways, squares = ways[both], squares[both]
        if len(ways):
            far = d2[:, ways[:, 0]]
            longer = (far > d2[:, ways[:, 1]]) & (far > squares)
            points, starts = np.unique(ways[:, 0], return_index=True)
            out[:, points] = np.logical_or.reduceat(longer, starts, axis=1)
        return out


class _Joined:
    """Components of the points of two boxes."""

    def __init__(self, count: int) -> None:
        self.parent = list(range(count))
        self.left = count

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[y] = x
        self.left -= 1
        return True


Edge = tuple[float, int, int, int, int]


def joined_tree(a: _Box, b: _Box) -> tuple[list[Edge], list[Edge], int]:
    """The tree of two boxes, those of its edges that go between them, and how many pairs of points were compared.

    An edge is its square, its ends by id, smaller first, and its ends by place.
    """
    first = len(a.ids)
    ids = np.concatenate([a.ids, b.ids])
    joined = _Joined(len(ids))
    ends = np.concatenate([a.ends, b.ends + first])
    squares = np.concatenate([a.squares, b.squares])
    lo, hi = np.sort(ids[ends], axis=1).T if len(ends) else (ids[:0], ids[:0])
    order = np.lexsort((hi, lo, squares))
    own = list(zip(squares[order].tolist(), lo[order].tolist(), hi[order].tolist(), *ends[order].T.tolist(), strict=True))
    apart = _squares(
        np.maximum(0.0, np.maximum(b.low[None] - a.high[:, None], a.low[:, None] - b.high[None]))
    )
    # Pairs of leaves by the length from which on they have not been looked at.
    open_ = [(float(gap), i, j) for (i, j), gap in np.ndenumerate(apart)]
    heapify(open_)
    usual = float(np.quantile(squares, 0.9)) if len(squares) else 0.0
    whole: dict[tuple[int, int], int] = {}  # leaves that are one component, with a point of it

    def components(side: int, leaf: int, box: _Box) -> np.ndarray:
        shift = first * side
        if (known := whole.get((side, leaf))) is not None:
            return np.array([joined.root(known)])
        found = np.array([joined.root(i) for i in range(shift + box.leaves[leaf].start, shift + min(box.leaves[leaf].stop, len(box.ids)))])
        if (found == found[0]).all():
            whole[side, leaf] = int(found[0])
            return found[:1]
        return found

    tree: list[Edge] = []
    between: list[Edge] = []
    pending: list[Edge] = []
    k = compared = 0
    while joined.left > 1:
        event = own[k] if k < len(own) else None
        if pending and (event is None or pending[0] < event):
            event = pending[0]
        if open_ and (event is None or open_[0][0] <= event[0]):
            since, i, j = heappop(open_)
            ca, cb = components(0, i, a), components(1, j, b)
            if len(ca) == len(cb) == 1 and ca[0] == cb[0]:
                continue
            # For now, edges up to a length; by the next time much may have been joined.
            until = max(2 * since, usual, event[0]) or np.inf if event is not None else np.inf
            xa, xb = a.x[a.leaves[i]], b.x[b.leaves[j]]
            near_a = _squares(np.maximum(0.0, np.maximum(b.low[j] - xa, xa - b.high[j]))) <= until
            near_b = _squares(np.maximum(0.0, np.maximum(a.low[i] - xb, xb - a.high[i]))) <= until
            # Against a leaf that is one component, only points of others count.
            some = np.flatnonzero(near_a & (ca != cb[0]) if len(cb) == 1 else near_a)
            others = np.flatnonzero(near_b & (cb != ca[0]) if len(ca) == 1 else near_b)
            if until < np.inf:
                heappush(open_, (until, i, j))
            if not len(some) or not len(others):
                continue
            d2 = _squares(xa[some][:, None] - xb[others][None])
            compared += d2.size
            keep = d2 <= until
            if len(ca) == len(cb) == 1:  # two components: their first edge
                keep &= d2 == d2.min()
            elif len(ca) > 1 and len(cb) > 1:
                keep &= ca[some][:, None] != cb[others][None]
            if len(some) > 1 and len(others) > 1:
                keep &= ~b.beaten(j, others, d2) & ~a.beaten(i, some, d2.T).T
            ia, ib = a.ids[a.leaves[i]], b.ids[b.leaves[j]]
            rows, columns = np.nonzero(keep)
            found = d2[rows, columns]
            rows, columns = some[rows], others[columns]
            for w, p, q in zip(found.tolist(), rows.tolist(), columns.tolist(), strict=True):
                one, two = int(ia[p]), int(ib[q])
                heappush(pending, (w, min(one, two), max(one, two), i * LEAF_ROWS + p, first + j * LEAF_ROWS + q))
            continue
        if event is None:
            raise RuntimeError("two boxes have no edge between them")
        if pending and event is pending[0]:
            heappop(pending)
            if joined.join(event[3], event[4]):
                tree.append(event)
                between.append(event)
        else:
            k += 1
            if joined.join(event[3], event[4]):
                tree.append(event)
    return tree, between, compared


# --- ways to the middle of a box, and what they spare -------------------------


def _middles(count: int, ends: np.ndarray, squares: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Each point's middle and the longest square on its way there over the tree.

    By rising length the smaller component joins the larger one's middle; two of more than ``least``
    points stay apart, as parts with a middle each.
    """
    up, level, size = list(range(count)), [0.0] * count, [1] * count

    def middle(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for k in np.argsort(squares, kind="stable").tolist():
        one, two = (middle(x) for x in ends[k].tolist())
        if size[one] < size[two]:
            one, two = two, one
        if size[two] <= least:
            up[two], level[two] = one, float(squares[k])
            size[one] += size[two]
    # What joins last is longest: the level of the last point before the middle.
    last, above = np.arange(count), np.array(up, np.int64)
    while (inner := above[above[last]] != above[last]).any():
        last[inner] = above[last[inner]]
    return above[last], np.array(level)[last]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed boxes; one whose tree falls into large parts becomes a box for each, without the edges between."""
    for batch in batches:
        for row in batch.to_pylist():
            box = _Box.unpack(*(row[name] for name in _POINTS))
            middle, _ = _middles(len(box.ids), box.ends, box.squares, len(box.ids) >> PART_LEVELS)
            names = np.unique(middle)
            if len(names) == 1:
                yield pa.RecordBatch.from_pylist([row], batch.schema)
                continue
            for part, name in enumerate(names.tolist()):
                some = np.flatnonzero(middle == name)
                some = some[_leaf_order(box.x[some])]
                place = np.full(len(box.ids), -1, np.int32)
                place[some] = np.arange(len(some))
                inside = (middle[box.ends] == name).all(axis=1)
                told = _told(box.ids[some], box.x[some], place[box.ends[inside]], box.squares[inside])
                yield pa.RecordBatch.from_pylist([{"box": row["box"] << PART_LEVELS | part, **told}], batch.schema)


def _step(a: _Box, b: _Box) -> float:
    """The longest square on the best way from middle to middle over one edge between two boxes."""
    low_a, low_b = (np.array([box.reach[leaf].min() for leaf in box.leaves]) for box in (a, b))
    least = np.maximum(_gaps(a.low[:, None], a.high[:, None], b.low, b.high), np.maximum(low_a[:, None], low_b))
    best = np.inf
    for place in np.argsort(least, axis=None).tolist():
        i, j = divmod(place, len(b.leaves))
        if least[i, j] >= best:
            break
        d2 = _squares(a.x[a.leaves[i]][:, None] - b.x[b.leaves[j]][None])
        best = min(best, float(np.maximum(d2, np.maximum(a.reach[a.leaves[i]][:, None], b.reach[b.leaves[j]])).min()))
    return best


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps = [_step(*sides) for sides in _sides(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(steps, pa.float64())], ["a", "b", "w"])


def visiting(packed: DataFrame, boxes: Boxes, steps: Mapping[tuple[int, int], float]) -> DataFrame:
    """The points of each box ``a`` that may have an edge in ``b``, with the squares up to which.

    Rows without points name pairs of boxes of which most points would go.  Of two boxes, the points
    of the first go as far as from middle to middle; those of the second only as far as to their own.
    """
    order, jumps = _linked(len(boxes.number), sorted((w, k, l) for (k, l), w in steps.items()))
    view = Boxes(boxes.number, boxes.low, boxes.high, boxes.longest, boxes.points, None)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("b", pa.int64()), ("a", pa.int64()), *((n, pa.binary()) for n in (*_POINTS, "reach"))])
            for row in batch.to_pylist():
                box = _Box.unpack(*(row[name] for name in _POINTS))
                k = int(np.searchsorted(view.number, row["box"]))
                steps = np.zeros(len(order))
                steps[order] = _longest(jumps, at[k])
                steps[:k] = 0.0
                rows, size = [], 0
                for l in np.flatnonzero(view.gaps(k) <= np.maximum(steps, box.reach.max())).tolist():
                    reach = np.maximum(steps[l], box.reach)
                    some = np.flatnonzero(_gaps(box.x, box.x, view.low[l], view.high[l]) <= reach)
                    if l == k or not len(some):
                        continue
                    told = {"b": int(view.number[l]), "a": row["box"]}
                    if 2 * len(some) <= len(box.ids):
                        told |= {"ids": box.ids[some].tobytes(), "xs": box.x[some].tobytes(), "reach": reach[some].tobytes()}
                        size += box.x[some].nbytes
                    rows.append(told)
                    if size > VISIT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return packed.mapInArrow(leave, _VISITS)


def _first_edges(box: _Box, ids: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of edges (square, place among the visitors, place in the box) those that close no circle with the box's tree."""
    w, p, q = found
    count = len(box.ids)
    one = np.concatenate([box.ids[box.ends[:, 0]], ids[p]])
    two = np.concatenate([box.ids[box.ends[:, 1]], box.ids[q]])
    places = np.concatenate([box.ends, np.column_stack([p + count, q])])
    order = np.lexsort((np.maximum(one, two), np.minimum(one, two), np.concatenate([box.squares, w])))
    joined = _Joined(count + len(ids))
    kept = [k for k, (x, y) in zip(order.tolist(), places[order].tolist(), strict=True) if joined.join(x, y)]
    kept = np.array([k for k in kept if k >= len(box.ends)], np.int64) - len(box.ends)
    return w[kept], p[kept], q[kept]


def _met(box: _Box, ids: np.ndarray, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Edges ``(w, lo, hi)`` from visiting points to those of the box as near as they reach, and how many pairs were compared.

    Some that are the longest of a circle are left out.
    """
    found = (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
    compared, most = 0, 2 * (len(ids) + len(box.ids))
    parts, held = [found], 0
    for j, leaf in enumerate(box.leaves):
        near = np.flatnonzero(_gaps(x, x, box.low[j], box.high[j]) <= reach)
        if not len(near):
            continue
        d2 = _squares(x[near][:, None] - box.x[leaf][None])
        compared += d2.size
        met = (d2 <= reach[near][:, None]).any(axis=1)
        near, d2 = near[met], d2[met]
        if not len(near):
            continue
        keep = (d2 <= reach[near][:, None]) & ~box.beaten(j, np.arange(d2.shape[1]), d2)
        p, q = np.nonzero(keep)
        parts.append((d2[p, q], near[p], leaf.start + q))
        held += len(p)
        if held > most:
            parts = [_first_edges(box, ids, tuple(map(np.concatenate, zip(*parts, strict=True))))]
            held = len(parts[0][0])
    w, p, q = map(np.concatenate, zip(*parts, strict=True))
    return w, np.minimum(ids[p], box.ids[q]), np.maximum(ids[p], box.ids[q]), compared


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each box comes before its visitors."""
    box = None
    for batch in batches:
        told = []
        for row in range(batch.num_rows):
            b, a, ids, xs, ends, squares, reach = (column[row].as_py() for column in batch.columns)
            if a is None:
                box = _Box.unpack(ids, xs, ends, squares)
                continue
            names = np.frombuffer(ids, np.int64)
            w, lo, hi, compared = _met(box, names, np.frombuffer(xs).reshape(len(names), -1), np.frombuffer(reach))
            told.append((a, b, compared, w, lo, hi))
        if told:
            a, b, compared, *edges = zip(*told, strict=True)
            ends = np.cumsum([0, *map(len, edges[0])])
            kinds = [pa.array(np.concatenate(c)) for c in edges]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(kinds, ["w", "lo", "hi"]))
            columns = [*(pa.array(c, pa.int64()) for c in (a, b, compared)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "compared", "edges"])


def visited(packed: DataFrame, visits: DataFrame, boxes: int) -> DataFrame:
    """``(a, b, compared, edges)`` of the visits that have points; a task holds one box and a batch of visits."""
    homes = packed.select(F.col("box").alias("b"), *_POINTS)
    rows = visits.where(F.col("ids").isNotNull()).unionByName(homes, allowMissingColumns=True)
    tasks = max(packed.sparkSession.sparkContext.defaultParallelism * 2, boxes // 4)
    return rows.repartition(tasks, "b").sortWithinPartitions("b", "a").mapInArrow(_visited, _BETWEEN)


def _sides(batch: pa.RecordBatch) -> Iterator[list[_Box]]:
    """The two boxes of each row."""
    for row in range(batch.num_rows):
        yield [_Box.unpack(*(batch.column(f"{side}_{name}")[row].as_py() for name in _POINTS)) for side in "ab"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("w", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        compared, edges = [], []
        for sides in _sides(batch):
            _, found, count = joined_tree(*sides)
            compared.append(count)
            edges.append([{"w": w, "lo": lo, "hi": hi} for w, lo, hi, _, _ in found])
        columns = [batch.column("a"), batch.column("b"), pa.array(compared, pa.int64()), pa.array(edges, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "compared", "edges"])


def compare(packed: DataFrame, pairs: list[tuple[int, int]] | DataFrame) -> DataFrame:
    """``(a, b, compared, edges)`` of pairs of boxes ``(a, b)``; one pair holds two boxes in a task."""
    return _both(packed, pairs).mapInArrow(_compare, _BETWEEN)


def steps_between(packed: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``(a, b, w)`` of pairs of boxes: the longest square on a way from middle to middle."""
    return _both(packed, pairs).mapInArrow(_steps, "a bigint, b bigint, w double")


def _both(packed: DataFrame, pairs: list[tuple[int, int]] | DataFrame) -> DataFrame:
    if isinstance(pairs, list):
        pairs = packed.sparkSession.createDataFrame(pairs, "a bigint, b bigint")
    both = pairs
    for side in "ab":
        box = packed.select(F.col("box").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _POINTS))
        both = lookup_join(both, box, [side], how="inner")
    # A task for every few pairs: the rows are large, and some cost far more than others.
    tasks = F.xxhash64("a", "b")
    return both.repartition(packed.sparkSession.sparkContext.defaultParallelism * 2, tasks)


# --- which boxes to compare ---------------------------------------------------


@dataclass
class Boxes:
    """Number, bounds and longest own edge of all boxes."""

    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    longest: np.ndarray
    points: int
    spark: SparkSession | None

    @classmethod
    def of(cls, packed: DataFrame) -> Boxes:
        rows = sorted(packed.select("box", "low", "high", "longest", "n").collect())
        return cls.told(packed.sparkSession, rows)

    @classmethod
    def told(cls, spark: SparkSession, rows: list[tuple]) -> Boxes:
        """Of rows ``(box, low, high, longest, n)`` by box."""
        table = [np.array([row[k] for row in rows]) for k in range(4)]
        return cls(*table, sum(row[4] for row in rows), spark)

    @property
    def depth(self) -> int:
        return max((int(box).bit_length() - 1 for box in self.number), default=0)

    def gaps(self, k: int) -> np.ndarray:
        """Squared distance of the bounds of box ``k`` from those of all boxes."""
        return _gaps(self.low[k], self.high[k], self.low, self.high)

    def _pairs(self, choose) -> set[tuple[int, int]]:
        """Pairs ``(k, l)``, smaller place first, of the places that ``choose(k)`` gives; worked out in the tasks."""
        count, spark = len(self.number), self.spark
        view = Boxes(self.number, self.low, self.high, self.longest, self.points, None)

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(k, int(other)) for k in batch["id"] for other in choose(view, k) if other != k]
                yield pd.DataFrame(found, columns=["k", "l"], dtype="int64")

        rows = spark.range(0, count, 1, min(count, 2 * spark.sparkContext.defaultParallelism))
        found = rows.mapInPandas(pick, "k bigint, l bigint").toArrow()
        pairs = zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)
        return {(min(pair), max(pair)) for pair in pairs}

    def _ways(self) -> set[tuple[int, int]]:
        """One pair of boxes across each cut, so that all boxes are connected."""
        place = {int(box): k for k, box in enumerate(self.number)}
        inner = {box >> up for box in place for up in range(1, box.bit_length())}
        # Bounds of the boxes of boxes, from below.
        bounds = {box: (self.low[k], self.high[k]) for box, k in place.items()}
        for box in sorted(inner, reverse=True):
            below = [bounds[b] for b in (2 * box, 2 * box + 1) if b in bounds]
            bounds[box] = np.min([b[0] for b in below], axis=0), np.max([b[1] for b in below], axis=0)

        def gap(one: int, two: int) -> float:
            (l1, h1), (l2, h2) = bounds[one], bounds[two]
            return float(_squares(np.maximum(0.0, np.maximum(l2 - h1, l1 - h2))))

        found = set()
        for box in inner:
            sides = [b for b in (2 * box, 2 * box + 1) if b in bounds]
            if len(sides) < 2:
                continue
            one, two = sides
            while one in inner or two in inner:
                if one in inner:
                    one = min((b for b in (2 * one, 2 * one + 1) if b in bounds), key=lambda b: gap(b, two))
                if two in inner:
                    two = min((b for b in (2 * two, 2 * two + 1) if b in bounds), key=lambda b: gap(one, b))
            found.add((min(place[one], place[two]), max(place[one], place[two])))
        return found

    def _near(self) -> set[tuple[int, int]]:
        def nearest(boxes: Boxes, k: int) -> np.ndarray:
            gaps = boxes.gaps(k)
            return np.argsort(gaps, kind="stable")[: NEAR_BOXES + 1]

        return self._pairs(nearest)

    def _left(self, steps: Mapping[tuple[int, int], float]) -> set[tuple[int, int]]:
        """Pairs that lie closer than the longest step on a known way between them."""
        order, jumps = _linked(len(self.number), self._steps(steps))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))

        def closer(boxes: Boxes, k: int) -> np.ndarray:
            return order[boxes.gaps(k)[order] <= _longest(jumps, at[k])]

        return self._pairs(closer) - set(steps)

    def _steps(self, steps: Mapping[tuple[int, int], float]) -> list[tuple[float, int, int]]:
        """From anywhere in one box to anywhere in the other: the edge between, or an own edge if longer."""
        return sorted((max(w, self.longest[k], self.longest[l]), k, l) for (k, l), w in steps.items())

    def rounds(self, steps: Mapping[tuple[int, int], float] | None = None) -> Iterator[list[tuple[int, int]]]:
        """Pairs of box numbers to compare: near ones, then those still needed.

        The caller compares them and gives the shortest edge of each pair to ``learn``.
        """
        if len(self.number) < 2:
            return
        known = dict(steps or {})
        first = self._firsts() - set(known)
        if first:
            yield self._numbered(first)
            known |= self._shortest
        if more := self._left(known):
            yield self._numbered(more)

    def _firsts(self) -> set[tuple[int, int]]:
        return self._near() | self._ways()

    def first(self) -> list[tuple[int, int]]:
        """Pairs of box numbers, near ones, that connect all boxes."""
        return self._numbered(self._firsts())

    def _numbered(self, pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(int(self.number[k]), int(self.number[l])) for k, l in sorted(pairs)]

    def learn(self, between: DataFrame) -> None:
        """Take in the shortest edge of each compared pair."""
        self._shortest = self.known(between.select("a", "b", F.array_min("edges.w").alias("w")))

    def known(self, steps: DataFrame) -> dict[tuple[int, int], float]:
        """Rows ``(a, b, w)`` by the places of the boxes."""
        place = {int(box): k for k, box in enumerate(self.number)}
        return {(place[a], place[b]): w for a, b, w in steps.collect()}


def _linked(count: int, steps: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The boxes in a row such that between any two, the largest jump is the longest step of their best way."""
    root = list(range(count))
    head, tail = list(range(count)), list(range(count))
    after: list[int | None] = [None] * count
    jump = [0.0] * count

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for w, k, l in steps:
        k, l = find(k), find(l)
        if k != l:
            after[tail[k]], jump[tail[k]] = head[l], w
            tail[k] = tail[l]
            root[l] = k
    order, jumps = [head[find(0)]], []
    while (following := after[order[-1]]) is not None:
        jumps.append(jump[order[-1]])
        order.append(following)
    if len(order) != count:
        raise RuntimeError("the boxes are not all connected")
    return np.array(order), np.array(jumps)


def _longest(jumps: np.ndarray, here: int) -> np.ndarray:
    """The largest jump on the way from one place of the row to each."""
    longest = np.zeros(len(jumps) + 1)
    longest[here + 1 :] = np.maximum.accumulate(jumps[here:])
    longest[:here] = np.maximum.accumulate(jumps[:here][::-1])[::-1]
    return longest


# --- from candidate edges to the tree -----------------------------------------


def _own_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lo, hi, w, box)`` of the boxes' own trees."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
            ends = np.frombuffer(batch.column("ends")[row].as_py(), np.int32).reshape(-1, 2)
            lo, hi = np.sort(ids[ends], axis=1).T
            w = np.frombuffer(batch.column("squares")[row].as_py())
            box = np.full(len(w), batch.column("box")[row].as_py())
            columns = [pa.array(c) for c in (np.ascontiguousarray(lo), np.ascontiguousarray(hi), w, box)]
            yield pa.RecordBatch.from_arrays(columns, ["lo", "hi", "w", "box"])


def _contract(rows: pd.DataFrame) -> pd.DataFrame:
    """One group of boxes: drop what closes a circle, tell what is sure, shorten the rest.

    Rows without ``v`` name points with edges to other groups.
    """
    group = rows["grp"].iloc[0]
    edges = rows[rows["v"].notna()].sort_values(["w", "lo", "hi"], ignore_index=True)
    names, places = np.unique(edges[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    places = places.reshape(-1, 2).tolist()
    gate = np.isin(names, rows["u"][rows["v"].isna()].to_numpy(np.int64)).tolist()
    joined = _Joined(len(names))
    kept = [k for k, (u, v) in enumerate(places) if joined.join(u, v)]
    at: list[dict[int, int]] = [{} for _ in names]  # edge to the point at its other end
    for k in kept:
        u, v = places[k]
        at[u][k], at[v][k] = v, u
    sure: list[int] = []
    # Ends that lead nowhere are in no circle.
    loose = [x for x in range(len(names)) if len(at[x]) == 1 and not gate[x]]
    while loose:
        x = loose.pop()
        if not at[x]:
            continue
        ((k, y),) = at[x].items()
        sure.append(k)
        at[x].clear()
        del at[y][k]
        if len(at[y]) == 1 and not gate[y]:
            loose.append(y)
    # Ways without branches count by their longest edge; the others are never the longest of a circle.
    ways: list[tuple[int, int, int]] = []
    done: set[int] = set()
    for x in range(len(names)):
        if not at[x] or (len(at[x]) == 2 and not gate[x]):
            continue
        for k, y in at[x].items():
            if k in done:
                continue
            way = [k]
            while len(at[y]) == 2 and not gate[y]:
                ((k, y),) = ((e, z) for e, z in at[y].items() if e != way[-1])
                way.append(k)
            done.update(way)
            longest = max(way)
            sure.extend(e for e in way if e != longest)
            ways.append((x, y, longest))
    certain = edges.iloc[sure].assign(sure=True)
    ends = edges.iloc[[k for _, _, k in ways]].assign(sure=False)
    ends = ends.assign(u=names[[x for x, _, _ in ways]], v=names[[y for _, y, _ in ways]])
    out = pd.concat([certain, ends], ignore_index=True).assign(grp=group)
    return out[["u", "v", "w", "lo", "hi", "sure", "grp"]].astype({"u": "int64", "v": "int64"})


def solve(packed: DataFrame, between: list[DataFrame], depth: int) -> DataFrame:
    """The tree ``(lo, hi, w)``, ``w`` squared, from the boxes' own trees and the edges between boxes."""
    own = packed.mapInArrow(_own_edges, "lo bigint, hi bigint, w double, box bigint")
    graph = own.select("lo", "hi", "w", F.col("box").alias("gu"), F.col("box").alias("gv"))
    for edges in between:
        # Which end lies in which box does not matter: both are told.
        one = edges.select("a", "b", F.explode("edges").alias("e")).select("e.lo", "e.hi", "e.w", "a", "b")
        graph = graph.unionByName(one.withColumnsRenamed({"a": "gu", "b": "gv"}))
    graph = graph.withColumns({"u": F.col("lo"), "v": F.col("hi")})
    if not between:
        return graph.select("lo", "hi", "w")
    tree: list[DataFrame] = []
    for level in [*range(max(depth - GROUP_LEVELS, 0), 0, -GROUP_LEVELS), 0]:
        graph = graph.withColumns({side: _ancestor(F.col(side), level) for side in ("gu", "gv")})
        inner = graph.where(F.col("gu") == F.col("gv")).select("u", "v", "w", "lo", "hi", F.col("gu").alias("grp"))
        outer = graph.where(F.col("gu") != F.col("gv"))
        gates = outer.select(
            F.explode(
                F.array(*(F.struct(F.col(end).alias("u"), F.col(g).alias("grp")) for end in "uv" for g in ("gu", "gv")))
            ).alias("gate")
        ).select("gate.*")
        # An edge names both groups for each of its ends; the group that lacks the point ignores it.
        rows = inner.unionByName(gates.distinct(), allowMissingColumns=True)
        found = cut_lineage(rows.groupBy("grp").applyInPandas(_contract, _GRAPH))
        tree.append(found.where("sure").select("lo", "hi", "w"))
        rest = found.where("NOT sure").select("lo", "hi", "w", F.col("grp").alias("gu"), F.col("grp").alias("gv"), "u", "v")
        graph = rest.unionByName(outer.select(rest.columns))
    out = tree[0]
    for more in tree[1:]:
        out = out.unionByName(more)
    return out
