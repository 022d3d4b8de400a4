"""A spanning tree that is kept up to date while rows come and go.

The tree of all points lies within the trees of the boxes and the edges between
each two boxes (``spanning_tree``).  Both are kept, box by box and pair by pair.
A batch of rows touches the boxes that get points, lose points to the time
frame, or grow too large and are cut.  Only these boxes make their trees again,
and only pairs with one of them are compared again; of all others the kept edges
are taken as they are.  Which pairs count follows from the boxes' bounds and the
kept edges each time, so points that go can bring in a pair that was not needed
before.  So the tree is that of the remaining points, whatever the batches were.

State below one folder, all Parquet, written per batch and never changed:

* ``rows/batch=<id>``, ``boxes/batch=<id>``, ``between/batch=<id>``: rows, boxes
  and pairs that the batch touched;
* ``index/batch=<id>``: for every box and pair of the state, which batch's
  version counts.  It is written last: without it the batch did not happen, and
  a batch that is run again starts from the index before its own.

Folders that neither of the last two indexes names are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators import spanning_tree as st
from voxmill.session import cut_lineage, delete_folder, folder_names, scratch

_KINDS = ("rows", "boxes", "between")
_BOX = "box bigint, batch bigint, n bigint, low array<double>, high array<double>, longest double, oldest timestamp"
_PAIR = "a bigint, b bigint, batch bigint, w double"
_CUT = "box bigint, axis int, at double"


class GrowingTree:
    """The state below ``folder``; boxes hold at most ``block_rows`` distinct points."""

    def __init__(self, spark: SparkSession, folder: str, block_rows: int = st.BLOCK_ROWS) -> None:
        self.spark, self.folder, self.block_rows = spark, folder.rstrip("/"), block_rows

    # --- reading ---

    def batches(self) -> list[int]:
        """The batches that are complete, oldest first."""
        found = []
        for name in folder_names(self.spark, f"{self.folder}/index"):
            batch = int(name.removeprefix("batch="))
            if "done" in folder_names(self.spark, f"{self.folder}/index/batch={batch}"):
                found.append(batch)
        return sorted(found)

    def _index(self, batch: int | None, kind: str, schema: str) -> DataFrame:
        if batch is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/index/batch={batch}/{kind}")

    def _versions(self, kind: str, keys: list[str], wanted: Iterable[tuple], schema) -> DataFrame:
        """The rows of the wanted ``(*keys, batch)`` versions; other folders are not read."""
        wanted = list(wanted)
        batches = sorted({row[-1] for row in wanted})
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{kind}/batch={batch}" for batch in batches]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}")
        listed = self.spark.createDataFrame(wanted, ", ".join(f"{key} bigint" for key in [*keys, "batch"]))
        return reader.parquet(*paths).join(listed, [*keys, "batch"], "left_semi")

    def _rows_schema(self) -> str:
        return "row_id bigint, x array<double>, at timestamp, box bigint, batch bigint"

    def rows(self, batch: int) -> DataFrame:
        """``(row_id, vid, at, box)`` of the rows of the state after a batch; ``vid`` is the least row of a point."""
        boxes = [tuple(r) for r in self._index(batch, "boxes", _BOX).select("box", "batch").collect()]
        rows = self._versions("rows", ["box"], boxes, self._rows_schema())
        points = rows.groupBy("box", "x").agg(F.min("row_id").alias("vid"))
        return rows.join(points, ["box", "x"]).select("row_id", "vid", "at", "box")

    def tree(self, batch: int) -> DataFrame:
        """``(lo, hi, w)`` of the spanning tree of the state after a batch."""
        boxes = sorted(tuple(r) for r in self._index(batch, "boxes", _BOX).select("box", "batch").collect())
        pairs = [tuple(r) for r in self._index(batch, "pairs", _PAIR).select("a", "b", "batch").collect()]
        packed = self._versions("boxes", ["box"], boxes, f"{st._PACKED}, batch bigint").drop("batch")
        between = self._versions("between", ["a", "b"], pairs, f"{st._BETWEEN}, batch bigint")
        depth = max((box.bit_length() - 1 for box, _ in boxes), default=0)
        tree = st.solve(packed, [between] if pairs else [], depth)
        return tree.withColumn("w", F.sqrt("w"))

    # --- a batch ---

    def advance(self, batch: int, fresh: DataFrame, since: Column | None = None) -> dict[str, int]:
        """Take in rows ``(row_id, x, at)`` and drop all rows with ``at`` before ``since``.

        A batch that is given again replaces itself.  ``row_id`` are distinct
        whole numbers, ``x`` arrays of equal width, a row without ``x`` is left
        out, one without ``at`` stays.  Tells how many boxes there are, how
        many were touched, and how many pairs of points were compared.
        """
        before = max((b for b in self.batches() if b < batch), default=None)
        # Given again, it did not happen until it is through.
        delete_folder(self.spark, f"{self.folder}/index/batch={batch}")
        with scratch(self.spark):
            told = self._advance(before, batch, fresh, since)
        self._delete_unused(batch, before)
        return told

    def _advance(self, before: int | None, batch: int, fresh: DataFrame, since: Column | None) -> dict[str, int]:
        spark = self.spark
        cuts = st.Cuts({r.box: (r.axis, r.at) for r in self._index(before, "cuts", _CUT).collect()})
        old = {r.box: r for r in self._index(before, "boxes", _BOX).collect()}
        pairs = {(r.a, r.b): r for r in self._index(before, "pairs", _PAIR).collect()}
        place = {"vid": F.col("row_id"), "x": F.col("x")}

        def in_frame(rows: DataFrame) -> DataFrame:
            return rows if since is None else rows.where(F.col("at").isNull() | (F.col("at") >= since))

        fresh = fresh.select(
            F.col("row_id").cast("bigint"), F.col("x").cast("array<double>"), F.col("at").cast("timestamp")
        )
        fresh = cut_lineage(in_frame(fresh.where(F.col("x").isNotNull())))
        touched = {r.box for r in cuts.boxed(fresh.select(*(c.alias(n) for n, c in place.items()))).select("box").distinct().collect()}
        if since is not None and old:
            limit = spark.range(1).select(since.cast("timestamp").alias("t")).first().t
            touched |= {box for box, r in old.items() if r.oldest is not None and r.oldest < limit}

        # The touched boxes: what they keep and what they get, cut where they are too large.
        again = [(box, old[box].batch) for box in sorted(touched & set(old))]
        kept = in_frame(self._versions("rows", ["box"], again, self._rows_schema()).drop("batch", "box"))
        rows = cut_lineage(kept.unionByName(fresh))
        points = cut_lineage(rows.groupBy("x").agg(F.min("row_id").alias("vid")).select("vid", "x"))
        boxed, cuts = st.split_into_boxes(points, self.block_rows, cuts)
        named = boxed.select("x", "box")
        self._write(rows.join(named, "x").select("row_id", "x", "at", "box"), "rows", batch)
        self._write(st.pack(boxed), "boxes", batch)
        oldest = self._read("rows", batch, self._rows_schema()).groupBy("box").agg(F.min("at").alias("oldest"))
        packed = self._read("boxes", batch, f"{st._PACKED}, batch bigint")
        made = packed.select("box", "batch", "n", "low", "high", "longest").join(oldest, "box").collect()
        boxes = {box: r for box, r in old.items() if box not in touched} | {r.box: r for r in made}

        # Pairs of boxes that were not touched keep their edges.
        fixed = {box for box, r in boxes.items() if r.batch != batch}
        pairs = {pair: r for pair, r in pairs.items() if pair[0] in fixed and pair[1] in fixed}
        versions = [(box, r.batch) for box, r in boxes.items()]
        packed = self._versions("boxes", ["box"], versions, f"{st._PACKED}, batch bigint").drop("batch")
        table = st.Boxes.told(spark, sorted((r.box, r.low, r.high, r.longest, r.n) for r in boxes.values()))
        numbers = {box: k for k, box in enumerate(table.number.tolist())}
        steps = {(numbers[a], numbers[b]): r.w for (a, b), r in pairs.items()}
        compared, found = 0, []
        for asked in table.rounds(steps):
            between = cut_lineage(st.compare(packed, asked))
            table.learn(between)
            found.append(between)
            compared += between.agg(F.sum("compared")).first()[0] or 0
        index = [(a, b, r.batch, r.w) for (a, b), r in pairs.items()]
        if found:
            both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
            self._write(both, "between", batch)
            shortest = both.select("a", "b", F.lit(batch).alias("batch"), F.array_min("edges.w").alias("w"))
            index += [tuple(r) for r in shortest.collect()]

        self._commit(batch, "cuts", [(box, *at) for box, at in cuts.at.items()], _CUT)
        self._commit(batch, "pairs", index, _PAIR)
        told = [(r.box, r.batch, r.n, r.low, r.high, r.longest, r.oldest) for r in boxes.values()]
        self._commit(batch, "boxes", told, _BOX)
        self._commit(batch, "done", [(batch,)], "batch bigint")
        return {"boxes": len(boxes), "touched": len(made), "compared": compared}

    # --- writing ---

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def _read(self, kind: str, batch: int, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}")
        return reader.parquet(f"{self.folder}/{kind}/batch={batch}")

    def _commit(self, batch: int, part: str, rows: list[tuple], schema: str) -> None:
        """One part of the index: a few rows per box, one file."""
        told = self.spark.createDataFrame(rows, schema).coalesce(1)
        told.write.mode("overwrite").parquet(f"{self.folder}/index/batch={batch}/{part}")

    def _delete_unused(self, batch: int, before: int | None) -> None:
        live = {kind: {batch, before} for kind in _KINDS}
        for index in (batch, before):
            for kind, part, schema in (("rows", "boxes", _BOX), ("boxes", "boxes", _BOX), ("between", "pairs", _PAIR)):
                used = self._index(index, part, schema).select("batch").distinct().collect()
                live[kind] |= {r.batch for r in used}
        for kind, wanted in live.items():
            for name in folder_names(self.spark, f"{self.folder}/{kind}"):
                if int(name.removeprefix("batch=")) not in wanted:
                    delete_folder(self.spark, f"{self.folder}/{kind}/{name}")
        for index in self.batches():
            if index not in (batch, before):
                delete_folder(self.spark, f"{self.folder}/index/batch={index}")
