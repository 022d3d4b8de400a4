"""Density clusters of a stream of points, kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import density
from voxmill.operators.growing_tree import GrowingTree
from voxmill.operators.spanning_tree import BLOCK_ROWS
from voxmill.session import cut_lineage, scratch
from voxmill.sources import files

Frame = Callable[[int], Column]


def keep_clusters(
    folder: str,
    min_size: int = 2,
    since: Frame | None = None,
    block_rows: int = BLOCK_ROWS,
    piece_rows: int = density.PIECE_ROWS,
    then: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Writer of micro-batches of rows ``(row_id, x, at)``.

    The spanning tree of all rows is kept below ``<folder>/state``: a batch
    compares the boxes of points it touches, no others.  The labels of all rows
    of the time frame go to ``<folder>/labels`` with their ``batch_id``.
    ``since`` gives the start of the time frame of a batch.  The hierarchy is
    read off the tree in a few passes over its edges.  ``then`` gets the labels
    ``(row_id, cluster_id)`` of each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = GrowingTree(spark, f"{folder}/state", block_rows)
        state.advance(batch_id, batch.select("row_id", "x", "at"), since(batch_id) if since else None)
        with scratch(spark):
            rows = cut_lineage(state.rows(batch_id).select("row_id", "vid", "box"))
            labels = cut_lineage(density.label(rows, cut_lineage(state.tree(batch_id)), min_size, piece_rows))
            files.write_batch(labels.withColumn("batch_id", F.lit(batch_id)), f"{folder}/labels")
            if then is not None:
                then(labels, batch_id)

    return write
