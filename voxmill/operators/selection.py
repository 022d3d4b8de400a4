"""De-duplication, limits and top-k per group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.session import cut_lineage

# Spark cuts each group inside the map tasks when a rank filter is at most
# this (spark.sql.optimizer.windowGroupLimitThreshold).
_MAP_SIDE_LIMIT = 1000


def first_seen(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key: the one with the lowest position.

    Filter unwanted rows first, so that they cannot hide a later good one.
    The aggregate keeps one row per key and map task before the shuffle, so a
    key with a third of all rows sends one row per task.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(whole, F.col(position)).alias("_row"))
        .select("_row.*")
    )


def top_per_group(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    spread_by: Sequence[str],
    rank: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first ``limit`` rows of each group.

    Up to 1,000 rows Spark limits each group in the map tasks by itself.
    Larger limits first cut ``salts`` slices of every group and then the group,
    so no task ever sorts a whole hot group.
    """
    name = rank or "_rank"
    if limit > _MAP_SIDE_LIMIT:
        slice_of = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
        within_slice = W.partitionBy(*keys, "_slice").orderBy(*order)
        rows = (
            rows.withColumn("_slice", slice_of)
            .withColumn("_rank", F.row_number().over(within_slice))
            .where(F.col("_rank") <= limit)
            .drop("_slice", "_rank")
        )
    ranked = rows.withColumn(
        name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ).where(F.col(name) <= limit)
    return ranked if rank else ranked.drop("_rank")


def per_source_limit(reviews: DataFrame, limit: int, position: str = "feed_pos") -> DataFrame:
    """The first ``limit`` rows of each source in feed order."""
    return top_per_group(reviews, ["source"], [F.col(position)], limit, [position])


def newest_per_stratum(
    reviews: DataFrame, stratum: str, strata: int, count: int, at: str, position: str
) -> DataFrame:
    """An equal quota ``max(1, count // strata)`` of the newest rows of each stratum."""
    quota = max(1, count // strata)
    return top_per_group(
        reviews, [stratum], [F.col(at).desc(), F.col(position)], quota, [position]
    )


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    name: str,
    block: int = 10_000,
) -> DataFrame:
    """Sum of ``value`` over all earlier positions of the group (0 for the first).

    Works in two steps, so that no task sorts a whole group: sums per block of
    ``block`` positions, then positions within a block.  ``position`` is an
    integer, unique within its group.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    before = (
        W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        blocked.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(before), F.lit(0)))
        .drop("_block", "_start")
    )


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 0 in the given total order, without bringing them together.

    The rows are sorted over many tasks and counted per task; a row's number is
    its place in its task plus the rows of the tasks before.  The table of task
    counts has one row per task of the sort.
    """
    placed = cut_lineage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(placed.groupBy(task.alias("task")).agg(F.count("*").alias("rows")).collect())
    ends = accumulate(row["rows"] for row in counts)
    starts = [(number, end - rows) for (number, rows), end in zip(counts, ends, strict=True)]
    before = rows.sparkSession.createDataFrame(starts, "_task bigint, _start bigint")
    joined = placed.withColumn("_task", task).join(F.broadcast(before), "_task")
    return joined.withColumn(name, F.col("_start") + place).drop("_at", "_task", "_start")
