"""Structured Streaming: the batch column functions on streams, plus state.

Every sink can be replayed: file sinks keep their own log, ``foreachBatch``
writers replace the folder of their batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxmill.functions.text import normal_name
from voxmill.operators import cleaning
from voxmill.operators.selection import top_per_group
from voxmill.session import cut_lineage, scratch
from voxmill.sources import files

Transform = Callable[[DataFrame], DataFrame]


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder, with an explicit schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def clean_since(reviews: DataFrame, now: Column, seconds: Column, **options) -> DataFrame:
    """Time-frame cutoff, gates, redaction and tags; stateless, so no shuffle."""
    return cleaning.clean(cleaning.since(reviews, now, seconds), **options)


def first_seen(rows: DataFrame, keys: Sequence[str], at: str, delay: str = "2 days") -> DataFrame:
    """The first row of each key; a key is remembered for ``delay`` of event time.

    State is one entry per key of the last ``delay``.  The time column must be a
    timestamp with time zone.
    """
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(rows: DataFrame, at: str, theme: str, delay: str = "1 day") -> DataFrame:
    """Rows per day and theme; counts are combined in the map tasks first."""
    return (
        rows.withWatermark(at, delay)
        .groupBy(F.window(at, "1 day").alias("_day"), normal_name(F.col(theme)).alias("norm_name"))
        .agg(F.count("*").alias("size"))
        .select(F.to_date("_day.start").alias("run_date"), "norm_name", "size")
    )


# Take what there is now and stop; a running job passes ``{"processingTime": "1 minute"}``.
WHAT_THERE_IS = {"availableNow": True}


def write_files(
    rows: DataFrame, path: str, checkpoint: str, trigger: Mapping = WHAT_THERE_IS
) -> StreamingQuery:
    """Append to a Parquet folder, exactly once."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(path)
    )


def write_batches(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    trigger: Mapping = WHAT_THERE_IS,
) -> StreamingQuery:
    """Hand every micro-batch to ``write``."""
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**trigger)
        .start()
    )


def replace_table(path: str) -> Callable[[DataFrame, int], None]:
    """Writer for complete mode: each batch replaces the whole (small) table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def merge_days(path: str, keys: Sequence[str], day: str = "run_date") -> Callable[[DataFrame, int], None]:
    """Writer for update mode: a batch's rows replace those of the same keys.

    Only the days that the batch touches are read and rewritten, each as a
    folder of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            fresh = cut_lineage(batch)
            days = fresh.select(day).distinct()
            earlier = files.read_or_empty(batch.sparkSession, path, batch.schema, "parquet")
            rest = earlier.join(days, day, "left_semi").join(fresh, [day, *keys], "left_anti")
            merged = cut_lineage(rest.select(*batch.columns).unionByName(fresh))
            files.write_batch(merged, path, day)

    return write


def cap_per_source(
    path: str, limit: int, position: str, source: str = "source"
) -> Callable[[DataFrame, int], None]:
    """Writer that accepts at most ``limit`` rows per source over all batches.

    What is left of each source's quota follows from the rows earlier batches
    wrote, so a replayed batch decides the same.  A batch is first cut to
    ``limit`` rows per source inside the map tasks; a source with most of the
    rows is no hot task.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = top_per_group(
            batch, [source], [F.col(position)], limit, [position], rank="_rank"
        )
        schema = T.StructType([batch.schema[source], T.StructField("batch_id", T.IntegerType())])
        earlier = files.read_or_empty(spark, path, schema, "parquet")
        used = (
            earlier.where(F.col("batch_id") < batch_id)
            .groupBy(source)
            .agg(F.count("*").alias("_used"))
        )
        accepted = (
            first.join(used, source, "left")
            .where(F.col("_rank") + F.coalesce("_used", F.lit(0)) <= limit)
            .drop("_rank", "_used")
        )
        files.write_batch(accepted.withColumn("batch_id", F.lit(batch_id)), path)

    return write


def keep_and_report(
    rows_path: str, report_path: str, report: Transform, retain: Transform | None = None
) -> Callable[[DataFrame, int], None]:
    """Writer that keeps each batch's rows and reports on all rows kept so far.

    ``retain`` limits the rows to the time frame of interest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        files.write_batch(batch.withColumn("batch_id", F.lit(batch_id)), rows_path)
        kept = batch.sparkSession.read.parquet(rows_path).where(F.col("batch_id") <= batch_id)
        kept = kept.select(*batch.columns)
        with scratch(batch.sparkSession):
            found = report(retain(kept) if retain else kept)
            files.write_batch(found.withColumn("batch_id", F.lit(batch_id)), report_path)

    return write
