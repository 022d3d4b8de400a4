"""Real-time analytics: a stream of reviews to a report per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxmill.operators import cleaning, themes
from voxmill.plans.analytics import analyse
from voxmill.sources import files
from voxmill.streaming import clusters, streams


def report_stream(
    reviews: DataFrame,
    folder: str,
    now: Column,
    timeframe_seconds: Column,
    min_size: int = 2,
    gates: bool = True,
) -> StreamingQuery:
    """Clean the stream, keep its rows, and re-report the time frame each batch.

    Rows go to ``<folder>/rows``, reports to ``<folder>/reports``; both carry
    ``batch_id``.
    """
    clean = streams.clean_since(reviews, now, timeframe_seconds, gates=gates)

    def report(kept: DataFrame) -> DataFrame:
        return analyse(kept, min_size, noise_count=3, noise_chars=200).report

    def retain(kept: DataFrame) -> DataFrame:
        return cleaning.since(kept, now, timeframe_seconds)

    write = streams.keep_and_report(f"{folder}/rows", f"{folder}/reports", report, retain)
    return streams.write_batches(clean, write, f"{folder}/checkpoint")


def report_points_stream(
    reviews: DataFrame,
    folder: str,
    row_id: str,
    point: str,
    at: str,
    since: clusters.Frame | None = None,
    min_size: int = 2,
    **options,
) -> StreamingQuery:
    """Report each batch on all rows of the time frame, for reviews that bring their points.

    Points (given vectors, or rows projected on axes fitted before) stay what
    they are, so the clusters are kept up to date instead of made again: a batch
    costs what its rows and the boxes of points they fall in cost, and passes
    over the tree.  ``row_id`` are distinct whole numbers.  Rows go to
    ``<folder>/rows``, reports to ``<folder>/reports``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files.write_batch(batch.withColumn("batch_id", F.lit(batch_id)), f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows").where(F.col("batch_id") <= batch_id)

        def report(labels: DataFrame, batch_id: int) -> None:
            members = rows.join(labels.withColumnRenamed("row_id", row_id), row_id)
            found = themes.cluster_report(members, row_id, noise_count=3, noise_chars=200)
            files.write_batch(found.withColumn("batch_id", F.lit(batch_id)), f"{folder}/reports")

        points = rows.where(F.col("batch_id") == batch_id).select(
            F.col(row_id).alias("row_id"), F.col(point).alias("x"), F.col(at).alias("at")
        )
        clusters.keep_clusters(folder, min_size, since, then=report, **options)(points, batch_id)

    return streams.write_batches(reviews, write, f"{folder}/checkpoint")
