"""From a report to the digest log and the outbox."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import reports
from voxmill.sources import files


def deliver(
    report: DataFrame,
    folder: str,
    week_of: Column,
    link: Column,
    to: Column,
    subject: Column,
    at: Column,
    run: Sequence[str] = ("run_date",),
) -> None:
    """Write each run's digest to ``<folder>/digests`` and its message to ``<folder>/outbox``.

    Both logs are partitioned by run, and a run that is delivered again
    replaces its own rows, so a retry sends nothing twice.  A run without rows
    leaves both logs as they are.
    """
    if report.isEmpty():
        return
    (key,) = run
    digests = reports.digest_text(report, week_of, run)
    files.write_batch(digests, f"{folder}/digests", key)
    messages = reports.message_text(report, week_of, link, run)
    records = messages.select(
        key,
        to.alias("to"),
        subject.alias("subject"),
        F.col("message").alias("body"),
        F.date_format(at, files.STAMP_FORMAT).alias("timestamp"),
    )
    files.write_batch(records, f"{folder}/outbox", key)


def delivering(deliver_batch: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: the batch number is the run, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        deliver_batch(batch.withColumn("batch_id", F.lit(batch_id)))

    return write
