"""What the operators of this package have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import prepare, spread

# The white space of the contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACES_REGEX = r"[\x20\x09-\x0D]+"

# Rows and bytes of one batch handed to Python, so that a run of very long
# texts does not fill a worker.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Prepare the session and bound what a Python worker gets at once."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the texts over all cores, also if they lie in one small file."""
    rows = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under our own names; whatever else ``df`` has stays out.

    ``only(df, id="doc_id", text="text")`` is a table ``(id, text)``.
    """
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))
