"""Review batches, run files and append-only logs on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill import schemas

# --- fixed values: names of the files of a run ---------------------------
RUN_TYPES = {
    "realtime_clusters_": "Real-Time Clusters",
    "cluster_results_": "Static Clusters",
}
DAMAGED = "_damaged"
BATCH_PREFIX = "cleaned_reviews_"
STAMP = r"(\d{8}_\d{6})"
STAMP_FORMAT = "yyyyMMdd_HHmmss"
PRETTY_FORMAT = "MMM dd, yyyy hh:mm a"


def read_or_empty(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str,
    file_columns: dict[str, Column] | None = None,
) -> DataFrame:
    """Read with an explicit schema; a missing path gives no rows.

    JSON may be an array per file.  Damaged JSON records give no rows here;
    ``damaged_records`` has them.  ``file_columns`` are text columns made from
    the file's ``_metadata``.
    """
    extra = file_columns or {}
    read = schema
    if fmt == "json":
        read = T.StructType(schema.fields + [T.StructField(DAMAGED, T.StringType())])
    rows = _load(spark, path, read, fmt)
    if rows is None:
        wide = T.StructType(schema.fields + [T.StructField(c, T.StringType()) for c in extra])
        return spark.createDataFrame([], wide)
    if fmt == "json":
        rows = rows.where(F.col(DAMAGED).isNull() & _parsed(schema))
    return rows.select(*schema.names, *[made.alias(name) for name, made in extra.items()])


def damaged_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The JSON records below ``path`` that do not fit the schema, as ``(filename, record)``.

    Write them to a quarantine table, and count them there, before a batch is
    taken for whole.
    """
    rows = _load(spark, path, T.StructType(schema.fields + [T.StructField(DAMAGED, T.StringType())]), "json")
    if rows is None:
        return spark.createDataFrame([], "filename string, record string")
    found = rows.where(F.col(DAMAGED).isNotNull() & _parsed(schema))
    return found.select(F.col("_metadata.file_name").alias("filename"), F.col(DAMAGED).alias("record"))


def _parsed(schema: T.StructType) -> Column:
    """True for every row, but asks for a column: the reader refuses the damaged text alone."""
    return F.hash(F.col(schema.names[0])) >= F.lit(-(2**31))


def _load(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame | None:
    """The rows of a folder; None if there is none."""
    reader = spark.read.schema(schema).option("ignoreMissingFiles", "true")
    if fmt == "json":
        reader = reader.option("multiLine", "true").option("mode", "PERMISSIVE")
        reader = reader.option("columnNameOfCorruptRecord", DAMAGED)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Clean or raw reviews of any number of batches, with the batch's ``run_ts`` text."""
    stamp = F.regexp_extract(F.col("_metadata.file_path"), STAMP, 1)
    return read_or_empty(spark, path, schemas.CLEAN_REVIEW, fmt, {"run_ts": stamp})


def latest_batch(batches: DataFrame, run: str = "run_ts") -> DataFrame:
    """Rows of the newest batch.

    The newest stamp is a scalar subquery; on a table partitioned by ``run`` it
    prunes all other partitions.
    """
    newest = batches.agg(F.max(run)).scalar()
    return batches.where(F.col(run) == newest)


def read_runs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Theme rows of all run files with the ``filename`` of their run."""
    name = F.col("_metadata.file_name")
    rows = read_or_empty(spark, path, schemas.CLUSTER_ROW, fmt, {"filename": name})
    return rows.where(F.col("cluster_id").isNotNull())


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """File names below a folder; the contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"))


def run_catalog(files: DataFrame) -> DataFrame:
    """Run files with type, stamp, time and readable time, newest first."""
    name = F.col("filename")
    kind = F.lit(None).cast("string")
    for prefix, label in RUN_TYPES.items():
        kind = F.when(name.startswith(prefix), F.lit(label)).otherwise(kind)
    prefixes = "|".join(RUN_TYPES)
    stamp = F.regexp_replace(F.regexp_replace(name, rf"^(?:{prefixes})", ""), r"\.json$", "")
    exact = F.when(F.col("timestamp").rlike(rf"^{STAMP}$"), F.col("timestamp"))
    return (
        files.where(name.endswith(".json"))
        .select("filename", kind.alias("type"), stamp.alias("timestamp"))
        .where(F.col("type").isNotNull())
        .withColumn("run_at", F.try_to_timestamp(exact, F.lit(STAMP_FORMAT)))
        .withColumn(
            "pretty_time", F.coalesce(F.date_format("run_at", PRETTY_FORMAT), "timestamp")
        )
        .orderBy(F.col("timestamp").desc(), "filename")
    )


def valid_runs(catalog: DataFrame, theme_rows: DataFrame) -> DataFrame:
    """Runs that have at least one theme row."""
    return catalog.join(theme_rows.select("filename").distinct(), "filename", "left_semi")


def run_freshness(catalog: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The newest run and whether it is younger than ``hours``."""
    newest = catalog.agg(F.max("run_at").alias("newest"))
    age = F.unix_micros(as_of) - F.unix_micros("newest")
    return newest.select(
        "newest", F.coalesce(age < hours * 3600 * 1_000_000, F.lit(False)).alias("is_fresh")
    )


def read_cards(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The experiment log; missing or unreadable means no cards."""
    return read_or_empty(spark, path, schemas.EXPERIMENT_CARD, fmt)


def write_reviews(reviews: DataFrame, path: str, partition: Sequence[str] = ("run_date",)) -> None:
    """Append a batch as Parquet, one folder per run day."""
    reviews.write.mode("append").partitionBy(*partition).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Append cards, digests or messages to their log."""
    rows.write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, batch: str, key: str = "id") -> None:
    """Append the rows of a batch whose key the log does not have yet; a batch given again adds nothing.

    The log is partitioned by ``batch_id``.  A batch replaces its own rows, and
    keys that another batch wrote, or that the batch repeats, are left out.
    """
    spark = rows.sparkSession
    known = T.StructType([rows.schema[key], T.StructField("batch_id", T.StringType())])
    others = read_or_empty(spark, path, known, "parquet").where(F.col("batch_id") != batch)
    fresh = rows.dropDuplicates([key]).join(others.select(key), key, "left_anti")
    write_batch(fresh.select(*rows.columns, F.lit(batch).alias("batch_id")), path)


def write_batch(rows: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Write a micro-batch so that writing it again replaces it."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch)
        .parquet(path)
    )


def export_report(report: DataFrame, path: str) -> None:
    """Theme rows as JSON Lines for readers outside Spark; reviews stay in their table."""
    report.write.mode("overwrite").json(path)
