"""Cluster runs: published by a job, and read back as the tables the views take."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.session import delete_folder, folder_names
from voxmill.sources import files


_TABLES = ("themes", "assignments")
_MANIFEST = "run_ts string, version string, run_type string, run_date date"


def publish_run(members: DataFrame, report: DataFrame, path: str, run_ts: str, run_type: str) -> None:
    """Write a run's themes and assignments; the run is there once its line in the manifest is.

    ``<path>/themes`` has the report rows, ``<path>/assignments`` the member
    reviews with ``cluster_id`` and ``theme_name``, both by run and version.
    ``<path>/manifest`` is written last and says which version of a run counts.
    So readers (``published``) see a run whole or not at all: a job that breaks
    off between the tables leaves the run as it was, and publishing again
    replaces it.  Versions that no longer count are deleted then.
    """
    spark = report.sparkSession
    version = uuid.uuid4().hex
    for name, rows in zip(_TABLES, (report, members), strict=True):
        rows.write.parquet(f"{path}/{name}/run_ts={run_ts}/version={version}")
    line = spark.range(1).select(
        F.lit(version).alias("version"),
        F.lit(run_type).alias("run_type"),
        run_date_of(F.lit(run_ts)).alias("run_date"),
        F.lit(run_ts).alias("run_ts"),
    )
    files.write_batch(line.coalesce(1), f"{path}/manifest", "run_ts")
    for name in _TABLES:
        for other in folder_names(spark, f"{path}/{name}/run_ts={run_ts}"):
            if other != f"version={version}":
                delete_folder(spark, f"{path}/{name}/run_ts={run_ts}/{other}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The runs that are there: ``run_ts, version, run_type, run_date``."""
    schema = T.StructType.fromDDL(_MANIFEST)
    return files.read_or_empty(spark, f"{path}/manifest", schema, "parquet")


def published(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """Rows of ``themes`` or ``assignments`` of the runs of the manifest, with its ``run_ts, run_type, run_date``."""
    keys = T.StructType.fromDDL("run_ts string, version string")
    rows = files.read_or_empty(spark, f"{path}/{name}", T.StructType([*schema.fields, *keys.fields]), "parquet")
    # A line a run: small, so Spark broadcasts it and reads the versions that count only.
    return rows.join(manifest(spark, path), ["run_ts", "version"]).drop("version")


def run_date_of(filename: Column) -> Column:
    """The day in a run file's name; null if there is none."""
    stamp = F.regexp_extract(filename, files.STAMP, 1)
    return F.to_date(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(files.STAMP_FORMAT)))


def members_of_runs(runs: DataFrame) -> DataFrame:
    """One row per member review of the nested theme rows of ``files.read_runs``.

    Carries ``filename``, ``run_date``, ``cluster_id`` and ``theme_name``; a
    theme without reviews has no rows.
    """
    return runs.select(
        "filename",
        run_date_of(F.col("filename")).alias("run_date"),
        "cluster_id",
        "theme_name",
        F.explode("reviews").alias("_review"),
    ).select("filename", "run_date", "cluster_id", "theme_name", "_review.*")


def theme_rows_of_runs(runs: DataFrame) -> DataFrame:
    """One row per theme: ``size`` is the number of its reviews, else the stored size, else 0.

    ``position`` is the theme's place by run time, for views that keep the
    earlier of two runs of a day.
    """
    listed = F.when(F.size("reviews") > 0, F.size("reviews").cast("bigint"))
    return runs.select(
        "filename",
        run_date_of(F.col("filename")).alias("run_date"),
        "cluster_id",
        "theme_name",
        "action_idea",
        F.coalesce(listed, "size", F.lit(0)).cast("bigint").alias("size"),
        F.struct(F.regexp_extract("filename", files.STAMP, 1).alias("run_ts"), "cluster_id").alias("position"),
    )
