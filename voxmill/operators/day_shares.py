"""Daily theme shares and spikes that are kept up to date run by run.

State below one folder, Parquet by day:

* ``runs/run_date=<day>/run_ts=<run>``: the theme rows of each run;
* ``days/run_date=<day>``: size and name of each theme of the day, with the
  day's size; a day of noise only has one row without a theme;
* ``alerts/run_date=<day>``: share of each theme beside that of the previous
  available day.

Adding runs reads and writes the days they belong to, and the sides of the
available day that follows each of them; no other day is touched.  Adding a run
again replaces it.  Shares and alerts of a time frame are read off the days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators import views
from voxmill.session import cut_lineage, folder_names, scratch
from voxmill.sources import files

def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXT, _LONG, _DATE, _DOUBLE = T.StringType(), T.LongType(), T.DateType(), T.DoubleType()
_RUN = _schema(
    cluster_id=T.IntegerType(), theme_name=_TEXT, size=_LONG, position=_LONG, run_date=_DATE, run_ts=_TEXT
)
_DAY = _schema(norm_name=_TEXT, size=_LONG, day_size=_LONG, theme_name=_TEXT, top_size=_LONG, run_date=_DATE)
_SIDE = _schema(norm_name=_TEXT, theme_name=_TEXT, latest_pct=_DOUBLE, previous_pct=_DOUBLE, run_date=_DATE)


def _days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days that have runs: names of folders, one a day."""
    return [dt.date.fromisoformat(name.removeprefix("run_date=")) for name in folder_names(spark, f"{path}/days")]


def add_runs(theme_rows: DataFrame, path: str, order: str = "cluster_id") -> list[dt.date]:
    """Take in theme rows ``(run_date, run_ts, cluster_id, theme_name, size)`` and tell the days touched.

    ``order`` decides between equal contributions to a theme's name, as in the views.
    """
    spark = theme_rows.sparkSession
    columns = [F.col(f.name).cast(f.dataType) for f in _RUN.fields if f.name != "position"]
    with scratch(spark):
        rows = cut_lineage(theme_rows.select(*columns, F.col(order).cast("bigint").alias("position")))
        rows.select(*_RUN.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run_date", "run_ts"
        ).parquet(f"{path}/runs")
        touched = sorted(r.run_date for r in rows.select("run_date").distinct().collect())
        if not touched:
            return []
        runs = spark.read.schema(_RUN).parquet(f"{path}/runs").where(F.col("run_date").isin(touched))
        daily = views._daily(runs, "position")
        whole = runs.groupBy("run_date").agg(F.sum("size").alias("day_size"))
        marks = whole.select(*(F.col(f.name) if f.name in whole.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _DAY.fields))
        files.write_batch(daily.select(*_DAY.names).unionByName(marks), f"{path}/days", "run_date")
        # The touched days and the ones after them see another day before.
        days = _days(spark, path)
        place = {day: k for k, day in enumerate(days)}
        again = sorted({k for day in touched for k in (place[day], place[day] + 1) if k < len(days)})
        needed = sorted({k for n in again for k in (n - 1, n) if k >= 0})
        known = spark.read.schema(_DAY).parquet(f"{path}/days").where(F.col("run_date").isin([days[k] for k in needed]))
        sides = views._sides(known.where(F.col("norm_name").isNotNull()), F.array(*(F.lit(day) for day in days)))
        changed = sides.where(F.col("run_date").isin([days[k] for k in again])).select(*_SIDE.names)
        # A row without a theme for each day, so that a day that lost its themes is replaced too.
        marks = spark.createDataFrame([(None, None, None, None, days[k]) for k in again], _SIDE)
        files.write_batch(changed.unionByName(marks), f"{path}/alerts", "run_date")
    return touched


def _in_frame(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col("run_date") >= F.date_sub(as_of, days))


def shares(spark: SparkSession, path: str, as_of: Column, days: int = 30) -> DataFrame:
    """What ``views.theme_daily_share`` gives for all runs added, from one row per theme and day."""
    known = _in_frame(spark.read.schema(_DAY).parquet(f"{path}/days"), as_of, days)
    all_days = known.agg(F.sort_array(F.collect_set("run_date"))).scalar()
    return views._shares(known.where(F.col("norm_name").isNotNull()), all_days)


def spikes(
    spark: SparkSession, path: str, as_of: Column, days: int = 30, ratio: float = 1.5, floor_pct: float = 5.0
) -> DataFrame:
    """What ``views.spike_history`` gives for all runs added."""
    first = _in_frame(spark.read.schema(_DAY).parquet(f"{path}/days"), as_of, days).agg(F.min("run_date")).scalar()
    sides = _in_frame(spark.read.schema(_SIDE).parquet(f"{path}/alerts"), as_of, days)
    # The first day of the frame has no day before it there.
    return views._alerts(sides.where(F.col("run_date") > first), ratio, floor_pct).select(
        "run_date", "norm_name", "theme_name", "latest_pct", "previous_pct"
    )
