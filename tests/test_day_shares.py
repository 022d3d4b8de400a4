"""Day shares kept run by run: only the days of a run are written, and the result is that from scratch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from voxmill.operators import day_shares, views


def _rows(spark, rows):
    table = [(dt.date(2024, 1, day), run, cluster, name, size) for day, run, cluster, name, size in rows]
    return spark.createDataFrame(table, "run_date date, run_ts string, cluster_id int, theme_name string, size long")


def _plain(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_a_run_touches_its_day(spark, tmp_path):
    path, as_of = str(tmp_path), F.lit(dt.date(2024, 1, 31))
    first = [(3, "a", 0, "Ads", 4), (3, "a", 1, "Loops", 6), (5, "a", 0, "ads ", 9), (5, "a", -1, "noise", 1), (9, "a", -1, "noise", 2)]
    assert day_shares.add_runs(_rows(spark, first), path) == [dt.date(2024, 1, day) for day in (3, 5, 9)]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "days").rglob("*.parquet")}
    more = [(5, "b", 1, "Loops", 10), (5, "b", 0, "ADS", 9)]
    assert day_shares.add_runs(_rows(spark, more), path) == [dt.date(2024, 1, 5)]
    same = {f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]}
    assert {f.parent.name for f in same} == {"run_date=2024-01-03", "run_date=2024-01-09"}

    def check(rows):
        table = _rows(spark, rows)
        assert _plain(day_shares.shares(spark, path, as_of)) == _plain(views.theme_daily_share(table, as_of))
        for days in (30, 27, 5):
            kept = day_shares.spikes(spark, path, as_of, days, 1.05, 0.0)
            scratch = views.spike_history(table, as_of, days, 1.05, 0.0)
            assert _plain(kept) == _plain(scratch.select(kept.columns))

    check(first + more)
    # A run added again replaces itself, and one between two days is their neighbour from then on.
    day_shares.add_runs(_rows(spark, [(5, "b", 1, "Loops", 2)]), path)
    between = [(4, "c", 0, "Ads", 1), (4, "c", 1, "Loops", 9)]
    day_shares.add_runs(_rows(spark, between), path)
    check(first + between + [(5, "b", 1, "Loops", 2)])
    # A day that keeps noise only.
    day_shares.add_runs(_rows(spark, [(4, "c", -1, "noise", 3)]), path)
    check(first + [(4, "c", -1, "noise", 3), (5, "b", 1, "Loops", 2)])
    assert day_shares.add_runs(_rows(spark, []), path) == []
