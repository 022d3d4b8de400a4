"""Streams of several files: state carries over, replays change nothing."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from voxmill.checks import streams as checks
from voxmill.functions import dates
from voxmill.operators import cleaning
from voxmill.plans.realtime import report_stream
from voxmill.streaming import streams

ROWS = "review_id string, source string, title string, content string, date string, feed_pos long"


def land(spark, folder, *batches, schema=ROWS):
    """One file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


def review(i, source="reddit", content="It is slow", date="2026-06-29T00:00:00Z"):
    return (f"r{i}", source, "", content, date, i)


def test_stream_cleans_like_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [review(1), review(2, content="é"), review(3, date="2026-01-01"), review(4, date=""), review(5, date="2026-07-09")]
    schema = land(spark, folder, rows[:2], rows[2:])
    now = F.to_timestamp(F.lit("2026-06-30 00:00:00"))
    week = dates.timeframe_seconds(F.lit("7d"))
    stream = streams.read_stream(spark, folder, schema, files_per_batch=1)
    out = str(tmp_path / "out")
    streams.write_files(
        streams.clean_since(stream, now, week), out, str(tmp_path / "check")
    ).awaitTermination()
    batch = cleaning.clean(cleaning.since(spark.read.parquet(folder), now, week))
    found = sorted(r.review_id for r in spark.read.parquet(out).collect())
    assert found == sorted(r.review_id for r in batch.collect()) == ["r1", "r4", "r5"]


def test_timeframes(spark):
    now = F.to_timestamp(F.lit("2026-06-30 00:00:00"))
    ages = [(1, "2026-06-29T19:00:00Z"), (2, "2026-06-27T00:00:00Z"), (3, "2026-06-15T00:00:00Z"), (4, "2026-05-16T00:00:00Z")]
    table = spark.createDataFrame(ages, "id int, date string")
    for text, kept in (("24h", 1), ("7d", 2), ("30d", 3)):
        assert cleaning.since(table, now, dates.timeframe_seconds(F.lit(text))).count() == kept


def test_dedup_remembers_earlier_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = land(
        spark, folder, [("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 01:00:00")],
        [("a", "2026-01-01 02:00:00"), ("c", "2026-01-01 03:00:00")],
        schema="id string, at string",
    )
    stream = streams.read_stream(spark, folder, schema, files_per_batch=1)
    timed = stream.withColumn("at", F.col("at").cast("timestamp"))
    out = str(tmp_path / "out")
    once = streams.first_seen(timed, ["id"], "at")
    streams.write_files(once, out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_cap_counts_over_batches_and_survives_replay(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [review(i) for i in range(4)] + [review(100, "app_store")]
    second = [review(i) for i in range(10, 16)] + [review(101, "app_store")]
    schema = land(spark, folder, first, second)
    stream = streams.read_stream(spark, folder, schema, files_per_batch=1)
    write = streams.cap_per_source(out, 6, "feed_pos")
    streams.write_batches(stream, write, str(tmp_path / "check")).awaitTermination()

    def accepted():
        return sorted((r.batch_id, r.feed_pos) for r in spark.read.parquet(out).collect())

    want = [(0, 0), (0, 1), (0, 2), (0, 3), (0, 100), (1, 10), (1, 11), (1, 101)]
    assert accepted() == want
    write(spark.createDataFrame(second, ROWS), 1)  # the same batch once more
    assert accepted() == want


def test_report_per_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    slow = ["app is slow today", "slow app again today", "the app is so slow"]
    ads = ["too many ads here", "ads and more ads here", "why so many ads"]
    land_rows = [review(i, content=t) for i, t in enumerate(slow + ads)]
    schema = land(spark, folder, land_rows)
    stream = streams.read_stream(spark, folder, schema)
    now = F.to_timestamp(F.lit("2026-06-30 00:00:00"))
    report_stream(stream, out, now, dates.timeframe_seconds(F.lit("7d"))).awaitTermination()
    report = spark.read.parquet(f"{out}/reports").collect()
    assert sum(r["size"] for r in report) == 6
    assert len([r for r in report if r.cluster_id != -1]) >= 2


def test_tables_that_are_folders_are_read_by_streams(spark, tmp_path):
    """A large table is a folder of files: its streams had no rows, and what read their output failed."""
    documents = [(i, "web", f"Some words of text {i} which go on. And more words of it here {i}.") for i in range(6)]
    turns = [(1, t, "user", f"the app is so slow today {t % 2}") for t in range(6)]
    tables = {
        "documents": spark.createDataFrame(documents, "doc_id long, source string, text string"),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"),
    }
    for name, rows in tables.items():
        rows.repartition(3).write.parquet(str(tmp_path / "folders" / f"{name}.parquet"))
        rows.coalesce(1).write.parquet(str(tmp_path / "made" / name))
        (part,) = (tmp_path / "made" / name).glob("part-*.parquet")
        (tmp_path / "files").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / "files" / f"{name}.parquet")
    for kind in ("folders", "files"):
        assert checks.stream_cap(spark, str(tmp_path / kind)).count() == 12
        assert checks.stream_report(spark, str(tmp_path / kind)).agg(F.sum("size")).first()[0] == 6


def test_inputs_of_streams_are_written_by_all_tasks(spark, tmp_path):
    """One task read the whole table to write a part of it as one file."""
    documents = [(i, "web", f"Some words of text {i} which go on. And more words of it here {i}.") for i in range(60)]
    rows = spark.createDataFrame(documents, "doc_id long, source string, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    folder, fates = checks._three_feeds(spark, str(tmp_path))
    assert [fate.error is None for fate in fates] == [True, True, False]
    landed = Path(folder.removeprefix("file:")) / "in" / "app_store"
    assert len(list(landed.glob("part-*.parquet"))) > 3

    numbers = spark.range(0, 80, 1, 4).withColumn("part", F.pmod("id", F.lit(4)))
    folder, seen = str(tmp_path / "in"), []

    def start():
        stream = streams.read_stream(spark, folder, numbers.drop("part").schema)
        return streams.write_batches(stream, lambda batch, _: seen.append(batch.count()), str(tmp_path / "check"))

    checks._step_by_step(numbers, folder, [[0, 1], [2], [3]], start)
    assert seen == [40, 20, 20]
    assert len(list(Path(folder).glob("part-*.parquet"))) == 12
