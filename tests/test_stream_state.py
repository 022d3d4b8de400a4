"""State of streams over several batches, restarts and failing sources."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxmill.plans import realtime
from voxmill.streaming import state, streams, supervise

START = datetime(2024, 1, 1)


def _add(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(str(folder))


def test_cap_goes_on_after_a_restart(spark, tmp_path):
    schema = "source string, pos long, note string"

    def run():
        rows = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=2)
        capped = state.cap_in_state(rows, 5, "pos")
        streams.write_files(capped, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return {(r.source, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    for file in range(3):
        rows = [("hot", 100 * file + k, None) for k in range(50)] + [(f"rare{file}", file, "x")]
        _add(spark.createDataFrame(rows[::-1], schema), tmp_path / "in")
    first = run()
    assert first == {("hot", k) for k in range(5)} | {(f"rare{k}", k) for k in range(3)}
    # The stream ended; files come while it is down, and it goes on from its checkpoint.
    _add(spark.createDataFrame([("hot", 900, "y"), ("rare0", 901, "y"), (None, 902, "z")], schema), tmp_path / "in")
    assert run() - first == {("rare0", 901), (None, 902)}


def test_cap_forgets_a_period_that_is_over(spark, tmp_path):
    schema = "source string, pos long, day timestamp"
    for file, day in enumerate([1, 1, 5, 9]):
        rows = [("a", 10 * file + k, START + timedelta(days=day)) for k in range(6)]
        _add(spark.createDataFrame(rows, schema), tmp_path / "in")
    rows = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    capped = state.cap_in_state(rows, 8, "pos", ["source", "day"], until="day", delay="1 day")
    streams.write_files(capped, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("day").count().orderBy("day").collect()
    assert [r["count"] for r in found] == [8, 6, 6]


def _fed(spark, batches, frame, tmp_path):
    schema = "id long, at timestamp, arrived timestamp, note string"
    hour = lambda n: None if n is None else START + timedelta(hours=n)
    for batch in batches:
        _add(spark.createDataFrame([(i, hour(at), hour(seen), "n") for i, at, seen in batch], schema), tmp_path / "in")
    rows = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    told = state.hold_future(rows, "id", "at", "arrived", frame * 3600, buckets=3)
    streams.write_files(told, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_rows_wait_until_the_clock_reaches_them(spark, tmp_path):
    batches = [
        [(1, 1, 2), (2, 9, 2), (3, 50, 2), (4, None, 2), (5, 2, None)],
        [(6, 3, 10), (7, -20, 3)],
        [(8, 11, 10), (8, 11, 10), (9, 1, 1)],
    ]
    told = _fed(spark, batches, 5, tmp_path)
    events = sorted((r.id, r.kind) for r in told.collect())
    assert events == sorted(
        [(1, "kept"), (2, "held"), (2, "released"), (3, "held"), (4, "kept"), (5, "kept"), (6, "kept"), (7, "late"),
         (8, "held"), (8, "held"), (9, "late")]
    )
    found = {r.id: r.kind for r in state.fates(told, ["id"]).collect()}
    assert found == {1: "kept", 2: "released", 3: "held", 4: "kept", 5: "kept", 6: "kept", 7: "late", 8: "held", 9: "late"}
    row = told.where("kind = 'released'").first()
    assert (row.at, row.note) == (START + timedelta(hours=9), "n")


def test_a_failing_stream_stops_no_other(spark, tmp_path):
    schema = spark.createDataFrame([], "id long").schema
    for source in "abc":
        _add(spark.range(3), tmp_path / "in" / source)
    (tmp_path / "in" / "b" / "bad.parquet").write_text("no table")

    def start(source):
        rows = streams.read_stream(spark, str(tmp_path / "in" / source), schema, files_per_batch=1)
        return streams.write_files(rows, str(tmp_path / "out" / source), str(tmp_path / "points" / source))

    def missing():
        raise ValueError("no such feed\nmore")

    starts = {s: lambda s=s: start(s) for s in "abc"} | {"d": missing}
    told = {f.source: f for f in supervise.run_each(spark, starts, restarts=1)}
    assert [told[s].error is None for s in "abcd"] == [True, False, True, False]
    assert told["d"].error == "no such feed" and told["b"].restarts == told["d"].restarts == 1
    assert [spark.read.schema("id long").parquet(str(tmp_path / "out" / s)).count() for s in "ac"] == [3, 3]
    # One source is mended and started again by itself: it goes on from its own checkpoint.
    (tmp_path / "in" / "b" / "bad.parquet").unlink()
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        again = supervise.run_each(spark, {"b": lambda: start("b")})
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    assert again[0].error is None
    assert spark.read.parquet(str(tmp_path / "out" / "b")).count() == 3


@pytest.mark.parametrize("pairs", [[], [("a", None)]])
def test_empty_sources(spark, tmp_path, pairs):
    schema = "source string, pos long"
    _add(spark.createDataFrame([(s, p) for s, p in pairs], schema), tmp_path / "in")
    rows = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    capped = state.cap_in_state(rows, 5, "pos")
    streams.write_files(capped, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.schema(schema).parquet(str(tmp_path / "out")).count() == len(pairs)
    assert supervise.run_each(spark, {}) == []


def test_report_of_points_follows_the_batches(spark, tmp_path):
    """Two far groups of reviews; the second batch adds to one of them and drops the rows of the first day."""
    schema = "position long, content string, x array<double>, at timestamp"
    day = lambda n: START + timedelta(days=n)
    group = lambda ids, at, when, text: [(i, text, [at + i / 10, 0.0], day(when)) for i in ids]
    _add(spark.createDataFrame(group(range(8), 0.0, 0, "ads all day") + group(range(8, 16), 900.0, 1, "it crashes"), schema), tmp_path / "in")
    _add(spark.createDataFrame(group(range(16, 24), 900.0, 1, "a crash again"), schema), tmp_path / "in")
    _add(spark.createDataFrame(group(range(24, 30), 500.0, 2, "shuffle loops"), schema), tmp_path / "in")
    rows = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    query = realtime.report_points_stream(
        rows, str(tmp_path), "position", "x", "at", since=lambda batch: F.lit(day(1 if batch == 2 else 0)), min_size=4, block_rows=8
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "reports")).where("cluster_id >= 0")
    sizes = {}
    for r in found.collect():
        sizes.setdefault(r.batch_id, []).append(r["size"])
    assert {batch: sorted(v) for batch, v in sizes.items()} == {0: [8, 8], 1: [8, 16], 2: [6, 16]}
