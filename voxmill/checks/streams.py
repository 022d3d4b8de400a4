"""Checks of the streaming operators: each stream is run to its end and read back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxmill.checks import view as v
from voxmill.checks.cleaning import MID_MONTH, joined_tags
from voxmill.checks.registry import check
from voxmill.functions import dates
from voxmill.functions import lexicons as lex
from voxmill.operators import density
from voxmill.operators.cleaning import clean
from voxmill.operators.spanning_tree import BLOCK_ROWS
from voxmill.plans.realtime import report_stream
from voxmill.session import cut_lineage, work_dir
from voxmill.sources import files
from voxmill.streaming import clusters, state, streams, supervise


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    schema = v.table(spark, sf, name).schema
    return streams.read_stream(spark, f"{sf}/{{{name}}}.parquet", schema)


@check(
    "stream_clean",
    f"""WITH {v.CLEAN} SELECT review_id, title, content, segments FROM clean
    WHERE ts >= TIMESTAMP '{MID_MONTH}' - INTERVAL 7 DAY""",
)
def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    rows = v.from_documents(_stream(spark, sf, "documents"))
    week = dates.timeframe_seconds(F.lit("7d"))
    cleaned = streams.clean_since(rows, v.now(MID_MONTH), week, lexicon=v.SEGMENT_SYLLABLES)
    streams.write_files(cleaned, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema(cleaned.schema).parquet(f"{folder}/out")
    return found.select("review_id", "title", "content", joined_tags())


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@check("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    # Some events arrive several times.
    repeats = F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int"))
    rows = _event_stream(spark, sf).withColumn("_copy", F.explode(repeats)).drop("_copy")
    once = streams.first_seen(rows, ["event_id"], "ts", "31 days")
    once = once.select("event_id", "user_id", "event_type")
    streams.write_files(once, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/out")


@check(
    "stream_daily_counts",
    """SELECT ts::DATE::VARCHAR AS run_date, lower(trim(event_type)) AS norm_name, count(*) AS size
    FROM events GROUP BY ALL""",
)
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    counts = streams.daily_counts(_event_stream(spark, sf), "ts", "event_type")
    write = streams.replace_table(f"{folder}/out")
    streams.write_batches(counts, write, f"{folder}/checkpoint", "complete").awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "stream_daily_updates",
    """SELECT ts::DATE::VARCHAR AS run_date, lower(trim(event_type)) AS norm_name, count(*) AS size
    FROM events GROUP BY ALL""",
)
def stream_daily_updates(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    counts = streams.daily_counts(_event_stream(spark, sf), "ts", "event_type")
    write = streams.merge_days(f"{folder}/out", ["norm_name"])
    streams.write_batches(counts, write, f"{folder}/checkpoint", "update").awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "stream_cap",
    f"""WITH {v.CLEAN} SELECT source, review_id FROM clean
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY feed_pos) <= 250""",
)
def stream_cap(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    rows = clean(v.from_documents(_stream(spark, sf, "documents")), v.SEGMENT_SYLLABLES)
    rows = rows.select("source", "review_id", "feed_pos")
    write = streams.cap_per_source(f"{folder}/out", 250, "feed_pos")
    streams.write_batches(rows, write, f"{folder}/checkpoint").awaitTermination()
    return files.read_or_empty(spark, f"{folder}/out", rows.select("source", "review_id").schema, "parquet")


@check("stream_report")
def stream_report(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    turns = _stream(spark, sf, "conversations")
    reviews = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("review_id"),
        F.lit("reddit").alias("source"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
        F.lit("2024-01-30T00:00:00Z").alias("date"),
    )
    month = dates.timeframe_seconds(F.lit("30d"))
    report_stream(reviews, folder, v.now(), month, 3, gates=False).awaitTermination()
    found = spark.read.parquet(f"{folder}/reports")
    return found.withColumn("quotes", F.array_join("representative_quotes", "|")).drop(
        "representative_quotes"
    )


def _stretches(events: DataFrame) -> DataFrame:
    """Events as points on twenty stretches far apart, with the third of their stretch they lie in."""
    event = F.col("event_id")
    place = F.floor(event / 20)
    last = events.agg(F.max(place)).scalar()
    return events.select(
        event.alias("row_id"),
        F.array((event % 20 * 1_000_000 + place).cast("double"), F.lit(0.0)).alias("x"),
        F.floor(place * 3 / (last + 1)).cast("int").alias("part"),
    )


def _step_by_step(rows: DataFrame, folder: str, steps: Sequence[Sequence[int]], start: Callable[[], StreamingQuery]) -> None:
    """Land the rows of some parts at a time, as many files as there are tasks; each time is one micro-batch."""
    for parts in steps:
        rows.where(F.col("part").isin(list(parts))).drop("part").write.mode("append").parquet(folder)
        start().awaitTermination()


_DAY = 86_400
_STRETCHES = """WITH last AS (SELECT max(event_id) // 20 + 1 AS n FROM events),
    parts AS (SELECT event_id, (event_id // 20 * 3) // n AS part FROM events, last)
    SELECT batch_id::INT AS batch_id, event_id, (event_id % 20)::INT AS cluster_id
    FROM parts JOIN (SELECT unnest([0, 1, 2]) AS batch_id) b ON """


def _clusters(spark: SparkSession, sf: str, since) -> DataFrame:
    folder = work_dir(spark)
    points = _stretches(v.table(spark, sf, "events"))
    points = points.withColumn("at", F.timestamp_seconds(F.lit(v.EPOCH) + F.col("part") * _DAY))
    schema = points.drop("part").schema
    rows = v.table(spark, sf, "events").count()
    # Some boxes and one piece for small tables; what a task holds does not grow with large ones.
    block_rows, piece_rows = min(rows // 16 + 1, BLOCK_ROWS), min(rows, density.PIECE_ROWS)
    write = clusters.keep_clusters(folder, 5, since, block_rows=block_rows, piece_rows=piece_rows)

    def start() -> StreamingQuery:
        stream = streams.read_stream(spark, f"{folder}/in", schema)
        return streams.write_batches(stream, write, f"{folder}/checkpoint")

    _step_by_step(points, f"{folder}/in", [[0], [1], [2]], start)
    found = spark.read.parquet(f"{folder}/labels")
    return found.select("batch_id", F.col("row_id").alias("event_id"), "cluster_id")


@check("stream_clusters", _STRETCHES + "part <= batch_id")
def stream_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each stretch grows by a third a batch; after every batch all rows so far have their label."""
    return _clusters(spark, sf, None)


@check("stream_clusters_frame", _STRETCHES + "part BETWEEN batch_id - 1 AND batch_id")
def stream_clusters_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a time frame of two days, so that the third batch loses the rows of the first."""
    return _clusters(spark, sf, lambda batch: F.timestamp_seconds(F.lit(v.EPOCH + (batch - 1) * _DAY)))


@check(
    "stream_cap_state",
    f"""WITH {v.CLEAN} SELECT source, review_id FROM clean
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY feed_pos) <= 250""",
)
def stream_cap_state(spark: SparkSession, sf: str) -> DataFrame:
    """Seven parts, three a batch, with the count of each source in the stream's state; each batch starts again from it."""
    folder = work_dir(spark)
    documents = v.table(spark, sf, "documents")
    last = documents.agg(F.max("doc_id")).scalar()
    parts = documents.withColumn("part", F.floor(F.col("doc_id") * 7 / (last + 1)).cast("int"))

    def start() -> StreamingQuery:
        stream = streams.read_stream(spark, f"{folder}/in", documents.schema)
        rows = clean(v.from_documents(stream), v.SEGMENT_SYLLABLES).select("source", "review_id", "feed_pos")
        capped = state.cap_in_state(rows, 250, "feed_pos")
        return streams.write_files(capped, f"{folder}/out", f"{folder}/checkpoint")

    _step_by_step(parts, f"{folder}/in", [[0, 1, 2], [3, 4, 5], [6]], start)
    return spark.read.schema("source string, review_id string").parquet(f"{folder}/out")


# An event is fetched between 90 hours before and 10 hours after its own time.  Of three stretches
# of fetches the last comes second and the middle one last.
_STRETCH = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
_FRAME = 48 * 3600


@check(
    "stream_held_rows",
    f"""WITH fetched AS (
      SELECT event_id, ts AS due, ts + INTERVAL 1 HOUR * ((event_id * 37) % 101 - 90) AS arrived FROM events),
    rows_ AS (
      SELECT *, CASE WHEN arrived < TIMESTAMP '{_STRETCH[0]}' THEN 0 WHEN arrived < TIMESTAMP '{_STRETCH[1]}' THEN 2
        ELSE 1 END AS part FROM fetched),
    clocks AS (SELECT part, max(max(arrived)) OVER (ORDER BY part) AS now FROM rows_ GROUP BY part),
    told AS (
      SELECT event_id, due, c.now, (SELECT max(now) FROM clocks p WHERE p.part < r.part) AS before,
        (SELECT max(now) FROM clocks) AS last FROM rows_ r JOIN clocks c USING (part))
    SELECT event_id, CASE WHEN due < before - INTERVAL {_FRAME} SECOND THEN 'late' WHEN due <= now THEN 'kept'
      WHEN due <= last THEN 'released' ELSE 'held' END AS kind FROM told""",
)
def stream_held_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches in wrong order: every event is kept, late, still held, or was held and released."""
    folder = work_dir(spark)
    at = F.col("ts").cast("timestamp")
    arrived = F.col("arrived")
    rows = v.table(spark, sf, "events").select(
        "event_id",
        at.alias("at"),
        (at + F.make_dt_interval(hours=(F.col("event_id") * 37 % 101 - 90).cast("int"))).alias("arrived"),
    )
    parts = rows.withColumn("part", F.when(arrived < v.now(_STRETCH[0]), 0).when(arrived < v.now(_STRETCH[1]), 2).otherwise(1))

    def start() -> StreamingQuery:
        stream = streams.read_stream(spark, f"{folder}/in", rows.schema)
        told = state.hold_future(stream, "event_id", "at", "arrived", _FRAME)
        return streams.write_files(told, f"{folder}/out", f"{folder}/checkpoint")

    _step_by_step(parts, f"{folder}/in", [[0], [1], [2]], start)
    told = "kind string, event_id long"
    return state.fates(spark.read.schema(told).parquet(f"{folder}/out"), ["event_id"])


def _three_feeds(spark: SparkSession, sf: str) -> tuple[str, list[supervise.Fate]]:
    """Each source's reviews as files of its own, one source with a damaged file, all landed as streams."""
    folder = work_dir(spark)
    rows = clean(v.from_documents(v.table(spark, sf, "documents")), v.SEGMENT_SYLLABLES)
    rows = cut_lineage(rows.select("source", "review_id"))
    schema = rows.schema
    a_batch = {}  # files of each source that come together: a third
    part = F.pmod(F.xxhash64("review_id"), F.lit(3))
    for source in lex.SOURCES:
        for number in range(3):
            some = rows.where((F.col("source") == source) & (part == number))
            some.write.mode("append").parquet(f"{folder}/in/{source}")
        landed = spark.read.schema(schema).parquet(f"{folder}/in/{source}").inputFiles()
        a_batch[source] = -(-len(landed) // 3)
    damaged = spark.createDataFrame([("no review",)], "value string").coalesce(1)
    damaged.write.mode("append").text(f"{folder}/in/reddit")

    def start(source: str):
        stream = streams.read_stream(spark, f"{folder}/in/{source}", schema, files_per_batch=a_batch[source])
        return streams.write_files(stream, f"{folder}/out/{source}", f"{folder}/checkpoint/{source}")

    fates = supervise.run_each(spark, {source: lambda source=source: start(source) for source in lex.SOURCES}, restarts=1)
    return folder, fates


@check("stream_three_feeds", f"WITH {v.CLEAN} SELECT source, review_id FROM clean WHERE source <> 'reddit'")
def stream_three_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """What the sources landed whose streams came to their end."""
    folder, fates = _three_feeds(spark, sf)
    whole = [f"{folder}/out/{fate.source}" for fate in fates if fate.error is None]
    return spark.read.schema("source string, review_id string").parquet(*whole)


@check(
    "stream_feed_status",
    f"""WITH {v.CLEAN}, counted AS (SELECT source, count(*) AS landed FROM clean GROUP BY source)
    SELECT source, source = 'reddit' AS failed, (source = 'reddit')::INT AS restarts,
      CASE WHEN source <> 'reddit' THEN landed END AS landed FROM counted""",
)
def stream_feed_status(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source whether it failed, how often it was started again, and what it landed."""
    folder, fates = _three_feeds(spark, sf)
    told = spark.createDataFrame(
        [(f.source, f.error is not None, f.restarts) for f in fates], "source string, failed boolean, restarts int"
    )
    whole = [f"{folder}/out/{fate.source}" for fate in fates if fate.error is None]
    landed = spark.read.schema("source string, review_id string").parquet(*whole)
    return told.join(landed.groupBy("source").agg(F.count("*").alias("landed")), "source", "left")
