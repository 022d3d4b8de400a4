"""Checks of gates, redaction, translation, tags, dates and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.checks import view as v
from voxmill.checks.registry import check
from voxmill.functions import dates
from voxmill.functions import lexicons as lex
from voxmill.functions import text as tx
from voxmill.operators import cleaning, selection, views

MID_MONTH = "2024-01-20 00:00:00"


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(v.reviews(spark, sf), v.SEGMENT_SYLLABLES)


def joined_tags() -> Column:
    return F.array_join("inferred_segments", "|").alias("segments")


@check(
    "length_gate",
    f"WITH {v.REVIEWS} SELECT review_id, length({v.strip_sql('content')}) AS chars FROM reviews "
    f"WHERE length({v.strip_sql('content')}) BETWEEN 1 AND 50",
)
def length_gate(spark: SparkSession, sf: str) -> DataFrame:
    kept = cleaning.gate(v.reviews(spark, sf), characters=False)
    return kept.select("review_id", F.length("content").cast("bigint").alias("chars"))


@check(
    "charset_gate",
    rf"""WITH {v.REVIEWS} SELECT review_id, content FROM reviews
    WHERE regexp_full_match(content, '[a-zA-Z0-9\s\p{{Z}}.,!?''"()\-]*')""",
)
def charset_gate(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.gate(v.reviews(spark, sf), length=False).select("review_id", "content")


@check(
    "clusterable",
    f"WITH {v.REVIEWS} SELECT source, count(*) AS reviews FROM reviews WHERE length(content) > 3 GROUP BY source",
)
def clusterable(spark: SparkSession, sf: str) -> DataFrame:
    kept = cleaning.clusterable(v.reviews(spark, sf))
    return kept.groupBy("source").agg(F.count("*").alias("reviews"))


@check(
    "clean_reviews",
    f"WITH {v.CLEAN} SELECT review_id, source, title, content, rating, segments, FALSE AS is_translated FROM clean",
)
def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).select(
        "review_id", "source", "title", "content", "rating", joined_tags(), "is_translated"
    )


@check(
    "scrub_pii",
    f"SELECT doc_id, {v.scrub_sql('text')} AS scrubbed FROM documents",
)
def scrub_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.texts(spark, sf)
    return docs.select("doc_id", tx.scrub_pii(F.col("text")).alias("scrubbed"))


def _hits(step: int) -> str:
    kind, pattern, _ = v.PII_SQL[step]
    text = v.scrub_sql("text", step)
    return f"sum(len(regexp_extract_all({text}, '{pattern}')))::BIGINT AS {kind}_hits"


@check(
    "pii_audit",
    f"SELECT source, {', '.join(_hits(i) for i in range(4))} FROM documents GROUP BY source",
)
def pii_audit(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.pii_audit(v.texts(spark, sf), "text", "source")


ASCII_SQL = r"length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0)"


@check(
    "english_ratio",
    f"""SELECT doc_id, round({ASCII_SQL}, 6) AS ascii_share,
    coalesce({ASCII_SQL} > 0.88, TRUE) AS is_english FROM documents""",
)
def english_ratio(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return v.texts(spark, sf).select(
        "doc_id",
        F.round(tx.ascii_share(text), 6).alias("ascii_share"),
        tx.is_likely_english(text).alias("is_english"),
    )


NEEDS_SQL = (
    "length(content) >= 3 AND NOT coalesce(length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE"
    " / nullif(length(content), 0) > 0.88, TRUE)"
)


@check(
    "translation_queue",
    f"""WITH {v.REVIEWS} SELECT content AS source_text, count(*) AS waiting, sha256(content) AS source_hash
    FROM reviews WHERE {NEEDS_SQL} GROUP BY content""",
)
def translation_queue(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.translation_queue(v.reviews(spark, sf))


@check(
    "translation_join",
    f"""WITH {v.REVIEWS}, done AS (
      SELECT review_id, content AS before,
             CASE WHEN {NEEDS_SQL} AND length(content) % 2 = 0
                  THEN 'english of ' || sha256(content) ELSE content END AS content
      FROM reviews)
    SELECT review_id, content, content <> before AS is_translated FROM done""",
)
def translation_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.reviews(spark, sf)
    # A memory that knows every second waiting text.
    memory = (
        cleaning.translation_queue(rows)
        .where(F.length("source_text") % 2 == 0)
        .select("source_hash", F.concat(F.lit("english of "), "source_hash").alias("text_en"))
    )
    before = rows.select("review_id", "content", F.col("content").alias("before"))
    return cleaning.translate(before, memory).select(
        "review_id", "content", (F.col("content") != F.col("before")).alias("is_translated")
    )


def _tags_check(lexicon: dict) -> str:
    low = "lower(title || ' ' || content)"
    return f"WITH {v.REVIEWS} SELECT review_id, {v.tags_sql(low, lexicon)} AS segments FROM reviews"


@check("segment_tags", _tags_check(v.SEGMENT_SYLLABLES))
def segment_tags(spark: SparkSession, sf: str) -> DataFrame:
    tagged = cleaning.tag_segments(v.reviews(spark, sf), v.SEGMENT_SYLLABLES)
    return tagged.select("review_id", joined_tags())


@check("segment_tags_default", _tags_check(lex.SEGMENT_TERMS))
def segment_tags_default(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.tag_segments(v.reviews(spark, sf)).select("review_id", joined_tags())


def messy_dates(rows: DataFrame) -> DataFrame:
    """The reviews' dates written in the ways the sources write them."""
    kind = F.col("pos") % 12
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-07:00")))
        .when(kind == 3, "")
        .when(kind == 4, "not a date")
        .when(kind == 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"))
        .when(kind == 7, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
        .when(kind == 8, F.date_format("ts", "HH:mm"))
        .when(kind == 9, F.date_format("ts", "yyyy"))
        .when(kind == 10, F.date_format("ts", "yyyy-MM"))
        .when(kind == 11, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" Europe/Berlin")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    return rows.withColumn("date", text)


# What the dates above mean, stated from the time they were made of.
MESSY = f"""{v.REVIEWS},
dated AS (
  SELECT *, CASE WHEN pos % 12 IN (0, 1, 5, 6, 7) THEN ts
                 WHEN pos % 12 = 2 THEN ts + INTERVAL 7 HOUR END AS said
  FROM reviews
)"""


@check(
    "parse_dates",
    f"WITH {MESSY} SELECT review_id, epoch_ms(said)::BIGINT AS at_millis FROM dated",
)
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = messy_dates(v.reviews(spark, sf))
    at = dates.parse_date(F.col("date"))
    return rows.select("review_id", F.unix_millis(at).alias("at_millis"))


@check(
    "parse_timeframe",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN (user_id % 48) * 3600 WHEN 1 THEN (user_id % 40) * 86400
      WHEN 2 THEN (user_id % 48) * 3600 ELSE 7 * 86400 END::BIGINT AS seconds FROM events""",
)
def parse_timeframe(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.col("user_id") % 48, F.lit("h")))
        .when(kind == 1, F.concat(F.lit(" "), F.col("user_id") % 40, F.lit("D ")))
        .when(kind == 2, F.concat(F.col("user_id") % 48, F.lit("H")))
        .when(kind == 3, F.concat(F.lit("x"), F.col("user_id"), F.lit("d")))
        .otherwise(F.col("event_type"))
    )
    events = v.table(spark, sf, "events")
    return events.select("event_id", dates.timeframe_seconds(text).alias("seconds"))


@check(
    "anchored_window",
    f"""WITH {MESSY}, anchor AS (SELECT max(said) AS latest FROM dated WHERE source = 'app_store')
    SELECT review_id, source FROM dated, anchor
    WHERE said IS NULL OR (
      CASE WHEN source = 'app_store' THEN latest ELSE TIMESTAMP '{MID_MONTH}' END - said
      BETWEEN INTERVAL 0 SECOND AND INTERVAL 24 HOUR)""",
)
def anchored_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = messy_dates(v.reviews(spark, sf))
    return cleaning.anchored_window(rows, v.now(MID_MONTH)).select("review_id", "source")


@check(
    "timeframe_cutoff",
    f"""WITH {MESSY} SELECT review_id FROM dated
    WHERE coalesce(said, TIMESTAMP '{MID_MONTH}') >= TIMESTAMP '{MID_MONTH}' - INTERVAL 7 DAY""",
)
def timeframe_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = messy_dates(v.reviews(spark, sf))
    week = dates.timeframe_seconds(F.lit("7d"))
    return cleaning.since(rows, v.now(MID_MONTH), week).select("review_id")


@check(
    "dedup_first_seen",
    f"""WITH {v.REVIEWS} SELECT source, content, min(feed_pos) AS feed_pos,
    arg_min(review_id, feed_pos) AS review_id FROM reviews WHERE content <> '' GROUP BY source, content""",
)
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.reviews(spark, sf).where(F.col("content") != "")
    rows = rows.select("source", "content", "feed_pos", "review_id")
    return selection.first_seen(rows, ["source", "content"], "feed_pos")


@check(
    "per_source_limit",
    f"""WITH {v.REVIEWS} SELECT source, review_id FROM reviews
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY feed_pos) <= 1200""",
)
def per_source_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.reviews(spark, sf).select("source", "review_id", "feed_pos")
    return selection.per_source_limit(rows, 1200).select("source", "review_id")


@check(
    "accepted_cap",
    f"""WITH {v.CLEAN} SELECT source, review_id, segments FROM clean
    WHERE ts >= TIMESTAMP '{MID_MONTH}' - INTERVAL 7 DAY
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY feed_pos) <= 250""",
)
def accepted_cap(spark: SparkSession, sf: str) -> DataFrame:
    week = dates.timeframe_seconds(F.lit("7d"))
    recent = cleaning.since(clean(spark, sf), v.now(MID_MONTH), week)
    return selection.per_source_limit(recent, 250).select("source", "review_id", joined_tags())


@check(
    "stratified_newest",
    """SELECT event_type, event_id, user_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 100""",
)
def stratified_newest(spark: SparkSession, sf: str) -> DataFrame:
    events = v.table(spark, sf, "events")
    newest = selection.newest_per_stratum(events, "event_type", 5, 500, "ts", "event_id")
    return newest.select("event_type", "event_id", "user_id")


@check(
    "ingest_summary",
    f"""WITH {v.CLEAN} SELECT source, raw_count, coalesce(clean_count, 0) AS clean_count FROM
    (SELECT source, count(*) AS raw_count FROM reviews GROUP BY source)
    LEFT JOIN (SELECT source, count(*) AS clean_count FROM clean GROUP BY source) USING (source)""",
)
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return views.ingest_summary(v.reviews(spark, sf), clean(spark, sf))


@check(
    "segment_counts",
    f"""WITH {v.CLEAN} SELECT segment, count(*) AS reviews FROM
    (SELECT unnest(string_split(segments, '|')) AS segment FROM clean) GROUP BY segment""",
)
def segment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.segment_counts(clean(spark, sf))
