"""The test tables seen as reviews, in Spark and in SQL.

Every sentence of ``documents`` is one review; all derived columns are whole
number arithmetic on ``doc_id`` and the place of the sentence, so both engines
agree.  Whole tables and whole texts are used everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.functions.text import strip_space
from voxmill.operators.joins import lookup_values
from voxmill.session import prepare, spread

AS_OF = "2024-01-31 00:00:00"
EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC

# The invented prose has few of the real words, so each lexicon is also tried
# with syllables that split the data.
SEGMENT_SYLLABLES = {
    "Premium User": ["tion"],
    "Free User": ["the ", "free"],
    "Discovery Issue": ["ent", "que"],
    "UI/UX Issue": ["ung"],
    "Performance/Stability Issue": ["ould", "schen"],
}
THEME_SYLLABLES = {
    name: terms
    for name, terms in zip(
        lex.THEME_TERMS,
        [["wifi", "paque"], ["ungver"], ["ciónel"], ["theing"], ["auxque"], ["ungen"], ["tion"], ["ent", "ar"]],
        strict=True,
    )
}
THEME_NAMES = list(lex.THEME_TERMS)


def now(text: str = AS_OF) -> Column:
    return F.to_timestamp(F.lit(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores: each text costs far more than its transport."""
    return spread(table(spark, sf_dir, "documents"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents to reviews: one projection and one explode, no shuffle."""
    doc = F.col("doc_id")
    sentences = documents.select(
        "doc_id", F.col("source").alias("origin"), F.posexplode_outer(F.split("text", r"[.\n]+")).alias("pos", "raw")
    ).where(F.col("raw").isNotNull())
    at = F.timestamp_seconds(F.lit(EPOCH) + 60 * ((doc * 37 + F.col("pos") * 11) % 43200))
    source = (
        F.when(doc % 3 == 0, "app_store").when(doc % 3 == 1, "play_store").otherwise("reddit")
    )
    return sentences.select(
        F.concat_ws("-", "doc_id", "pos").alias("review_id"),
        "doc_id",
        "pos",
        source.alias("source"),
        F.concat(F.lit("user"), doc % 997).alias("author"),
        F.when(doc % 3 == 1, "").otherwise(F.col("origin")).alias("title"),
        strip_space(F.col("raw")).alias("content"),
        ((doc * 7 + F.col("pos")) % 5 + 1).cast("int").alias("rating"),
        at.alias("ts"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        (doc * 100000 + F.col("pos")).alias("feed_pos"),
        (doc % 12 - 1).cast("int").alias("cluster_id"),
        F.to_date(at).alias("run_date"),
        F.when(doc % 10 == 0, F.lit(True)).alias("premium_status"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(texts(spark, sf_dir))


def theme_name(cluster: Column) -> Column:
    names = {str(i): name for i, name in enumerate(THEME_NAMES)}
    return F.when(cluster == -1, lex.NOISE_THEME).otherwise(
        lookup_values(names, (cluster % 8).cast("string"))
    )


def by_document(rows: DataFrame) -> DataFrame:
    """Small clusters: one per document, every tenth document is noise."""
    doc = F.col("doc_id")
    return rows.withColumn("cluster_id", F.when(doc % 10 == 0, -1).otherwise(doc).cast("int"))


# --- the same in SQL ------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def any_sql(lowered: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {quoted(t)})" for t in terms) + ")"


def tags_sql(lowered: str, lexicon: Mapping[str, Sequence[str]]) -> str:
    parts = ", ".join(
        f"CASE WHEN {any_sql(lowered, terms)} THEN {quoted(label)} END"
        for label, terms in lexicon.items()
    )
    joined = f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '|')"
    return f"CASE WHEN {joined} = '' THEN {quoted(lex.DEFAULT_SEGMENT)} ELSE {joined} END"


def theme_case_sql(flag: str, count: int) -> str:
    return " ".join(
        f"WHEN {flag}{i} THEN {quoted(THEME_NAMES[i])}" for i in range(count)
    )


def theme_name_sql(cluster: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(THEME_NAMES))
    return f"CASE WHEN {cluster} = -1 THEN {quoted(lex.NOISE_THEME)} ELSE CASE {cluster} % 8 {cases} END END"


def normal_sql(name: str) -> str:
    return strip_sql(rf"regexp_replace(lower({name}), '[\s\p{{Z}}]+', ' ', 'g')")


# The library's own patterns; the SQL engine's word class is ASCII only, Spark's here is not.
PII_SQL = [(name, pattern.replace(r"\w", r"[\p{L}\p{N}_]"), token) for name, pattern, token in lex.PII_PATTERNS]


def scrub_sql(text: str, steps: int = 4) -> str:
    made = f"coalesce({text}, '')"
    for _, pattern, token in PII_SQL[:steps]:
        made = f"regexp_replace({made}, '{pattern}', '{token}', 'g')"
    return made


REVIEWS = rf"""
sentences AS (
  SELECT doc_id, source AS origin,
         unnest(string_split_regex(text, '[.\n]+')) AS raw,
         generate_subscripts(string_split_regex(text, '[.\n]+'), 1) - 1 AS pos
  FROM documents
),
reviews AS (
  SELECT doc_id || '-' || pos AS review_id, doc_id, pos,
         CASE doc_id % 3 WHEN 0 THEN 'app_store' WHEN 1 THEN 'play_store' ELSE 'reddit' END AS source,
         'user' || (doc_id % 997) AS author,
         CASE WHEN doc_id % 3 = 1 THEN '' ELSE origin END AS title,
         {strip_sql('raw')} AS content,
         ((doc_id * 7 + pos) % 5 + 1)::INT AS rating,
         TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37 + pos * 11) % 43200) AS ts,
         doc_id * 100000 + pos AS feed_pos,
         (doc_id % 12 - 1)::INT AS cluster_id,
         (TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37 + pos * 11) % 43200))::DATE AS run_date,
         CASE WHEN doc_id % 10 = 0 THEN TRUE END AS premium_status
  FROM sentences
)"""

GATE = (
    f"length({strip_sql('content')}) BETWEEN 1 AND 50 AND "
    + r"""regexp_full_match(content, '[a-zA-Z0-9\s\p{Z}.,!?''"()\-]*')"""
)

CLEAN = f"""{REVIEWS},
scrubbed AS (
  SELECT * REPLACE ({scrub_sql('title')} AS title, {scrub_sql('content')} AS content)
  FROM reviews WHERE {GATE}
),
clean AS (
  SELECT *, lower(title || ' ' || content) AS low,
         {tags_sql("lower(title || ' ' || content)", SEGMENT_SYLLABLES)} AS segments
  FROM scrubbed
)"""

MEMBERS = f"""{REVIEWS},
members AS (
  SELECT *, {theme_name_sql('cluster_id')} AS theme_name,
         {tags_sql("lower(title || ' ' || content)", SEGMENT_SYLLABLES)} AS segments
  FROM reviews
)"""

COHORTS_SQL = {
    "all": "TRUE",
    "premium": "(contains(lower(segments), 'premium') OR coalesce(premium_status, FALSE))",
    "free": "contains(lower(segments), 'free')",
    "ios": "source = 'app_store'",
    "android": "source = 'play_store'",
}

# Theme rows per day from the reviews: names differ in case and spacing.
NAME_VARIANT_SQL = f"""CASE WHEN cluster_id = -1 THEN {theme_name_sql('cluster_id')}
  WHEN cluster_id % 3 = 0 THEN upper({theme_name_sql('cluster_id')})
  WHEN cluster_id % 3 = 1 THEN '  ' || replace({theme_name_sql('cluster_id')}, ' ', '  ')
  ELSE {theme_name_sql('cluster_id')} END"""

THEME_ROWS = f"""{REVIEWS},
theme_rows AS (
  SELECT run_date, cluster_id, {NAME_VARIANT_SQL} AS theme_name,
         'action ' || cluster_id AS action_idea, count(*) AS size
  FROM reviews GROUP BY ALL
)"""

# Theme rows per day from the events: the event type is the theme.  Two of them are four times
# as frequent on even days, so that the usual alert thresholds fire.
EVENT_THEMES = """
event_themes AS (
  SELECT ts::DATE AS run_date, (user_id % 7 - 1)::INT AS cluster_id,
         CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS theme_name,
         sum(CASE WHEN event_type IN ('error', 'click') AND day(ts::DATE) % 2 = 0 THEN 4 ELSE 1 END)::BIGINT AS size
  FROM events GROUP BY ALL
)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews with tags and a stand-in theme."""
    from voxmill.operators.cleaning import tag_segments

    return tag_segments(reviews(spark, sf_dir), SEGMENT_SYLLABLES).withColumn(
        "theme_name", theme_name(F.col("cluster_id"))
    )


def theme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.col("cluster_id")
    name = theme_name(cluster)
    variant = (
        F.when(cluster == -1, name)
        .when(cluster % 3 == 0, F.upper(name))
        .when(cluster % 3 == 1, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("  "))))
        .otherwise(name)
    )
    sized = reviews(spark, sf_dir).groupBy("run_date", "cluster_id").agg(F.count("*").alias("size"))
    return sized.select(
        "run_date",
        "cluster_id",
        variant.alias("theme_name"),
        F.concat_ws(" ", F.lit("action"), "cluster_id").alias("action_idea"),
        "size",
    )


def event_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    named = F.when(user % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return (
        table(spark, sf_dir, "events")
        .select(
            F.to_date(F.col("ts").cast("timestamp")).alias("run_date"),
            (user % 7 - 1).cast("int").alias("cluster_id"),
            named.alias("theme_name"),
            F.when(F.col("event_type").isin("error", "click") & (F.dayofmonth("ts") % 2 == 0), 4).otherwise(1).alias("n"),
        )
        .groupBy("run_date", "cluster_id", "theme_name")
        .agg(F.sum("n").alias("size"))
    )
