"""Checks of the analyst views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.checks import view as v
from voxmill.checks.registry import check
from voxmill.functions import lexicons as lex
from voxmill.functions import ratings
from voxmill.functions import text as tx
from voxmill.operators import views

COHORTS = list(v.COHORTS_SQL)

POLARITY_SQL = (
    "count(*) FILTER (rating >= 4) AS positive, count(*) FILTER (rating <= 2) AS negative, "
    "count(*) FILTER (rating = 3) AS neutral"
)


@check(
    "cohort_filter",
    f"WITH {v.MEMBERS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS cohort, review_id FROM members WHERE {test}"
        for c, test in v.COHORTS_SQL.items()
    ),
)
def cohort_filter(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.when(ratings.in_cohort(c), F.lit(c)) for c in COHORTS])
    rows = v.members(spark, sf)
    found = rows.select(F.explode_outer(names).alias("cohort"), "review_id")
    return found.where(F.col("cohort").isNotNull())


@check(
    "kpi_cards",
    f"WITH {v.MEMBERS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS cohort, count(*) FILTER ({test}) AS total_reviews,
        count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS themes,
        round(100.0::DOUBLE * count(*) FILTER ({test} AND cluster_id <> -1
          AND regexp_matches(lower(theme_name), 'loop|shuffle|repeat|recommend')) / count(*) FILTER ({test}))::BIGINT AS friction_pct
        FROM members"""
        for c, test in v.COHORTS_SQL.items()
    ),
)
def kpi_cards(spark: SparkSession, sf: str) -> DataFrame:
    return views.kpi_cards(v.members(spark, sf), COHORTS)


def _need_sql(segment: str) -> str:
    cases = " ".join(f"WHEN {v.quoted(k)} THEN {v.quoted(n)}" for k, n in lex.SEGMENT_NEEDS.items())
    return f"CASE {segment} {cases} ELSE {v.quoted(lex.DEFAULT_NEED)} END"


@check(
    "top_segments",
    f"""WITH {v.MEMBERS}, tagged AS (SELECT unnest(string_split(segments, '|')) AS segment FROM members)
    SELECT segment, count(*) AS mentions,
      round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM members))::BIGINT AS share_pct, {_need_sql('segment')} AS need
    FROM tagged WHERE segment <> 'General Feedback' GROUP BY segment ORDER BY mentions DESC, segment LIMIT 3""",
)
def top_segments(spark: SparkSession, sf: str) -> DataFrame:
    return views.top_segments(v.members(spark, sf))


@check(
    "source_breakdown",
    f"WITH {v.MEMBERS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS cohort, '{s}' AS source, count(*) FILTER (source = '{s}' AND {test}) AS reviews FROM members"
        for c, test in v.COHORTS_SQL.items()
        for s in lex.SOURCES
    ),
)
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return views.source_breakdown(v.members(spark, sf), COHORTS)


SHORT_SQL = "CASE WHEN length({0}) > 20 THEN substring({0}, 1, 18) || '...' ELSE {0} END"


@check(
    "theme_distribution",
    f"WITH {v.MEMBERS} "
    + " UNION ALL ".join(
        f"""SELECT cluster_id, theme_name, '{c}' AS cohort, count(*) FILTER ({test}) AS reviews,
        {SHORT_SQL.format('theme_name')} AS label FROM members WHERE cluster_id <> -1 GROUP BY cluster_id, theme_name"""
        for c, test in v.COHORTS_SQL.items()
    ),
)
def theme_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return views.theme_distribution(v.members(spark, sf), COHORTS)


@check(
    "theme_polarity",
    f"WITH {v.MEMBERS} SELECT cluster_id, theme_name, {POLARITY_SQL} FROM members GROUP BY cluster_id, theme_name",
)
def theme_polarity(spark: SparkSession, sf: str) -> DataFrame:
    return views.theme_polarity(v.members(spark, sf))


@check(
    "theme_crosstab",
    f"""WITH {v.MEMBERS} SELECT cluster_id, theme_name, {POLARITY_SQL},
    {', '.join(f'count(*) FILTER ({t}) AS {c}' for c, t in v.COHORTS_SQL.items() if c != 'all')}
    FROM members GROUP BY cluster_id, theme_name""",
)
def theme_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return views.theme_crosstab(v.members(spark, sf))


@check(
    "theme_sentiment",
    f"""WITH {v.MEMBERS}, judged AS (
      SELECT doc_id % 40 AS cluster_id, {v.theme_name_sql('(doc_id % 40)')} AS theme_name, review_id,
        CASE WHEN doc_id % 40 < 10 THEN 5 WHEN doc_id % 40 < 20 THEN NULL ELSE rating END AS rating FROM members),
    means AS (SELECT cluster_id, theme_name, count(*) AS reviews, avg(coalesce(rating, 0)) AS mean FROM judged GROUP BY ALL)
    SELECT cluster_id, theme_name, reviews, round(mean, 6) AS avg_rating,
      CASE WHEN mean >= 3.7 THEN 'positive' WHEN mean <= 2.5 THEN 'negative'
           WHEN regexp_matches(lower(theme_name), 'fatigue|frustration|disruption|glitch|gap|stale|friction|opacity')
           THEN 'negative' ELSE 'neutral' END AS sentiment FROM means""",
)
def theme_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    cluster = F.col("doc_id") % 40
    rating = F.when(cluster < 10, F.lit(5)).when(cluster >= 20, F.col("rating"))
    rows = v.reviews(spark, sf).select(
        "review_id",
        cluster.alias("cluster_id"),
        v.theme_name(cluster).alias("theme_name"),
        rating.alias("rating"),
    )
    return views.theme_sentiment(rows)


@check(
    "label_short",
    f"WITH {v.REVIEWS} SELECT review_id, {SHORT_SQL.format('content')} AS label FROM reviews",
)
def label_short(spark: SparkSession, sf: str) -> DataFrame:
    return v.reviews(spark, sf).select("review_id", tx.short_label(F.col("content")).alias("label"))
