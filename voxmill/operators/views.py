"""Analyst views over labelled reviews.

``members`` means review rows that also carry ``cluster_id`` and ``theme_name``.
``theme_rows`` means one row per run and cluster: ``run_date``, ``cluster_id``,
``theme_name``, ``size`` and, where needed, ``action_idea``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.functions import ratings
from voxmill.functions import text as tx
from voxmill.operators.joins import lookup_values
from voxmill.operators.themes import NOISE

_THEME = ["cluster_id", "theme_name"]


def _percent(part: Column, whole: Column, digits: int = 0) -> Column:
    share = F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    return F.round(share, digits)


def ingest_summary(
    raw: DataFrame, cleaned: DataFrame, sources: Sequence[str] = lex.SOURCES
) -> DataFrame:
    """Raw and clean rows per source; known sources appear even with no row."""
    seeds = raw.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"),
        F.lit(0).cast("bigint").alias("raw_count"),
        F.lit(0).cast("bigint").alias("clean_count"),
    )
    none = F.lit(0).cast("bigint")
    raw_counts = raw.groupBy("source").agg(F.count("*").alias("raw_count"))
    clean_counts = cleaned.groupBy("source").agg(F.count("*").alias("clean_count"))
    return (
        seeds.unionByName(raw_counts.withColumn("clean_count", none))
        .unionByName(clean_counts.withColumn("raw_count", none))
        .groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
        .agg(F.sum("raw_count").alias("raw_count"), F.sum("clean_count").alias("clean_count"))
    )


def segment_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per segment tag; a review counts once under each of its tags.

    The outer form of explode keeps Spark from adding a filter on the tags, which
    would compute them twice.
    """
    return (
        reviews.select(F.explode_outer("inferred_segments").alias("segment"))
        .where(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(F.count("*").alias("reviews"))
    )


def top_segments(
    members: DataFrame, count: int = 3, needs: Mapping[str, str] = lex.SEGMENT_NEEDS
) -> DataFrame:
    """The most frequent segments, their share of all reviews, and what they need.

    Every review also counts under one extra entry, so shares and the total come
    from the same pass.  The window runs over one row per segment.
    """
    tags = F.coalesce("inferred_segments", F.array().cast("array<string>"))
    counts = (
        members.select(F.explode_outer(F.array_append(tags, F.lit(""))).alias("segment"))
        .groupBy("segment")
        .agg(F.count("*").alias("mentions"))
    )
    total = F.max(F.when(F.col("segment") == "", F.col("mentions"))).over(
        W.partitionBy(F.lit(0))
    )
    return (
        counts.withColumn("_total", total)
        .where(~F.col("segment").isin("", lex.DEFAULT_SEGMENT))
        .orderBy(F.col("mentions").desc(), "segment")
        .limit(count)
        .select(
            "segment",
            "mentions",
            _percent(F.col("mentions"), F.col("_total")).cast("bigint").alias("share_pct"),
            lookup_values(dict(needs), F.col("segment"), lex.DEFAULT_NEED).alias("need"),
        )
    )


def _by_cohort(counts: DataFrame, keep: Sequence[str], cohorts: Sequence[str]) -> DataFrame:
    """One column of counts per cohort to one row per cohort."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("cohort"), F.col(c).alias("reviews")) for c in cohorts]
    )
    return counts.select(*keep, F.inline(pairs))


def kpi_cards(members: DataFrame, cohorts: Sequence[str] = ("all",)) -> DataFrame:
    """Total reviews, themes and friction share of a run under each cohort filter.

    All cohorts are counted in one pass.  The number of themes is not reduced by
    the filter.
    """
    named = tx.contains_any(F.lower("theme_name"), lex.FRICTION_TERMS)
    themed = F.col("cluster_id") != NOISE
    counts = members.groupBy(*_THEME).agg(
        *[F.count_if(ratings.in_cohort(c)).alias(c) for c in cohorts]
    )
    return (
        _by_cohort(counts, _THEME, cohorts)
        .groupBy("cohort")
        .agg(
            F.sum("reviews").alias("total_reviews"),
            F.count_if(themed).alias("themes"),
            F.sum(F.when(themed & named, F.col("reviews"))).alias("_friction"),
        )
        .select(
            "cohort",
            "total_reviews",
            "themes",
            _percent(F.coalesce("_friction", F.lit(0)), F.col("total_reviews"))
            .cast("bigint")
            .alias("friction_pct"),
        )
    )


def source_breakdown(
    members: DataFrame,
    cohorts: Sequence[str] = ("all",),
    sources: Sequence[str] = lex.SOURCES,
) -> DataFrame:
    """Reviews of the known sources under each cohort filter, zeros included."""
    counts = members.agg(
        *[
            F.count_if(ratings.in_cohort(c) & (F.col("source") == s)).alias(f"{c}/{s}")
            for c in cohorts
            for s in sources
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("cohort"), F.lit(s).alias("source"), F.col(f"{c}/{s}").alias("reviews")
            )
            for c in cohorts
            for s in sources
        ]
    )
    return counts.select(F.inline(cells))


def theme_distribution(members: DataFrame, cohorts: Sequence[str] = ("all",)) -> DataFrame:
    """Themes without noise by size under each cohort filter, largest first."""
    counts = (
        members.where(F.col("cluster_id") != NOISE)
        .groupBy(*_THEME)
        .agg(*[F.count_if(ratings.in_cohort(c)).alias(c) for c in cohorts])
    )
    return (
        _by_cohort(counts, _THEME, cohorts)
        .withColumn("label", tx.short_label(F.col("theme_name")))
        .orderBy("cohort", F.col("reviews").desc(), "cluster_id")
    )


def theme_polarity(members: DataFrame) -> DataFrame:
    """Positive, neutral and negative reviews per theme."""
    kind = ratings.polarity(F.col("rating"))
    return members.groupBy(*_THEME).agg(
        *[F.count_if(kind == k).alias(k) for k in ("positive", "neutral", "negative")]
    )


def theme_crosstab(members: DataFrame) -> DataFrame:
    """Cohort and polarity counts per theme in one pass."""
    kind = ratings.polarity(F.col("rating"))
    cohorts = ["premium", "free", "ios", "android"]
    return members.groupBy(*_THEME).agg(
        *[F.count_if(ratings.in_cohort(c)).alias(c) for c in cohorts],
        *[F.count_if(kind == k).alias(k) for k in ("positive", "negative", "neutral")],
    )


def theme_sentiment(members: DataFrame) -> DataFrame:
    """Sentiment per theme from the mean rating and the name; no rating counts 0."""
    return (
        members.groupBy(*_THEME)
        .agg(
            F.count("review_id").alias("reviews"),
            F.avg(F.coalesce("rating", F.lit(0))).alias("_avg"),
        )
        .select(
            *_THEME,
            "reviews",
            F.round("_avg", 6).alias("avg_rating"),
            ratings.theme_sentiment(F.col("reviews"), F.col("_avg"), F.col("theme_name")).alias(
                "sentiment"
            ),
        )
    )


def _recent(theme_rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    return theme_rows.where(F.col("run_date") >= F.date_sub(as_of, days))


def _daily(theme_rows: DataFrame, order: str) -> DataFrame:
    """Size and display name per day and theme, with the size of the whole day.

    The name is the one of the largest single contribution, the earlier one
    when equal.  Noise counts in the day's size only.
    """
    normal = F.when(F.col("cluster_id") != NOISE, tx.normal_name(F.col("theme_name")))
    per_theme = (
        theme_rows.select("*", normal.alias("norm_name"))
        .groupBy("run_date", "norm_name")
        .agg(
            F.sum("size").alias("size"),
            F.max(F.struct(F.col("size"), (-F.col(order)).alias("o"), "theme_name")).alias("_top"),
        )
    )
    day_size = F.sum("size").over(W.partitionBy("run_date"))  # a day's themes, not its reviews
    return (
        per_theme.withColumn("day_size", day_size)
        .where(F.col("norm_name").isNotNull())
        .withColumns({"theme_name": F.col("_top.theme_name"), "top_size": F.col("_top.size")})
        .drop("_top")
    )


def theme_daily_share(
    theme_rows: DataFrame, as_of: Column, days: int = 30, order: str = "cluster_id"
) -> DataFrame:
    """Percent of each day's reviews per theme, every theme on every day.

    The days of the window are one small array (at most ``days`` past days and
    whatever lies ahead of ``as_of``) that each theme is laid over; a day on
    which a theme is missing gives 0.
    """
    recent = _recent(theme_rows, as_of, days)
    all_days = recent.agg(F.sort_array(F.collect_set("run_date"))).scalar()
    return _shares(_daily(recent, order), all_days)


def _shares(daily: DataFrame, all_days: Column) -> DataFrame:
    grid = (
        daily.groupBy("norm_name")
        .agg(F.max_by("theme_name", F.struct("top_size", "run_date")).alias("series_name"))
        .withColumn("run_date", F.explode(all_days))
    )
    return grid.join(daily, ["run_date", "norm_name"], "left").select(
        "run_date",
        "norm_name",
        F.coalesce("theme_name", "series_name").alias("theme_name"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        _percent(F.coalesce("size", F.lit(0)), F.col("day_size"), 1).alias("share_pct"),
    )


def spike_alerts(
    theme_rows: DataFrame,
    as_of: Column,
    days: int = 30,
    ratio: float = 1.5,
    floor_pct: float = 5.0,
    order: str = "cluster_id",
) -> DataFrame:
    """Themes whose share jumped from the previous available day to the latest."""
    sides = _day_over_day(theme_rows, as_of, days, order).where("is_latest")
    return _alerts(sides, ratio, floor_pct).drop("run_date", "is_latest")


def spike_history(
    theme_rows: DataFrame,
    as_of: Column,
    days: int = 30,
    ratio: float = 1.5,
    floor_pct: float = 5.0,
    order: str = "cluster_id",
) -> DataFrame:
    """The same test for every day of the window against the day before it."""
    sides = _day_over_day(theme_rows, as_of, days, order)
    return _alerts(sides, ratio, floor_pct).drop("is_latest")


def _day_over_day(theme_rows: DataFrame, as_of: Column, days: int, order: str) -> DataFrame:
    """Each theme's share per day, beside its share of the previous available day.

    Days are numbered by their place among the days that have runs, so a theme
    missing on the previous day has no share there.  A theme has one row per day
    of the window; nothing is joined to itself.
    """
    recent = _recent(theme_rows, as_of, days)
    run_days = recent.agg(F.sort_array(F.collect_set("run_date"))).scalar()
    return _sides(_daily(recent, order), run_days)


def _sides(daily: DataFrame, run_days: Column) -> DataFrame:
    share = 100.0 * F.col("size") / F.nullif(F.col("day_size"), F.lit(0))
    before = W.partitionBy("norm_name").orderBy("_place")
    last = F.lag(F.struct("_place", "latest_pct")).over(before)
    return (
        daily.withColumn("_days", run_days)
        .withColumns({"latest_pct": share, "_place": F.array_position("_days", F.col("run_date"))})
        .withColumn("_last", last)
        .select(
            "run_date",
            "norm_name",
            "theme_name",
            "latest_pct",
            F.when(F.col("_last._place") == F.col("_place") - 1, F.col("_last.latest_pct")).alias(
                "previous_pct"
            ),
            (F.col("_place") == F.size("_days")).alias("is_latest"),
        )
    )


def _alerts(sides: DataFrame, ratio: float, floor_pct: float) -> DataFrame:
    latest, previous = F.col("latest_pct"), F.col("previous_pct")
    fired = (previous > 0) & (latest >= previous * ratio) & (latest > floor_pct)
    return sides.where(fired).withColumns(
        {"latest_pct": F.round(latest, 1), "previous_pct": F.round(previous, 1)}
    )
