"""Experiment drafts, cards and their effect on theme shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import normal_name
from voxmill.operators.themes import NOISE

# --- fixed values: texts of a draft --------------------------------------
TITLE_FORMAT = "A/B Test: %s"
HYPOTHESIS_FORMAT = (
    "If we address the '%s' complaint by implementing: %s, "
    "then we will increase active music discovery session metric Lifts."
)
DEFAULT_METRIC = "+10% engagement lift"
DEFAULT_ACTION = "N/A"


def latest_run(theme_rows: DataFrame, run: str = "run_date") -> DataFrame:
    """The theme rows of the newest run that has any."""
    newest = theme_rows.agg(F.max(run)).scalar()
    return theme_rows.where(F.col(run) == newest)


def experiment_draft(
    theme_rows: DataFrame,
    run: str = "run_date",
    title: str = TITLE_FORMAT,
    hypothesis: str = HYPOTHESIS_FORMAT,
    metric: str = DEFAULT_METRIC,
) -> DataFrame:
    """A pre-filled card for each theme, without noise, of the latest run."""
    action = F.coalesce(F.nullif("action_idea", F.lit("")), F.lit(DEFAULT_ACTION))
    return latest_run(theme_rows, run).where(F.col("cluster_id") != NOISE).select(
        "theme_name",
        F.format_string(title, "theme_name").alias("title"),
        F.format_string(hypothesis, F.col("theme_name"), action).alias("hypothesis"),
        F.lit(metric).alias("metric"),
    )


def experiment_cards(drafts: DataFrame, cohort: Column, created_at: Column) -> DataFrame:
    """Cards ready to append; drafts with an empty required field are left out.

    The id is a hash of the fields: cards made in the same second stay apart and
    a repeated append of the same card can be recognised.
    """
    required = ["theme_name", "title", "hypothesis", "metric"]
    complete = drafts
    for name in required:
        complete = complete.where(F.coalesce(F.col(name), F.lit("")) != "")
    stamp = F.concat(F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    fields = ["theme_name", "title", "hypothesis", "cohort", "metric", "created_at"]
    return (
        complete.withColumns({"cohort": cohort, "created_at": stamp})
        .withColumn(
            "id", F.concat(F.lit("card_"), F.sha2(F.concat_ws("\x1f", *fields), 256))
        )
        .select("theme_name", "title", "hypothesis", "cohort", "metric", "id", "created_at")
    )


def experiment_effect(cards: DataFrame, daily_share: DataFrame) -> DataFrame:
    """Mean share of each card's theme before and from the day of the card.

    ``daily_share`` has one row per day and theme; days are few, so a theme's rows
    are few however many reviews it has.
    """
    begun = F.to_date(F.substring("created_at", 1, 10))
    keyed = cards.select(
        "id", "theme_name", normal_name(F.col("theme_name")).alias("norm_name"), begun.alias("_day")
    )
    shares = daily_share.select("norm_name", "run_date", "share_pct")
    before = F.avg(F.when(F.col("run_date") < F.col("_day"), F.col("share_pct")))
    after = F.avg(F.when(F.col("run_date") >= F.col("_day"), F.col("share_pct")))
    return (
        keyed.join(shares, "norm_name", "left")
        .groupBy("id", "theme_name")
        .agg(before.alias("_b"), after.alias("_a"))
        .select(
            "id",
            "theme_name",
            F.round("_b", 6).alias("share_before"),
            F.round("_a", 6).alias("share_after"),
            F.round(F.col("_a") - F.col("_b"), 6).alias("change"),
        )
    )
