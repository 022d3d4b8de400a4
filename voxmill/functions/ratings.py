"""Polarity of reviews and sentiment of themes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.functions.text import contains_any


def polarity(rating: Column) -> Column:
    """4 and up positive, 2 and down negative, everything else neutral."""
    return (
        F.when(rating >= 4, "positive").when(rating <= 2, "negative").otherwise("neutral")
    )


def theme_sentiment(reviews: Column, average: Column, theme_name: Column) -> Column:
    """Sentiment of a theme from its mean rating, then from its name."""
    named_badly = contains_any(F.lower(theme_name), lex.NEGATIVE_NAME_TERMS)
    return (
        F.when(reviews == 0, "neutral")
        .when(average >= 3.7, "positive")
        .when(average <= 2.5, "negative")
        .when(named_badly, "negative")
        .otherwise("neutral")
    )


def in_cohort(cohort: str) -> Column:
    """Filter on review columns for ``all``, ``premium``, ``free``, ``ios`` or ``android``."""

    def tagged(word: str) -> Column:
        # Joined by line ends, which no word contains, the tags are one text.
        return F.lower(F.array_join("inferred_segments", "\n")).contains(word)

    cohorts = {
        "all": F.lit(True),
        "premium": tagged("premium") | F.coalesce(F.col("premium_status"), F.lit(False)),
        "free": tagged("free"),
        "ios": F.col("source") == "app_store",
        "android": F.col("source") == "play_store",
    }
    return F.coalesce(cohorts[cohort], F.lit(False))
