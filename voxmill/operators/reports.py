"""Digest documents and alert messages as text columns.

A report is the theme rows of one run: ``cluster_id``, ``theme_name``,
``action_idea``, ``size`` and ``representative_quotes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.selection import running_sum
from voxmill.operators.themes import NOISE

# --- fixed values: lines of the documents ---------------------------------
DIGEST_INTRO = (
    "Here is the Weekly Product Review Pulse outlining customer friction themes, "
    "verbatim quotes, and actionable product ideas.\n"
)
THEME_HEAD = "### Theme %d: %s"
THEME_SIZE = "*   **Sample Size:** %d reviews / complaints mentioned this week."
THEME_ACTION = "*   **Suggested PM Action:** %s"
THEME_QUOTES = "*   **Representative Verbatim Quotes:**"
QUOTE = '    > "%s"'
NOISE_HEAD = "### Unclustered Noise / General Feedback"
NOISE_SIZE = "*   **Sample Size:** %d reviews."
NOISE_QUOTES = "*   **Sample Feedback:**"
RULE = "---\n"
MESSAGE_THEME = "- **Theme #%d:** %s (%d mentions)"
MESSAGE_ACTION = "  *PM Action Recommendation:* %s"


def theme_numbered(report: DataFrame, run: Sequence[str] = ("run_date",)) -> DataFrame:
    """Number the themes of a run 1..k in cluster order; noise has no number."""
    is_theme = F.col("cluster_id") != NOISE
    counted = report.withColumn("_one", is_theme.cast("int"))
    numbered = running_sum(counted, run, "cluster_id", "_one", "_before")
    number = F.when(is_theme, F.col("_before") + 1).cast("bigint")
    return numbered.withColumn("theme_no", number).drop("_one", "_before")


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _document(sections: DataFrame, run: Sequence[str], head: Column, foot: Column, name: str) -> DataFrame:
    """Put the sections of each run in order: themes by number, then noise."""
    ordered = F.sort_array(F.collect_list(F.struct("_no", "_text")))
    body = F.transform(ordered, lambda s: s["_text"])
    return sections.groupBy(*run).agg(body.alias("_body")).select(
        *run, _lines(head, F.array_join("_body", "\n"), foot).alias(name)
    )


def digest_sections(report: DataFrame, run: Sequence[str] = ("run_date",)) -> DataFrame:
    """One text section per theme and one for noise: ``(run, _no, _text)``."""
    quotes = F.transform("representative_quotes", lambda q: F.format_string(QUOTE, q))
    quote_lines = F.when(
        F.size(quotes) > 0, F.array_join(quotes, "\n")
    )  # null drops out of concat_ws
    theme = _lines(
        F.format_string(THEME_HEAD, F.col("theme_no"), F.upper("theme_name")),
        F.format_string(THEME_SIZE, F.col("size")),
        F.format_string(THEME_ACTION, F.col("action_idea")),
        F.lit(THEME_QUOTES),
        quote_lines,
        F.lit(""),
    )
    noise = _lines(
        F.lit(NOISE_HEAD),
        F.format_string(NOISE_SIZE, F.col("size")),
        F.lit(NOISE_QUOTES),
        quote_lines,
        F.lit(""),
    )
    last = F.lit(2**62).cast("bigint")
    return theme_numbered(report, run).select(
        *run,
        F.coalesce("theme_no", last).alias("_no"),
        F.when(F.col("cluster_id") == NOISE, noise).otherwise(theme).alias("_text"),
    )


def digest_text(
    report: DataFrame, week_of: Column, run: Sequence[str] = ("run_date",)
) -> DataFrame:
    """The digest document of each run.  A run without rows gives no document.

    A document holds one section per theme, so its size is that of a report
    someone reads; use ``digest_sections`` to keep it as rows.
    """
    head = _lines(F.concat(F.lit("## Week of "), week_of, F.lit(" (UTC)")), F.lit(DIGEST_INTRO))
    return _document(digest_sections(report, run), run, head, F.lit(RULE), "digest")


def message_text(
    report: DataFrame,
    week_of: Column,
    link: Column,
    run: Sequence[str] = ("run_date",),
    product: str = "Product",
    sender: str = "The review team",
) -> DataFrame:
    """The alert message of each run: themes with actions, and a link."""
    section = _lines(
        F.format_string(MESSAGE_THEME, F.col("theme_no"), F.upper("theme_name"), F.col("size")),
        F.format_string(MESSAGE_ACTION, F.col("action_idea")),
    )
    # Every run that has rows gets a message, even when all of them are noise.
    sections = theme_numbered(report, run).select(
        *run,
        F.coalesce("theme_no", F.lit(2**62).cast("bigint")).alias("_no"),
        F.when(F.col("cluster_id") != NOISE, section).alias("_text"),
    )
    published = F.concat(
        F.lit(f"\nThe {product} Weekly Product Review Pulse for the week of "),
        week_of,
        F.lit(" has been published."),
    )
    head = _lines(
        F.lit("Hi Team,"),
        published,
        F.concat(F.lit("\n\U0001f517 **Master Document Link:** "), link),
        F.lit("\n---"),
        F.lit("\nSummary of Emergent Themes:"),
    )
    foot = _lines(
        F.lit("\nPlease check the document link above for full verbatim quotes and historical logs."),
        F.lit("\nBest,"),
        F.lit(f"\n{sender}"),
    )
    return _document(sections, run, head, foot, "message")


def message_record(messages: DataFrame, to: Column, subject: Column, at: Column) -> DataFrame:
    """Outbox rows ``to, subject, body, timestamp``."""
    return messages.select(
        to.alias("to"),
        subject.alias("subject"),
        F.col("message").alias("body"),
        F.date_format(at, "yyyyMMdd_HHmmss").alias("timestamp"),
    )
