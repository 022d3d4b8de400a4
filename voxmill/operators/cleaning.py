"""Filters and enrichment of reviews: gates, redaction, translation, tags, time windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.functions import text as tx
from voxmill.functions.dates import parse_date
from voxmill.operators.joins import lookup_join


def gate(
    reviews: DataFrame,
    max_chars: int = lex.MAX_CONTENT_LENGTH,
    length: bool = True,
    characters: bool = True,
) -> DataFrame:
    """Keep reviews whose raw content passes the length and character gates."""
    kept = reviews
    if length:
        kept = kept.where(tx.passes_length(F.col("content"), max_chars))
    if characters:
        kept = kept.where(tx.passes_characters(F.col("content")))
    return kept


def clusterable(reviews: DataFrame) -> DataFrame:
    """Keep reviews with enough text to be vectorised."""
    return reviews.where(tx.is_clusterable(F.col("content")))


def tag_segments(
    reviews: DataFrame, lexicon: Mapping[str, Sequence[str]] = lex.SEGMENT_TERMS
) -> DataFrame:
    """Add ``inferred_segments`` from title and content.

    Lower case and matches are columns of their own, so that each is computed
    once per row although it is used several times.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return (
        reviews.withColumn("_lowered", F.lower(text))
        .withColumn("_found", tx.matching_tags(F.col("_lowered"), lexicon))
        .withColumn("inferred_segments", tx.or_default(F.col("_found")))
        .drop("_lowered", "_found")
    )


def clean(
    reviews: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = lex.SEGMENT_TERMS,
    memory: DataFrame | None = None,
    gates: bool = True,
    max_chars: int = lex.MAX_CONTENT_LENGTH,
) -> DataFrame:
    """The whole clean step: gates, redaction, translation, tags.

    Without a translation memory the plan has no shuffle and no Python: one
    scan, one filter, one projection.  That form also runs on a stream.
    """
    kept = gate(reviews, max_chars) if gates else reviews
    scrubbed = kept.withColumns(
        {
            "title": tx.scrub_pii(F.col("title")),
            "content": tx.scrub_pii(F.col("content")),
        }
    )
    if memory is None:
        translated = scrubbed.withColumn("is_translated", F.lit(False))
    else:
        original = scrubbed.withColumn("_scrubbed", F.col("content"))
        translated = (
            translate(translate(original, memory, "title"), memory, "content")
            .withColumn("is_translated", F.col("content") != F.col("_scrubbed"))
            .drop("_scrubbed")
        )
    return tag_segments(translated, lexicon)


def translation_queue(
    reviews: DataFrame, column: str = "content", threshold: float = lex.ENGLISH_ASCII_SHARE
) -> DataFrame:
    """Distinct texts that need a translation, with how many rows wait for each."""
    return (
        reviews.where(tx.needs_translation(F.col(column), threshold))
        .groupBy(F.col(column).alias("source_text"))
        .agg(F.count("*").alias("waiting"))
        .withColumn("source_hash", F.sha2("source_text", 256))
    )


def translate(
    reviews: DataFrame,
    memory: DataFrame,
    column: str = "content",
    threshold: float = lex.ENGLISH_ASCII_SHARE,
) -> DataFrame:
    """Replace foreign texts by their entry in ``memory(source_hash, text_en)``.

    A text without an entry stays.  Only rows that need a translation go
    through the join; the others are added after it as they are, unshuffled.
    """
    needed = F.coalesce(tx.needs_translation(F.col(column), threshold), F.lit(False))
    foreign = reviews.where(needed).withColumn("source_hash", F.sha2(F.col(column), 256))
    joined = lookup_join(foreign, memory.select("source_hash", "text_en"), ["source_hash"])
    translated = joined.withColumn(column, F.coalesce("text_en", column)).select(*reviews.columns)
    return translated.unionByName(reviews.where(~needed))


def anchored_window(
    reviews: DataFrame,
    now: Column,
    hours: int = 24,
    lagging_source: str = "app_store",
    anchors_from: DataFrame | None = None,
) -> DataFrame:
    """Keep rows of the last ``hours`` before an anchor; rows without a date stay.

    The anchor of the lagging source is its own latest date (taken from
    ``anchors_from``, the raw rows, if given), of all others it is ``now``.
    Rows after their anchor are dropped.  The anchor is one value from a scalar
    subquery, so nothing is joined.
    """
    raw = reviews if anchors_from is None else anchors_from
    latest = (
        raw.where(F.col("source") == lagging_source)
        .agg(F.max(parse_date(F.col("date"))))
        .scalar()
    )
    at = parse_date(F.col("date"))
    anchor = F.when(F.col("source") == lagging_source, F.coalesce(latest, now)).otherwise(now)
    age = F.unix_micros(anchor) - F.unix_micros(at)
    return reviews.where(at.isNull() | age.between(0, hours * 3600 * 1_000_000))


def since(reviews: DataFrame, now: Column, seconds: Column) -> DataFrame:
    """Keep rows dated at most ``seconds`` before ``now``; undated and future rows stay."""
    at = F.coalesce(parse_date(F.col("date")), now)
    return reviews.where(F.unix_micros(at) >= F.unix_micros(now) - seconds * F.lit(1_000_000))


def pii_audit(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Redactions per kind and group: one pass, counts combined before the shuffle."""
    counts = tx.count_pii(F.col(column))
    return (
        rows.select(F.col(by), *[n.alias(kind) for kind, n in counts.items()])
        .groupBy(by)
        .agg(*[F.sum(kind).cast("bigint").alias(f"{kind}_hits") for kind in counts])
    )
