"""Source payloads to review records.

Each function takes landed payloads as a DataFrame and returns the columns of
``schemas.RAW_REVIEW`` plus ``feed_pos`` (order within the feed) and the
``region`` of the page, if there was one.  ``page_pos`` orders the pages.
Nothing is dropped but the rows the feed rules reject; use
``operators.selection.first_seen`` on the result to de-duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill import schemas
from voxmill.functions.text import strip_space

_PAGE_ROWS = 1_000_000  # feed_pos = page_pos * _PAGE_ROWS + place in the page
NEUTRAL_RATING = 3
TITLE_MIN_CHARS = 30


def _iso(at: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.ffffff]Z``."""
    micros = F.when(
        F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")
    ).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.lit("Z"))


def _region(pages: DataFrame) -> list[Column]:
    return [F.col("region")] if "region" in pages.columns else []


def json_items(payload: Column, path: str, schema: T.DataType) -> Column:
    """The array at ``path`` of a JSON text; a single object counts as an array of one."""
    found = F.get_json_object(payload, path)
    wrapped = F.when(found.startswith("{"), F.concat(F.lit("["), found, F.lit("]")))
    return F.from_json(wrapped.otherwise(found), T.ArrayType(schema))


def label_feed_reviews(
    pages: DataFrame, now: Column, source: str = "app_store", payload: str = "payload"
) -> DataFrame:
    """Feed pages whose values sit in ``{"label": ...}`` objects.

    An entry without a rating object is not a review; an entry without an id or
    with a rating that is no whole number is skipped.
    """
    entries = pages.select(
        "page_pos",
        *_region(pages),
        # The outer form keeps Spark from parsing the page once more in a filter;
        # pages without entries fall out with the entries that have no rating.
        F.posexplode_outer(
            json_items(F.col(payload), "$.feed.entry", schemas.LABEL_FEED_ENTRY)
        ).alias("_at", "_e"),
    )

    def label(*path: str) -> Column:
        found = F.col("_e")
        for name in path:
            found = found.getField(name)
        return found.getField("label")

    rating = F.trim(F.coalesce(label("im:rating"), F.lit("0"))).try_cast("int")
    updated = F.nullif(label("updated"), F.lit(""))
    return (
        entries.where(F.col("_e").getField("im:rating").isNotNull())
        .where(F.coalesce(label("id"), F.lit("")) != "")
        .where(rating.isNotNull())
        .select(
            label("id").alias("review_id"),
            F.lit(source).alias("source"),
            F.coalesce(label("author", "name"), F.lit("Anonymous")).alias("author"),
            F.coalesce(label("title"), F.lit("")).alias("title"),
            F.coalesce(label("content"), F.lit("")).alias("content"),
            rating.alias("rating"),
            F.coalesce(updated, _iso(now)).alias("date"),
            F.coalesce(label("im:version"), F.lit("")).alias("app_version"),
            *_region(pages),
            (F.col("page_pos") * _PAGE_ROWS + F.col("_at")).alias("feed_pos"),
        )
    )


def store_reviews(
    rows: DataFrame, now: Column, source: str = "play_store", position: str = "feed_pos"
) -> DataFrame:
    """Store rows in the shape of ``schemas.STORE_ROW``; blank contents are skipped."""
    return (
        rows.where(F.coalesce("reviewId", F.lit("")) != "")
        .where(strip_space(F.coalesce("content", F.lit(""))) != "")
        .select(
            F.col("reviewId").alias("review_id"),
            F.lit(source).alias("source"),
            F.coalesce("userName", F.lit("Anonymous")).alias("author"),
            F.lit("").alias("title"),
            "content",
            F.coalesce("score", F.lit(0)).cast("int").alias("rating"),
            F.coalesce(_iso(F.col("at")), _iso(now)).alias("date"),
            F.coalesce("reviewCreatedVersion", F.lit("")).alias("app_version"),
            *_region(rows),
            F.col(position).alias("feed_pos"),
        )
    )


def post_content(body: Column, title: Column, min_title: int = TITLE_MIN_CHARS) -> Column:
    """Trimmed body, or a trimmed title over ``min_title`` characters, else null."""
    text = strip_space(F.coalesce(body, F.lit("")))
    head = strip_space(F.coalesce(title, F.lit("")))
    return F.when(text != "", text).when(F.length(head) > min_title, head)


def forum_posts(posts: DataFrame, now: Column, source: str = "reddit", position: str = "feed_pos") -> DataFrame:
    """Posts in the shape of ``schemas.FORUM_POST``, one per row."""
    made = F.col("created_utc")
    return (
        posts.where(F.coalesce("id", F.lit("")) != "")
        .withColumn("content", post_content(F.col("selftext"), F.col("title")))
        .where(F.col("content").isNotNull())
        .select(
            F.concat(F.lit(f"{source}_"), F.col("id")).alias("review_id"),
            F.lit(source).alias("source"),
            F.coalesce("author", F.lit("Anonymous")).alias("author"),
            strip_space(F.coalesce("title", F.lit(""))).alias("title"),
            "content",
            F.lit(NEUTRAL_RATING).alias("rating"),
            F.coalesce(
                F.when(made != 0, _iso(F.timestamp_seconds(made))), _iso(now)
            ).alias("date"),
            F.lit("").alias("app_version"),
            F.col(position).alias("feed_pos"),
        )
    )


def forum_listing_reviews(
    pages: DataFrame, now: Column, source: str = "reddit", payload: str = "payload"
) -> DataFrame:
    """Listing pages ``data.children[].data`` to reviews."""
    listing = F.from_json(F.col(payload), schemas.FORUM_LISTING)
    posts = pages.select(
        "page_pos", F.posexplode_outer(listing["data"]["children"]).alias("_at", "_child")
    ).select("_child.data.*", (F.col("page_pos") * _PAGE_ROWS + F.col("_at")).alias("feed_pos"))
    return forum_posts(posts, now, source)


def union_sources(*sources: DataFrame | None) -> DataFrame:
    """All sources under one schema; a source that could not be read is ``None``."""
    present = [s for s in sources if s is not None]
    if not present:
        raise ValueError("no source could be read")
    merged = present[0]
    for other in present[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
