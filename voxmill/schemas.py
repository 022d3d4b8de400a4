"""Explicit schemas of the records; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_REVIEW = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("app_version", T.StringType()),
    ]
)

CLEAN_REVIEW = T.StructType(
    RAW_REVIEW.fields
    + [
        T.StructField("inferred_segments", T.ArrayType(T.StringType())),
        T.StructField("is_translated", T.BooleanType()),
        T.StructField("premium_status", T.BooleanType()),
    ]
)

# One row of a cluster-run file: a theme with its member reviews.
CLUSTER_ROW = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("theme_name", T.StringType()),
        T.StructField("action_idea", T.StringType()),
        T.StructField("representative_quotes", T.ArrayType(T.StringType())),
        T.StructField("size", T.LongType()),
        T.StructField("reviews", T.ArrayType(CLEAN_REVIEW)),
    ]
)

EXPERIMENT_CARD = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("theme_name", "title", "hypothesis", "cohort", "metric", "id", "created_at")
    ]
)


def _label(*path: str) -> T.StructType:
    """``{"label": string}`` wrapped in one struct per path element."""
    node = T.StructType([T.StructField("label", T.StringType())])
    for name in reversed(path):
        node = T.StructType([T.StructField(name, node)])
    return node


# Nested-label feed: every value sits in a {"label": ...} object.
LABEL_FEED_ENTRY = T.StructType(
    [
        T.StructField("id", _label()),
        T.StructField("author", _label("name")),
        T.StructField("title", _label()),
        T.StructField("content", _label()),
        T.StructField("im:rating", _label()),
        T.StructField("im:version", _label()),
        T.StructField("updated", _label()),
    ]
)

STORE_ROW = T.StructType(
    [
        T.StructField("reviewId", T.StringType()),
        T.StructField("userName", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("reviewCreatedVersion", T.StringType()),
    ]
)

FORUM_POST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
    ]
)

FORUM_LISTING = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "children",
                        T.ArrayType(T.StructType([T.StructField("data", FORUM_POST)])),
                    )
                ]
            ),
        )
    ]
)
