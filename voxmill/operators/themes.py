"""From clusters of reviews to named themes with quotes and actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.functions import text as tx
from voxmill.operators.joins import lookup_join, lookup_values
from voxmill.operators.selection import running_sum, top_per_group

NOISE = -1


def cluster_sizes(assignments: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Members per cluster; the members stay rows of ``assignments``."""
    return assignments.groupBy(*keys).agg(F.count("*").alias("size"))


def theme_labels(
    assignments: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = lex.THEME_TERMS,
    default: str = lex.DEFAULT_THEME,
    keys: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """Theme of each cluster: the first rule that any of its reviews matches.

    Flags are computed per review and combined with ``bool_or``, so a cluster
    is never brought together in one place.
    """
    lowered = F.lower(F.coalesce("content", F.lit("")))
    rules = list(lexicon.items())
    flags = [tx.contains_any(lowered, terms).alias(f"_r{i}") for i, (_, terms) in enumerate(rules)]
    has_text = (F.length(tx.strip_space(F.coalesce("content", F.lit("")))) > 0).alias("_text")
    grouped = (
        assignments.select(*keys, has_text, *flags)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("size"),
            F.bool_or("_text").alias("_text"),
            *[F.bool_or(f"_r{i}").alias(f"_r{i}") for i in range(len(rules))],
        )
    )
    name = F.when(~F.col("_text"), F.lit(lex.EMPTY_THEME))
    for i, (label, _) in enumerate(rules):
        name = name.when(F.col(f"_r{i}"), F.lit(label))
    return grouped.select(*keys, "size", name.otherwise(F.lit(default)).alias("theme_name"))


def quote_rows(
    assignments: DataFrame,
    position: str,
    keys: Sequence[str] = ("cluster_id",),
    count: int = 3,
    min_chars: int = 10,
) -> DataFrame:
    """The longest distinct texts of each cluster, as rows ``(keys, quote_rank, quote)``.

    Equal texts are reduced to their first position before the shuffle.  A
    cluster without a text over ``min_chars`` gives its first non-blank text.
    """
    texts = (
        assignments.select(
            *keys, F.col(position).alias("_pos"), tx.strip_space(F.col("content")).alias("quote")
        )
        .where(F.length("quote") > 0)
        .groupBy(*keys, "quote")
        .agg(F.min("_pos").alias("_pos"))
    )
    # Long texts come first, longest first; short ones only serve as the
    # fallback, first position first.
    long = F.length("quote") > min_chars
    order = [
        F.when(long, F.length("quote")).otherwise(F.lit(0)).desc(),
        F.col("_pos"),
    ]
    ranked = top_per_group(texts, keys, order, count, ["_pos"], rank="quote_rank")
    kept = ranked.where(long | (F.col("quote_rank") == 1))
    return kept.select(*keys, "quote_rank", "quote")


def collect_quotes(quotes: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """The few quotes of each cluster as one array in rank order."""
    in_order = F.sort_array(F.collect_list(F.struct("quote_rank", "quote")))
    return quotes.groupBy(*keys).agg(
        F.transform(in_order, lambda q: q["quote"]).alias("representative_quotes")
    )


def noise_samples(
    reviews: DataFrame,
    position: str,
    keys: Sequence[str] = (),
    count: int = 2,
    chars: int | None = 100,
) -> DataFrame:
    """The first ``count`` contents, cut to ``chars`` characters, or whole ones without ``chars``.

    With no keys it serves runs without clusters; one literal key keeps the
    map-side limit of the ranked form.
    """
    content = F.coalesce("content", F.lit(""))
    cut = content if chars is None else F.substring(content, 1, chars)
    rows = reviews.withColumn("_all", F.lit(0))
    groups = list(keys) or ["_all"]
    ranked = top_per_group(rows, groups, [F.col(position)], count, [position], rank="quote_rank")
    return ranked.select(*keys, "quote_rank", cut.alias("quote"))


def cluster_report(
    assignments: DataFrame,
    position: str,
    keys: Sequence[str] = ("cluster_id",),
    lexicon: Mapping[str, Sequence[str]] = lex.THEME_TERMS,
    default: str = lex.DEFAULT_THEME,
    actions: Mapping[str, str] = lex.THEME_ACTIONS,
    noise_count: int = 2,
    noise_chars: int = 100,
) -> DataFrame:
    """One row per cluster: theme, action, quotes, size; noise has fixed texts."""
    noise = F.col("cluster_id") == NOISE
    themes = theme_labels(assignments, lexicon, default, keys)
    quotes = quote_rows(assignments.where(~noise), position, keys).unionByName(
        noise_samples(assignments.where(noise), position, keys, noise_count, noise_chars)
    )
    name = F.when(noise, F.lit(lex.NOISE_THEME)).otherwise(F.col("theme_name"))
    action = (
        F.when(noise, F.lit(lex.NOISE_ACTION))
        .when(F.col("theme_name") == lex.EMPTY_THEME, F.lit(lex.EMPTY_ACTION))
        .otherwise(lookup_values(dict(actions), F.col("theme_name"), actions.get(default, "")))
    )
    return (
        themes.join(collect_quotes(quotes, keys), list(keys), "left")
        .select(
            *keys,
            name.alias("theme_name"),
            action.alias("action_idea"),
            F.coalesce("representative_quotes", F.array().cast("array<string>")).alias(
                "representative_quotes"
            ),
            "size",
        )
    )


def whole_run_as_cluster(
    reviews: DataFrame, theme_name: str = "General Feed Feedback"
) -> DataFrame:
    """Reviews of a run without clusters, as members of the one pseudo cluster 1."""
    return reviews.withColumns({"cluster_id": F.lit(1), "theme_name": F.lit(theme_name)})


def merge_themes(
    theme_rows: DataFrame, run: Sequence[str] = ("run_date",), order: str = "cluster_id"
) -> DataFrame:
    """Merge the themes of a run that share a normalised name.

    Size is the sum, name and id come from the first row.  The action comes
    from the first row, or from the last later row that is larger than all rows
    before it together.
    """
    keys = [*run, "norm_name"]
    named = theme_rows.withColumn("norm_name", tx.normal_name(F.col("theme_name")))
    running = running_sum(named, keys, order, "size", "_before")
    takes_over = F.col("size") > F.col("_before")
    return running.groupBy(*keys).agg(
        F.min_by("cluster_id", order).alias("cluster_id"),
        F.min_by("theme_name", order).alias("theme_name"),
        F.coalesce(
            F.max_by(F.when(takes_over, F.col("action_idea")), F.when(takes_over, F.col(order))),
            F.min_by("action_idea", order),
        ).alias("action_idea"),
        F.sum("size").alias("size"),
        F.count("*").alias("merged_rows"),
    )


def merge_quotes(
    theme_quotes: DataFrame, run: Sequence[str] = ("run_date",), order: str = "cluster_id"
) -> DataFrame:
    """Distinct quotes of the merged themes, each with its first place.

    Takes rows ``(run, order, theme_name, quote_rank, quote)``.  The union is
    kept as rows: a theme may gather any number of quotes.
    """
    return (
        theme_quotes.withColumn("norm_name", tx.normal_name(F.col("theme_name")))
        .groupBy(*run, "norm_name", "quote")
        .agg(F.min(F.struct(F.col(order).alias("ord"), F.col("quote_rank"))).alias("_first"))
        .select(*run, "norm_name", "quote", F.col("_first.ord").alias("first_row"),
                F.col("_first.quote_rank").alias("first_rank"))
    )


def verify_quotes(
    proposed: DataFrame,
    assignments: DataFrame,
    position: str,
    row_id: str = "review_id",
    min_chars: int = 5,
) -> DataFrame:
    """Keep proposed quotes that occur, in any case, in a review of their cluster.

    ``proposed(cluster_id, quote_no, quote)`` holds the few quotes of each
    cluster, so each review is compared with those few only.  The result has
    the spelling of the first matching review.  A cluster without a verified
    quote gets its first non-blank text.
    """
    wanted = (
        proposed.withColumn("_clean", tx.clean_quote(F.col("quote")))
        .where(F.length("_clean") >= min_chars)
        .select("cluster_id", "quote_no", "_clean")
    )
    texts = assignments.select(
        "cluster_id",
        F.col(row_id).alias("_id"),
        F.col(position).alias("_pos"),
        tx.strip_space(F.coalesce("content", F.lit(""))).alias("_text"),
    ).where(F.length("_text") > 0)
    place = F.instr(F.lower("_text"), F.lower("_clean"))
    found = (
        lookup_join(texts, wanted, ["cluster_id"], how="inner")
        .withColumn("_at", place)
        .where(F.col("_at") > 0)
        .withColumn("_exact", tx.strip_space(F.expr("substring(_text, _at, length(_clean))")))
        .groupBy("cluster_id", "quote_no")
        .agg(F.min_by("_exact", "_pos").alias("quote"))
    )
    asked = proposed.select("cluster_id").distinct()
    unmatched = asked.join(found.select("cluster_id").distinct(), "cluster_id", "left_anti")
    first_text = (
        texts.groupBy("cluster_id")
        .agg(F.min_by("_text", "_pos").alias("quote"))
        .join(unmatched, "cluster_id", "left_semi")
        .select("cluster_id", F.lit(0).cast("int").alias("quote_no"), "quote")
    )
    return found.select("cluster_id", F.col("quote_no").cast("int").alias("quote_no"), "quote").unionByName(first_text)


def fill_synthesis_defaults(
    synthesis: DataFrame,
    default_name: str = "Feedback Cluster",
    default_action: str = "Improve recommendation quality.",
    name_chars: int = 50,
) -> DataFrame:
    """Defaults and length cap for names and actions that came from outside."""
    name: Column = F.substring(F.coalesce("theme_name", F.lit(default_name)), 1, name_chars)
    return synthesis.withColumns(
        {
            "theme_name": name,
            "action_idea": F.coalesce("action_idea", F.lit(default_action)),
        }
    )


def apply_synthesis(report: DataFrame, proposed: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Names, actions and quotes that came from outside, over those of the rules.

    ``proposed(cluster_id, theme_name, action_idea)`` has one row per cluster;
    blank or missing values, missing clusters and noise keep what the rules
    gave.  ``verified`` are the rows of ``verify_quotes``: where a cluster has
    some, they are its quotes.
    """
    given = fill_synthesis_defaults(proposed, "", "").select(
        "cluster_id",
        F.nullif(tx.strip_space(F.col("theme_name")), F.lit("")).alias("_name"),
        F.nullif(tx.strip_space(F.col("action_idea")), F.lit("")).alias("_action"),
    )
    joined = lookup_join(report, given.where(F.col("cluster_id") != NOISE), ["cluster_id"])
    out = joined.withColumns(
        {"theme_name": F.coalesce("_name", "theme_name"), "action_idea": F.coalesce("_action", "action_idea")}
    )
    if verified is not None:
        quotes = collect_quotes(verified.withColumnRenamed("quote_no", "quote_rank")).withColumnRenamed(
            "representative_quotes", "_quotes"
        )
        out = lookup_join(out, quotes, ["cluster_id"]).withColumn(
            "representative_quotes", F.coalesce("_quotes", "representative_quotes")
        )
    return out.select(*report.columns)
