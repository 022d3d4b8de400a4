"""Checks of cluster synthesis: labels, quotes, reports, merging, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.checks import view as v
from voxmill.checks.registry import check
from voxmill.functions import lexicons as lex
from voxmill.operators import reports, themes
from voxmill.plans.delivery import deliver
from voxmill.session import cut_lineage, work_dir

DOC_CLUSTERS = f"""{v.REVIEWS},
assigned AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id END::INT AS cluster_id) FROM reviews)"""


def _flags_sql(lexicon: dict) -> str:
    return ", ".join(
        f"bool_or({v.any_sql('lower(content)', terms)}) AS r{i}"
        for i, terms in enumerate(lexicon.values())
    )


def labels_sql(lexicon: dict, keys: str, source: str) -> str:
    return f"""labelled AS (
      SELECT {keys}, size, CASE WHEN NOT has_text THEN 'General Feedback'
        {v.theme_case_sql('r', len(lexicon))} ELSE 'User Experience Insights' END AS theme_name
      FROM (SELECT {keys}, count(*) AS size, bool_or(content <> '') AS has_text, {_flags_sql(lexicon)}
            FROM {source} GROUP BY {keys}))"""


def quotes_sql(keys: str, source: str) -> str:
    return f"""texts AS (
      SELECT {keys}, content AS quote, min(feed_pos) AS place FROM {source}
      WHERE content <> '' AND cluster_id <> -1 GROUP BY {keys}, content
    ),
    long_quotes AS (
      SELECT {keys}, quote, row_number() OVER (PARTITION BY {keys} ORDER BY length(quote) DESC, place) AS quote_rank
      FROM texts WHERE length(quote) > 10
    ),
    quotes AS (
      SELECT {keys}, quote_rank, quote FROM long_quotes WHERE quote_rank <= 3
      UNION ALL
      SELECT {keys}, 1, arg_min(quote, place) FROM texts
      GROUP BY {keys} HAVING max(length(quote)) <= 10
    )"""


def noise_sql(keys: str, source: str, count: int, chars: int) -> str:
    return f"""noise_quotes AS (
      SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY feed_pos) AS quote_rank,
             substring(content, 1, {chars}) AS quote
      FROM {source} WHERE cluster_id = -1
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY feed_pos) <= {count})"""


def action_sql(theme: str) -> str:
    cases = " ".join(
        f"WHEN {v.quoted(name)} THEN {v.quoted(text)}" for name, text in lex.THEME_ACTIONS.items()
    )
    return f"CASE {theme} {cases} END"


def report_sql(keys: str, source: str, lexicon: dict) -> str:
    return f"""{labels_sql(lexicon, keys, source)}, {quotes_sql(keys, source)}, {noise_sql(keys, source, 2, 100)},
    report AS (
      SELECT {keys},
        CASE WHEN cluster_id = -1 THEN 'Unclustered General Feedback' ELSE theme_name END AS theme_name,
        CASE WHEN cluster_id = -1 THEN 'Monitor for new emerging themes as feedback grows.'
             WHEN theme_name = 'General Feedback' THEN 'Gather more reviews for detailed analysis.'
             ELSE {action_sql('theme_name')} END AS action_idea,
        coalesce(list_quotes, []) AS representative_quotes, size
      FROM labelled LEFT JOIN (
        SELECT {keys}, list(quote ORDER BY quote_rank) AS list_quotes
        FROM (SELECT * FROM quotes UNION ALL BY NAME SELECT * FROM noise_quotes) GROUP BY {keys}
      ) USING ({keys}))"""


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return v.by_document(v.reviews(spark, sf))


@check(
    "cluster_sizes",
    f"WITH {DOC_CLUSTERS} SELECT cluster_id, count(*) AS size FROM assigned GROUP BY cluster_id",
)
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return themes.cluster_sizes(assigned(spark, sf))


@check(
    "whole_run",
    f"""WITH {v.REVIEWS} SELECT 1 AS cluster_id, 'General Feed Feedback' AS theme_name, count(*) AS size FROM reviews""",
)
def whole_run(spark: SparkSession, sf: str) -> DataFrame:
    pooled = themes.whole_run_as_cluster(v.reviews(spark, sf))
    return themes.cluster_sizes(pooled, ["cluster_id", "theme_name"])


@check(
    "theme_label",
    f"WITH {DOC_CLUSTERS}, {labels_sql(v.THEME_SYLLABLES, 'cluster_id', 'assigned')} SELECT * FROM labelled",
)
def theme_label(spark: SparkSession, sf: str) -> DataFrame:
    return themes.theme_labels(assigned(spark, sf), v.THEME_SYLLABLES)


@check(
    "theme_label_default",
    f"WITH {DOC_CLUSTERS}, {labels_sql(lex.THEME_TERMS, 'cluster_id', 'assigned')} SELECT * FROM labelled",
)
def theme_label_default(spark: SparkSession, sf: str) -> DataFrame:
    return themes.theme_labels(assigned(spark, sf))


@check(
    "representative_quotes",
    f"WITH {DOC_CLUSTERS}, {quotes_sql('cluster_id', 'assigned')} SELECT cluster_id, quote_rank::INT AS quote_rank, quote FROM quotes",
)
def representative_quotes(spark: SparkSession, sf: str) -> DataFrame:
    rows = assigned(spark, sf).where(F.col("cluster_id") != -1)
    return themes.quote_rows(rows, "feed_pos")


@check(
    "noise_samples",
    f"WITH {DOC_CLUSTERS}, {noise_sql('source', 'assigned', 3, 200)} SELECT source, quote_rank::INT AS quote_rank, quote FROM noise_quotes",
)
def noise_samples(spark: SparkSession, sf: str) -> DataFrame:
    noise = assigned(spark, sf).where(F.col("cluster_id") == -1)
    return themes.noise_samples(noise, "feed_pos", ["source"], 3, 200)


@check(
    "first_quotes",
    f"""WITH {v.REVIEWS} SELECT row_number() OVER (ORDER BY feed_pos)::INT AS quote_rank, content AS quote
    FROM reviews ORDER BY feed_pos LIMIT 3""",
)
def first_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return themes.noise_samples(v.reviews(spark, sf), "feed_pos", (), 3, None)


@check(
    "cluster_report",
    f"""WITH {DOC_CLUSTERS}, {report_sql('cluster_id', 'assigned', v.THEME_SYLLABLES)}
    SELECT cluster_id, theme_name, action_idea, size, array_to_string(representative_quotes, '|') AS quotes FROM report""",
)
def cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    report = themes.cluster_report(assigned(spark, sf), "feed_pos", lexicon=v.THEME_SYLLABLES)
    return report.withColumn("quotes", F.array_join("representative_quotes", "|")).drop(
        "representative_quotes"
    )


@check(
    "merge_themes",
    f"""WITH {v.THEME_ROWS},
    named AS (SELECT *, {v.normal_sql('theme_name')} AS norm_name FROM theme_rows),
    running AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY run_date, norm_name ORDER BY cluster_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM named)
    SELECT run_date::VARCHAR AS run_date, norm_name, min(cluster_id) AS cluster_id,
      arg_min(theme_name, cluster_id) AS theme_name,
      arg_max(action_idea, cluster_id) FILTER (size > before) AS action_idea,
      sum(size)::BIGINT AS size, count(*) AS merged_rows
    FROM running GROUP BY run_date, norm_name""",
)
def merge_themes(spark: SparkSession, sf: str) -> DataFrame:
    merged = themes.merge_themes(v.theme_rows(spark, sf))
    return merged.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "merge_quotes",
    f"""WITH {v.REVIEWS}, {quotes_sql('run_date, cluster_id', 'reviews')},
    named AS (SELECT *, {v.normal_sql(v.NAME_VARIANT_SQL)} AS norm_name FROM quotes)
    SELECT run_date::VARCHAR AS run_date, norm_name, quote,
      min(cluster_id) AS first_row, arg_min(quote_rank, ROW(cluster_id, quote_rank))::INT AS first_rank
    FROM named GROUP BY run_date, norm_name, quote""",
)
def merge_quotes(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["run_date", "cluster_id"]
    rows = v.reviews(spark, sf).where(F.col("cluster_id") != -1)
    quotes = themes.quote_rows(rows, "feed_pos", keys).withColumn(
        "theme_name", v.theme_name(F.col("cluster_id"))
    )
    merged = themes.merge_quotes(quotes)
    return merged.withColumn("run_date", F.col("run_date").cast("string"))


PROPOSED = """
proposed AS (
  SELECT cluster_id, quote_rank AS quote_no,
    CASE WHEN quote_rank = 1 AND cluster_id % 5 <> 0 THEN '"' || lower(substring(quote, 1, 20)) || '!"'
         ELSE 'nowhere ' || quote END AS quote
  FROM quotes WHERE quote_rank <= 2
)"""


@check(
    "quote_verification",
    rf"""WITH {DOC_CLUSTERS}, {quotes_sql('cluster_id', 'assigned')}, {PROPOSED},
    wanted AS (SELECT cluster_id, quote_no,
      regexp_replace(quote, '^["''\s.?!]+|["''\s.?!]+$', '', 'g') AS q FROM proposed),
    found AS (
      SELECT w.cluster_id, w.quote_no,
        arg_min({v.strip_sql('substring(content, instr(lower(content), lower(q)), length(q))')}, feed_pos) AS quote
      FROM wanted w JOIN assigned a USING (cluster_id)
      WHERE length(q) >= 5 AND instr(lower(content), lower(q)) > 0
      GROUP BY w.cluster_id, w.quote_no)
    SELECT cluster_id, quote_no::INT AS quote_no, quote FROM found
    UNION ALL
    SELECT cluster_id, 0, arg_min(content, feed_pos) FROM assigned
    WHERE content <> '' AND cluster_id IN (SELECT cluster_id FROM proposed)
      AND cluster_id NOT IN (SELECT cluster_id FROM found) GROUP BY cluster_id""",
)
def quote_verification(spark: SparkSession, sf: str) -> DataFrame:
    rows = assigned(spark, sf)
    best = themes.quote_rows(rows.where(F.col("cluster_id") != -1), "feed_pos")
    altered = F.when(
        (F.col("quote_rank") == 1) & (F.col("cluster_id") % 5 != 0),
        F.concat(F.lit('"'), F.lower(F.substring("quote", 1, 20)), F.lit('!"')),
    ).otherwise(F.concat(F.lit("nowhere "), "quote"))
    proposed = best.where(F.col("quote_rank") <= 2).select(
        "cluster_id", F.col("quote_rank").alias("quote_no"), altered.alias("quote")
    )
    return themes.verify_quotes(proposed, rows, "feed_pos")


DAY_REPORT = f"""{v.REVIEWS}, {report_sql('run_date, cluster_id', 'reviews', v.THEME_SYLLABLES)},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY cluster_id) AS theme_no FROM report WHERE cluster_id <> -1
  UNION ALL SELECT *, NULL FROM report WHERE cluster_id = -1
)"""


def day_report(spark: SparkSession, sf: str) -> DataFrame:
    return themes.cluster_report(
        v.reviews(spark, sf), "feed_pos", ["run_date", "cluster_id"], v.THEME_SYLLABLES
    )


@check(
    "theme_numbered",
    f"""WITH {DAY_REPORT} SELECT run_date::VARCHAR AS run_date, cluster_id, theme_no, theme_name, size
    FROM numbered WHERE theme_no IS NOT NULL""",
)
def theme_numbered(spark: SparkSession, sf: str) -> DataFrame:
    numbered = reports.theme_numbered(day_report(spark, sf)).where("theme_no IS NOT NULL")
    return numbered.select(
        F.col("run_date").cast("string").alias("run_date"),
        "cluster_id",
        "theme_no",
        "theme_name",
        "size",
    )


WEEK_SQL = "strftime(run_date, '%B %d, %Y')"


@check(
    "digest_text",
    f"""WITH {DAY_REPORT},
    sections AS (SELECT run_date, theme_no,
      CASE WHEN theme_no IS NOT NULL THEN
        '### Theme ' || theme_no || ': ' || upper(theme_name) || chr(10) ||
        '*   **Sample Size:** ' || size || ' reviews / complaints mentioned this week.' || chr(10) ||
        '*   **Suggested PM Action:** ' || action_idea || chr(10) ||
        '*   **Representative Verbatim Quotes:**' || chr(10)
      ELSE '### Unclustered Noise / General Feedback' || chr(10) ||
        '*   **Sample Size:** ' || size || ' reviews.' || chr(10) || '*   **Sample Feedback:**' || chr(10) END ||
      array_to_string(list_transform(representative_quotes, lambda q: '    > "' || q || '"' || chr(10)), '') AS body
      FROM numbered)
    SELECT run_date::VARCHAR AS run_date,
      '## Week of ' || {WEEK_SQL} || ' (UTC)' || chr(10) ||
      'Here is the Weekly Product Review Pulse outlining customer friction themes, verbatim quotes, and actionable product ideas.'
      || chr(10) || chr(10) || string_agg(body || chr(10), '' ORDER BY theme_no NULLS LAST) || '---' || chr(10) AS digest
    FROM sections GROUP BY run_date""",
)
def digest_text(spark: SparkSession, sf: str) -> DataFrame:
    week = F.date_format("run_date", "MMMM dd, yyyy")
    found = reports.digest_text(day_report(spark, sf), week)
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "message_text",
    f"""WITH {DAY_REPORT},
    sections AS (SELECT run_date, theme_no,
      '- **Theme #' || theme_no || ':** ' || upper(theme_name) || ' (' || size || ' mentions)' || chr(10) ||
      '  *PM Action Recommendation:* ' || action_idea || chr(10) AS body FROM numbered)
    SELECT run_date::VARCHAR AS run_date,
      'Hi Team,' || chr(10) || chr(10) || 'The Product Weekly Product Review Pulse for the week of ' || {WEEK_SQL}
      || ' has been published.' || chr(10) || chr(10) || chr(128279) || ' **Master Document Link:** https://example.org/digest'
      || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Summary of Emergent Themes:' || chr(10)
      || coalesce(string_agg(body, '' ORDER BY theme_no) FILTER (theme_no IS NOT NULL), chr(10))
      || chr(10) || 'Please check the document link above for full verbatim quotes and historical logs.'
      || chr(10) || chr(10) || 'Best,' || chr(10) || chr(10) || 'The review team' AS message
    FROM sections GROUP BY run_date""",
)
def message_text(spark: SparkSession, sf: str) -> DataFrame:
    week = F.date_format("run_date", "MMMM dd, yyyy")
    link = F.lit("https://example.org/digest")
    found = reports.message_text(day_report(spark, sf), week, link)
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "synthesis_fallback",
    f"""WITH {DOC_CLUSTERS}, {report_sql('cluster_id', 'assigned', v.THEME_SYLLABLES)}
    SELECT cluster_id,
      CASE WHEN cluster_id >= 0 AND cluster_id % 3 = 1 THEN 'Outside name ' || cluster_id ELSE theme_name END AS theme_name,
      CASE WHEN cluster_id >= 0 AND cluster_id % 3 = 2 THEN 'Do ' || cluster_id ELSE action_idea END AS action_idea, size
    FROM report""",
)
def synthesis_fallback(spark: SparkSession, sf: str) -> DataFrame:
    report = themes.cluster_report(assigned(spark, sf), "feed_pos", lexicon=v.THEME_SYLLABLES)
    cluster = F.col("cluster_id")
    proposed = assigned(spark, sf).select("cluster_id").distinct().select(
        cluster,
        F.when(cluster % 3 != 0, F.when(cluster % 3 == 1, F.concat(F.lit(" Outside name "), cluster)).otherwise(" ")).alias("theme_name"),
        F.when(cluster % 3 == 2, F.concat(F.lit("Do "), cluster)).alias("action_idea"),
    )
    return themes.apply_synthesis(report, proposed).drop("representative_quotes")


@check(
    "delivery_log",
    f"""WITH {DAY_REPORT} SELECT DISTINCT run_date::VARCHAR AS run_date, 1::BIGINT AS digests, 1::BIGINT AS messages,
      'Pulse' AS subject FROM numbered""",
)
def delivery_log(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark)
    report = cut_lineage(day_report(spark, sf).withColumn("run_date", F.col("run_date").cast("string")))
    link, to, subject = F.lit("https://example.org/digest"), F.lit("team@example.org"), F.lit("Pulse")
    # Delivered twice, as after a retry; an empty report changes nothing.
    for rows in (report, report, report.limit(0)):
        deliver(rows, folder, F.lit("week"), link, to, subject, v.now())
    log = lambda name: spark.read.option("recursiveFileLookup", "false").schema(
        "subject string, run_date string"
    ).parquet(f"{folder}/{name}")
    digests = log("digests").groupBy("run_date").agg(F.count("*").alias("digests"))
    messages = log("outbox").groupBy("run_date", "subject").agg(F.count("*").alias("messages"))
    return digests.join(messages, "run_date")
