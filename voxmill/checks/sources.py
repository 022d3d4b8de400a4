"""Checks of payload normalisers, batches, run files and the experiment log."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.checks import view as v
from voxmill.checks.registry import SQL, check
from voxmill.operators import day_shares, experiments, views
from voxmill.session import work_dir
from voxmill.sources import feeds, files, runs


def feed_pages(documents: DataFrame) -> DataFrame:
    """One feed page per document: its sentences as entries in ``{"label": ...}`` form.

    The first entry describes the app, some ratings are no numbers, some ids are
    empty, and a page of one entry holds an object instead of an array.
    """
    doc = F.col("doc_id")

    def label(value):
        return F.struct(value.cast("string").alias("label"))

    def entry(text, i):
        rating = F.when(i % 13 == 5, F.lit("none")).otherwise(((doc + i) % 5 + 1).cast("string"))
        return F.struct(
            label(F.when(i % 17 == 3, F.lit("")).otherwise(F.concat_ws("-", doc, i))).alias("id"),
            F.when(i % 4 != 0, F.struct(label(F.concat(F.lit("user"), doc)).alias("name"))).alias(
                "author"
            ),
            label(F.concat(F.lit("t"), i)).alias("title"),
            label(text).alias("content"),
            F.when(i > 0, label(rating)).alias("im:rating"),
            label(F.lit("8.1")).alias("im:version"),
            label(F.when(i % 5 == 2, F.lit("")).otherwise(F.lit("2024-01-05T10:00:00-07:00"))).alias(
                "updated"
            ),
        )

    entries = F.transform(F.split("text", r"[.\n]+"), entry)
    page = F.when(
        F.size(entries) == 1, F.to_json(F.struct(F.struct(F.get(entries, 0).alias("entry")).alias("feed")))
    ).otherwise(F.to_json(F.struct(F.struct(entries.alias("entry")).alias("feed"))))
    return documents.select(doc.alias("page_pos"), page.alias("payload"))


@check(
    "flatten_feed",
    f"""WITH {v.REVIEWS}, raw AS (SELECT doc_id, pos, raw FROM sentences)
    SELECT doc_id || '-' || pos AS review_id, 'app_store' AS source,
      CASE WHEN pos % 4 <> 0 THEN 'user' || doc_id ELSE 'Anonymous' END AS author,
      't' || pos AS title, raw AS content, ((doc_id + pos) % 5 + 1)::INT AS rating,
      CASE WHEN pos % 5 = 2 THEN '2024-01-31T00:00:00Z' ELSE '2024-01-05T10:00:00-07:00' END AS date,
      '8.1' AS app_version, doc_id * 1000000 + pos AS feed_pos
    FROM raw WHERE pos > 0 AND pos % 13 <> 5 AND pos % 17 <> 3""",
)
def flatten_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.label_feed_reviews(feed_pages(v.texts(spark, sf)), v.now())


def posts(documents: DataFrame) -> DataFrame:
    """One post per document: every second has a blank body; the first sentence is the title."""
    doc = F.col("doc_id")
    return documents.select(
        F.concat(F.lit("p"), doc).alias("id"),
        F.when(doc % 2 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("selftext"),
        F.get(F.split("text", r"[.\n]+"), 0).alias("title"),
        F.when(doc % 3 != 0, F.concat(F.lit("user"), doc)).alias("author"),
        F.when(doc % 5 != 0, (F.lit(v.EPOCH) + doc * 60).cast("double")).alias("created_utc"),
        doc.alias("feed_pos"),
    )


POSTS = f"""post AS (
  SELECT doc_id, text, {v.strip_sql("string_split_regex(text, '[.\\n]+')[1]")} AS title FROM documents
),
posts AS (
  SELECT 'reddit_p' || doc_id AS review_id,
         CASE WHEN doc_id % 2 = 1 AND {v.strip_sql('text')} <> '' THEN {v.strip_sql('text')} ELSE title END AS content,
         title, CASE WHEN doc_id % 3 <> 0 THEN 'user' || doc_id ELSE 'Anonymous' END AS author,
         CASE WHEN doc_id % 5 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ')
              ELSE '2024-01-31T00:00:00Z' END AS date
  FROM post
  WHERE (doc_id % 2 = 1 AND {v.strip_sql('text')} <> '') OR length(title) > 30
)"""


@check(
    "title_fallback",
    f"WITH {POSTS} SELECT review_id, author, title, content, 3 AS rating, date FROM posts",
)
def title_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.forum_posts(posts(v.texts(spark, sf)), v.now())
    return rows.select("review_id", "author", "title", "content", "rating", "date")


@check(
    "union_sources",
    f"""WITH {v.REVIEWS}, {POSTS}
    SELECT review_id, source, author, content, rating, date, app_version FROM (
      SELECT review_id, source, author, content, rating, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, '' AS app_version
      FROM reviews WHERE source = 'app_store'
      UNION ALL
      SELECT review_id, source, CASE WHEN pos % 4 = 0 THEN 'Anonymous' ELSE author END, content, rating,
             strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), CASE WHEN pos % 2 = 0 THEN '' ELSE '8.0' END
      FROM reviews WHERE source = 'play_store' AND content <> ''
      UNION ALL SELECT review_id, 'reddit', author, content, 3, date, '' FROM posts)""",
)
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.reviews(spark, sf)
    app = rows.where(F.col("source") == "app_store").withColumn("app_version", F.lit(""))
    store_rows = rows.where(F.col("source") == "play_store").select(
        F.col("review_id").alias("reviewId"),
        F.when(F.col("pos") % 4 != 0, F.col("author")).alias("userName"),
        F.nullif("content", F.lit("")).alias("content"),
        F.col("rating").alias("score"),
        F.col("ts").alias("at"),
        F.when(F.col("pos") % 2 != 0, "8.0").alias("reviewCreatedVersion"),
        "feed_pos",
    )
    forum = feeds.forum_posts(posts(v.texts(spark, sf)), v.now())
    columns = ["review_id", "source", "author", "content", "rating", "date", "app_version"]
    return feeds.union_sources(
        app.select(*columns), feeds.store_reviews(store_rows, v.now()), forum
    ).select(*columns)


@check(
    "latest_batch",
    """SELECT event_id, user_id, event_type FROM events
    WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)""",
)
def latest_batch(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("run_ts")
    batches = v.table(spark, sf, "events").select("event_id", "user_id", "event_type", day)
    return files.latest_batch(batches).drop("run_ts")


def run_files(events: DataFrame) -> DataFrame:
    """File names as the runs of each hour would leave them; one row per event."""
    at = F.col("ts").cast("timestamp")
    hour = F.hour(at)
    prefix = (
        F.when(hour % 5 == 4, "cleaned_reviews_")
        .when(hour % 2 == 0, "realtime_clusters_")
        .otherwise("cluster_results_")
    )
    stamp = F.when(hour == 3, F.date_format(at, "yyyyMMdd")).otherwise(
        F.date_format(at, "yyyyMMdd_HH'0000'")
    )
    suffix = F.when(hour % 7 == 6, ".tmp").otherwise(".json")
    return events.select("event_id", "user_id", F.concat(prefix, stamp, suffix).alias("filename"))


RUN_FILES = """
run_files AS (
  SELECT user_id, ts, hour(ts) AS h,
    CASE WHEN hour(ts) % 5 = 4 THEN 'cleaned_reviews_' WHEN hour(ts) % 2 = 0 THEN 'realtime_clusters_'
         ELSE 'cluster_results_' END AS prefix,
    CASE WHEN hour(ts) = 3 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y%m%d_%H0000') END AS stamp,
    CASE WHEN hour(ts) % 7 = 6 THEN '.tmp' ELSE '.json' END AS suffix
  FROM events
),
catalog AS (
  SELECT DISTINCT prefix || stamp || suffix AS filename,
    CASE prefix WHEN 'realtime_clusters_' THEN 'Real-Time Clusters' ELSE 'Static Clusters' END AS type,
    stamp AS "timestamp",
    CASE WHEN h = 3 THEN stamp ELSE strftime(date_trunc('hour', ts), '%b %d, %Y %I:%M %p') END AS pretty_time,
    CASE WHEN h <> 3 THEN date_trunc('hour', ts) END AS run_at
  FROM run_files WHERE prefix <> 'cleaned_reviews_' AND suffix = '.json'
)"""


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    names = run_files(v.table(spark, sf, "events")).select("filename").distinct()
    return files.run_catalog(names)


@check(
    "run_catalog",
    f'WITH {RUN_FILES} SELECT filename, type, "timestamp", pretty_time FROM catalog',
)
def run_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("filename", "type", "timestamp", "pretty_time")


@check(
    "valid_runs",
    f"""WITH {RUN_FILES} SELECT filename, type FROM catalog WHERE filename IN
    (SELECT prefix || stamp || suffix FROM run_files WHERE user_id % 10 = 0)""",
)
def valid_runs(spark: SparkSession, sf: str) -> DataFrame:
    themes = run_files(v.table(spark, sf, "events")).where(F.col("user_id") % 10 == 0)
    return files.valid_runs(_catalog(spark, sf), themes).select("filename", "type")


@check(
    "run_freshness",
    f"""WITH {RUN_FILES} SELECT strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS newest,
    coalesce(TIMESTAMP '{v.AS_OF}' - max(run_at) < INTERVAL 24 HOUR, FALSE) AS is_fresh FROM catalog""",
)
def run_freshness(spark: SparkSession, sf: str) -> DataFrame:
    found = files.run_freshness(_catalog(spark, sf), v.now())
    return found.withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


DRAFT_SQL = """
draft AS (
  SELECT theme_name, 'A/B Test: ' || theme_name AS title,
    'If we address the ''' || theme_name || ''' complaint by implementing: ' || action_idea ||
    ', then we will increase active music discovery session metric Lifts.' AS hypothesis,
    '+10% engagement lift' AS metric
  FROM theme_rows WHERE cluster_id <> -1 AND run_date = (SELECT max(run_date) FROM theme_rows)
)"""


@check("experiment_draft", f"WITH {v.THEME_ROWS}, {DRAFT_SQL} SELECT * FROM draft")
def experiment_draft(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.experiment_draft(v.theme_rows(spark, sf))


@check(
    "experiment_cards",
    f"""WITH {v.THEME_ROWS}, {DRAFT_SQL}
    SELECT theme_name, title, hypothesis, 'All Users' AS cohort, metric,
      'card_' || sha256(concat_ws(chr(31), theme_name, title, hypothesis, 'All Users', metric, '2024-01-31 00:00:00 UTC')) AS id,
      '2024-01-31 00:00:00 UTC' AS created_at FROM draft""",
)
def experiment_cards(spark: SparkSession, sf: str) -> DataFrame:
    drafts = experiments.experiment_draft(v.theme_rows(spark, sf))
    return experiments.experiment_cards(drafts, F.lit("All Users"), v.now())


SHARE_SQL = f"""
recent AS (SELECT *, {v.normal_sql('theme_name')} AS norm_name FROM event_themes
           WHERE run_date >= DATE '2024-01-31' - INTERVAL 30 DAY),
days AS (SELECT run_date, sum(size) AS day_size FROM recent GROUP BY run_date),
daily AS (
  SELECT run_date, norm_name, sum(size) AS size,
    arg_max(theme_name, ROW(size, -cluster_id, theme_name)) AS theme_name, max(size) AS top_size
  FROM recent WHERE cluster_id <> -1 GROUP BY run_date, norm_name
),
series AS (SELECT norm_name, arg_max(theme_name, ROW(top_size, run_date)) AS series_name FROM daily GROUP BY norm_name),
share AS (
  SELECT days.run_date, norm_name, coalesce(theme_name, series_name) AS theme_name,
    coalesce(size, 0)::BIGINT AS size,
    round(100.0::DOUBLE * coalesce(size, 0)::DOUBLE / day_size::DOUBLE, 1) AS share_pct
  FROM series CROSS JOIN days LEFT JOIN daily USING (run_date, norm_name)
)"""


@check(
    "theme_daily_share",
    f"WITH {v.EVENT_THEMES}, {SHARE_SQL} SELECT run_date::VARCHAR AS run_date, norm_name, theme_name, size, share_pct FROM share",
)
def theme_daily_share(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.to_date(v.now())
    share = views.theme_daily_share(v.event_themes(spark, sf), as_of)
    return share.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "experiment_effect",
    f"""WITH {v.EVENT_THEMES}, {SHARE_SQL},
    cards AS (SELECT DISTINCT theme_name, 'c-' || theme_name AS id, {v.normal_sql('theme_name')} AS norm_name FROM event_themes)
    SELECT id, cards.theme_name,
      round(avg(share_pct) FILTER (run_date < DATE '2024-01-15'), 6) AS share_before,
      round(avg(share_pct) FILTER (run_date >= DATE '2024-01-15'), 6) AS share_after,
      round(avg(share_pct) FILTER (run_date >= DATE '2024-01-15') - avg(share_pct) FILTER (run_date < DATE '2024-01-15'), 6) AS change
    FROM cards LEFT JOIN share USING (norm_name) GROUP BY ALL""",
)
def experiment_effect(spark: SparkSession, sf: str) -> DataFrame:
    themes = v.event_themes(spark, sf)
    cards = themes.select(
        "theme_name",
        F.concat(F.lit("c-"), "theme_name").alias("id"),
        F.lit("2024-01-15 00:00:00 UTC").alias("created_at"),
    ).distinct()
    return experiments.experiment_effect(
        cards, views.theme_daily_share(themes, F.to_date(v.now()))
    )


PAIR_SQL = """
pcts AS (SELECT *, 100.0::DOUBLE * size::DOUBLE / day_size::DOUBLE AS pct FROM daily JOIN days USING (run_date))"""


def _spikes_sql(ratio: float) -> str:
    return f"""WITH {v.EVENT_THEMES}, {SHARE_SQL}, {PAIR_SQL},
    top2 AS (SELECT run_date, row_number() OVER (ORDER BY run_date DESC) AS n FROM days)
    SELECT a.norm_name, a.theme_name, round(a.pct, 1) AS latest_pct, round(b.pct, 1) AS previous_pct
    FROM pcts a JOIN pcts b USING (norm_name)
    WHERE a.run_date = (SELECT run_date FROM top2 WHERE n = 1) AND b.run_date = (SELECT run_date FROM top2 WHERE n = 2)
      AND b.pct > 0 AND a.pct >= b.pct * {ratio} AND a.pct > 5"""


@check("spike_alerts", _spikes_sql(1.5))
def spike_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return views.spike_alerts(v.event_themes(spark, sf), F.to_date(v.now()))


@check("spike_alerts_sensitive", _spikes_sql(1.02))
def spike_alerts_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    return views.spike_alerts(v.event_themes(spark, sf), F.to_date(v.now()), ratio=1.02)


@check(
    "spike_history",
    f"""WITH {v.EVENT_THEMES}, {SHARE_SQL}, {PAIR_SQL},
    ranked AS (SELECT run_date, lag(run_date) OVER (ORDER BY run_date) AS before FROM days)
    SELECT a.run_date::VARCHAR AS run_date, a.norm_name, a.theme_name, round(a.pct, 1) AS latest_pct, round(b.pct, 1) AS previous_pct
    FROM pcts a JOIN ranked r ON a.run_date = r.run_date
    JOIN pcts b ON b.run_date = r.before AND b.norm_name = a.norm_name
    WHERE b.pct > 0 AND a.pct >= b.pct * 1.05 AND a.pct > 5""",
)
def spike_history(spark: SparkSession, sf: str) -> DataFrame:
    found = views.spike_history(v.event_themes(spark, sf), F.to_date(v.now()), ratio=1.05)
    return found.withColumn("run_date", F.col("run_date").cast("string"))


def nested_runs(documents: DataFrame) -> DataFrame:
    """A nested theme row per document, as run files hold them; every fifth has only a stored size."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 28).cast("int"))
    name = F.concat(F.lit("cluster_results_"), F.date_format(day, "yyyyMMdd"), F.lit("_120000.json"))
    reviews = F.transform(
        F.split("text", r"[.\n]+"),
        lambda text, i: F.struct(F.concat_ws("-", doc, i).alias("review_id"), text.alias("content")),
    )
    return documents.select(
        name.alias("filename"),
        doc.cast("int").alias("cluster_id"),
        F.concat(F.lit("theme "), doc % 9).alias("theme_name"),
        F.lit("act").alias("action_idea"),
        (doc % 50).alias("size"),
        F.when(doc % 5 != 0, reviews).alias("reviews"),
    )


_RUN_SQL = f"""{v.REVIEWS}, named AS (
  SELECT *, 'cluster_results_' || strftime(DATE '2024-01-01' + (doc_id % 28)::INT, '%Y%m%d') || '_120000.json' AS filename,
    (DATE '2024-01-01' + (doc_id % 28)::INT)::VARCHAR AS run_day, 'theme ' || (doc_id % 9) AS theme FROM sentences)"""


@check(
    "run_members",
    f"""WITH {_RUN_SQL} SELECT filename, run_day AS run_date, doc_id::INT AS cluster_id, theme AS theme_name,
      doc_id || '-' || pos AS review_id, raw AS content FROM named WHERE doc_id % 5 <> 0""",
)
def run_members(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.members_of_runs(nested_runs(v.texts(spark, sf)))
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "run_theme_rows",
    f"""WITH {_RUN_SQL} SELECT filename, run_day AS run_date, doc_id::INT AS cluster_id, theme AS theme_name,
      'act' AS action_idea, CASE WHEN max(doc_id) % 5 = 0 THEN max(doc_id) % 50 ELSE count(*) END::BIGINT AS size
    FROM named GROUP BY filename, run_day, doc_id, theme""",
)
def run_theme_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.theme_rows_of_runs(nested_runs(v.texts(spark, sf))).drop("position")
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "run_commit",
    """SELECT '20240131_120000' AS run_ts, '2024-01-31' AS run_date, 'Static Clusters' AS run_type, event_type AS theme_name,
      count(*) AS size, count(*) AS members FROM events GROUP BY event_type""",
)
def run_commit(spark: SparkSession, sf: str) -> DataFrame:
    """A run is published; another version breaks off between the tables, and so does a new run: the first one stays."""
    folder = work_dir(spark)
    members = v.table(spark, sf, "events").select("event_id", F.col("event_type").alias("theme_name"))
    report = members.groupBy("theme_name").agg(F.count("*").alias("size"))
    runs.publish_run(members, report, folder, "20240131_120000", "Static Clusters")
    broken = members.withColumn("theme_name", F.raise_error(F.lit("the job broke off")).cast("string"))
    for run_ts in ("20240131_120000", "20240201_120000"):
        try:
            runs.publish_run(broken, report.limit(1), folder, run_ts, "Static Clusters")
        except PySparkException as error:
            if "the job broke off" not in str(error):
                raise
    read = lambda name, rows: runs.published(spark, folder, name, rows.schema)
    counted = read("assignments", members).groupBy("run_ts", "theme_name").agg(F.count("*").alias("members"))
    found = read("themes", report).join(counted, ["run_ts", "theme_name"])
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check(
    "card_log",
    """SELECT 'card_' || p_partkey AS id, p_name AS title FROM part""",
)
def card_log(spark: SparkSession, sf: str) -> DataFrame:
    """Cards in three batches that overlap, the second one written twice, as after a retry."""
    folder = work_dir(spark)
    part = F.col("p_partkey")
    cards = v.table(spark, sf, "part").select(part, F.concat(F.lit("card_"), part).alias("id"), F.col("p_name").alias("title"))
    batches = {"1": part % 3 == 0, "2": part % 3 != 2, "3": part % 2 == 0, "4": part >= 0}
    for batch in ("1", "2", "2", "3", "4"):
        files.append_once(cards.where(batches[batch]).drop("p_partkey"), folder, batch)
    return files.read_or_empty(spark, folder, T.StructType.fromDDL("id string, title string"), "parquet")


def _kept_days(spark: SparkSession, sf: str) -> str:
    """Two runs a day, added in three batches and the last one again, as after a retry."""
    folder = work_dir(spark)
    rows = v.event_themes(spark, sf).withColumn("run_ts", F.concat(F.lit("run "), F.col("cluster_id") % 2))
    late = (F.col("run_ts") != "run 0") & (F.dayofmonth("run_date") > 15)
    batches = (F.col("run_ts") == "run 0", (F.col("run_ts") != "run 0") & ~late, late, late)
    for batch in batches:
        day_shares.add_runs(rows.where(batch), folder)
    return folder


@check(
    "theme_daily_share_kept",
    f"WITH {v.EVENT_THEMES}, {SHARE_SQL} SELECT run_date::VARCHAR AS run_date, norm_name, theme_name, size, share_pct FROM share",
)
def theme_daily_share_kept(spark: SparkSession, sf: str) -> DataFrame:
    found = day_shares.shares(spark, _kept_days(spark, sf), F.to_date(v.now()))
    return found.withColumn("run_date", F.col("run_date").cast("string"))


@check("spike_history_kept", SQL["spike_history"])
def spike_history_kept(spark: SparkSession, sf: str) -> DataFrame:
    found = day_shares.spikes(spark, _kept_days(spark, sf), F.to_date(v.now()), ratio=1.05)
    return found.withColumn("run_date", F.col("run_date").cast("string"))
