"""Payload rules, files and logs, on small hand-made inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from voxmill import schemas
from voxmill.operators import experiments, selection
from voxmill.sources import feeds, files, runs

def now():
    return F.to_timestamp(F.lit("2026-06-30 12:00:00"))


def label(value):
    return {"label": value}


def entry(key, rating="4", **more):
    made = {
        "id": label(key),
        "author": {"name": label("Ann")},
        "title": label("Title"),
        "content": label("Text of it"),
        "im:rating": label(rating),
        "im:version": label("9.0"),
        "updated": label("2026-06-29T10:00:00-07:00"),
    }
    made.update(more)
    return {k: v for k, v in made.items() if v is not None}


def pages(spark, *documents):
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "page_pos long, payload string")


def test_label_feed(spark):
    first = {"feed": {"entry": [
        entry("app", **{"im:rating": None}),
        entry("1"),
        entry(""),
        entry("2", "five"),
        entry("3", author=None, title=None, content=None, updated=None, **{"im:version": None}),
    ]}}
    single = {"feed": {"entry": entry("4", "1")}}
    found = feeds.label_feed_reviews(pages(spark, first, single, {"feed": {}}, {}), now())
    rows = [r.asDict() for r in found.orderBy("feed_pos").collect()]
    assert [r["review_id"] for r in rows] == ["1", "3", "4"]
    assert [r["rating"] for r in rows] == [4, 4, 1]
    assert rows[0]["date"] == "2026-06-29T10:00:00-07:00"
    bare = rows[1]
    assert (bare["author"], bare["title"], bare["content"], bare["app_version"]) == ("Anonymous", "", "", "")
    assert bare["date"] == "2026-06-30T12:00:00Z"


def test_store_rows(spark):
    rows = [
        ("a", "Bo", "Fine", 5, "2026-06-29 08:00:00", "1.2", 0),
        ("b", None, "Also fine", None, "2026-06-29 08:00:00.25", None, 1),
        ("c", "Cy", "   ", 3, None, None, 2),
        ("", "Di", "No id", 3, None, None, 3),
        ("d", "Ed", None, 3, None, None, 4),
        ("e", "Fi", "Undated", 2, None, None, 5),
    ]
    names = "reviewId string, userName string, content string, score int, at string, reviewCreatedVersion string, feed_pos long"
    table = spark.createDataFrame(rows, names).withColumn("at", F.col("at").cast("timestamp"))
    found = feeds.store_reviews(table, now()).orderBy("feed_pos").collect()
    assert [r.review_id for r in found] == ["a", "b", "e"]
    assert [r.date for r in found] == [
        "2026-06-29T08:00:00Z", "2026-06-29T08:00:00.250000Z", "2026-06-30T12:00:00Z",
    ]
    assert [r.rating for r in found] == [5, 0, 2]
    assert found[1].author == "Anonymous" and found[1].app_version == ""


def test_forum_listing(spark):
    posts = [
        {"id": "p1", "selftext": " Body ", "title": "T", "author": "Al", "created_utc": 1782000000},
        {"id": "p2", "selftext": "", "title": "A title that is longer than thirty", "created_utc": 0},
        {"id": "p3", "selftext": " ", "title": "Exactly thirty characters here"},
        {"id": "", "selftext": "No id"},
    ]
    listing = {"data": {"children": [{"data": p} for p in posts]}}
    found = feeds.forum_listing_reviews(pages(spark, listing), now()).orderBy("feed_pos").collect()
    assert [(r.review_id, r.content, r.rating) for r in found] == [
        ("reddit_p1", "Body", 3),
        ("reddit_p2", "A title that is longer than thirty", 3),
    ]
    assert found[0].date == "2026-06-21T00:00:00Z"
    assert found[1].author == "Anonymous"


def test_first_seen_keeps_the_earliest_good_row(spark):
    rows = [("s", "1", "late", 3), ("s", "1", "early", 1), ("s", "2", "only", 2), ("t", "1", "other", 0)]
    table = spark.createDataFrame(rows, "source string, review_id string, content string, feed_pos long")
    found = selection.first_seen(table, ["source", "review_id"], "feed_pos")
    assert {r.content for r in found.collect()} == {"early", "only", "other"}
    assert found.columns == table.columns


def test_union_of_what_could_be_read(spark):
    one = spark.createDataFrame([("a", 1)], "review_id string, feed_pos long")
    two = spark.createDataFrame([("b", "us", 2)], "review_id string, region string, feed_pos long")
    assert feeds.union_sources(None, one, two).count() == 2


def test_batches_runs_and_catalog(spark, tmp_path):
    review = {"review_id": "1", "source": "reddit", "content": None, "rating": 3, "date": ""}
    for stamp, rows in [("20260101_100000", [review]), ("20260102_090000", [review, review])]:
        (tmp_path / f"cleaned_reviews_{stamp}.json").write_text(json.dumps(rows, indent=2))
    batches = files.read_reviews(spark, str(tmp_path / "cleaned_reviews_*.json"), "json")
    newest = files.latest_batch(batches)
    assert newest.count() == 2
    assert {r.run_ts for r in newest.collect()} == {"20260102_090000"}

    runs = tmp_path / "runs"
    runs.mkdir()
    theme = {"cluster_id": 0, "theme_name": "T", "size": 1, "reviews": [review]}
    (runs / "cluster_results_20260102_130500.json").write_text(json.dumps([theme], indent=1))
    (runs / "realtime_clusters_20260103_000000.json").write_text(json.dumps([theme, theme]))
    (runs / "realtime_clusters_20260104_000000.json").write_text("[]")
    (runs / "cluster_results_broken.json").write_text("{not json")
    (runs / "notes.json").write_text("[]")
    catalog = files.run_catalog(files.list_files(spark, str(runs)))
    rows = catalog.collect()
    assert [r.filename for r in rows][-1] == "cluster_results_20260102_130500.json"
    assert rows[-1].pretty_time == "Jan 02, 2026 01:05 PM"
    assert rows[0].pretty_time == "broken" and rows[0].run_at is None
    theme_rows = files.read_runs(spark, str(runs))
    valid = files.valid_runs(catalog, theme_rows)
    assert {r.filename for r in valid.collect()} == {
        "cluster_results_20260102_130500.json", "realtime_clusters_20260103_000000.json",
    }
    fresh = files.run_freshness(valid, F.to_timestamp(F.lit("2026-01-03 20:00:00"))).first()
    assert fresh.is_fresh
    stale = files.run_freshness(valid, F.to_timestamp(F.lit("2026-01-05 00:00:00"))).first()
    assert not stale.is_fresh


def test_missing_paths_are_empty(spark, tmp_path):
    assert files.read_cards(spark, str(tmp_path / "none.json")).count() == 0
    assert files.read_runs(spark, str(tmp_path / "none")).columns[-1] == "filename"
    assert files.read_reviews(spark, str(tmp_path / "no")).columns[-1] == "run_ts"


def test_cards_append_and_read_back(spark, tmp_path):
    drafts = spark.createDataFrame(
        [("T", "A/B Test: T", "H", "m"), ("U", "A/B Test: U", "", "m")],
        "theme_name string, title string, hypothesis string, metric string",
    )
    cards = experiments.experiment_cards(drafts, F.lit("All Users"), now())
    path = str(tmp_path / "cards")
    files.append(cards, path)
    files.append(cards, path)
    found = files.read_cards(spark, path, "parquet").collect()
    assert len(found) == 2 and len({r.id for r in found}) == 1
    assert found[0].created_at == "2026-06-30 12:00:00 UTC"


def test_reviews_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([], schemas.CLEAN_REVIEW).unionByName(
        spark.range(3).select(
            F.col("id").cast("string").alias("review_id"), F.lit("reddit").alias("source")
        ),
        allowMissingColumns=True,
    )
    path = str(tmp_path / "reviews")
    dated = rows.withColumn("run_date", F.lit("2026-01-01").cast("date"))
    files.write_reviews(dated, path)
    back = spark.read.parquet(path).where(F.col("run_date") == "2026-01-01")
    assert back.count() == 3
    files.export_report(back.select("review_id"), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == 3


def test_a_run_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    members = spark.createDataFrame([(1, "a"), (2, "b")], "id long, theme_name string")
    report = members.groupBy("theme_name").count()
    assert runs.manifest(spark, path).collect() == []
    runs.publish_run(members, report, path, "20240101_080000", "Static Clusters")
    with pytest.raises(Exception, match="no"):
        runs.publish_run(members.selectExpr("id", "raise_error('no') AS theme_name"), report.limit(0), path, "20240101_080000", "x")
    with pytest.raises(Exception, match="no"):
        runs.publish_run(members.selectExpr("id", "raise_error('no') AS theme_name"), report, path, "20240102_080000", "x")
    read = lambda: sorted((r.run_ts, r.id, r.theme_name) for r in runs.published(spark, path, "assignments", members.schema).collect())
    assert read() == [("20240101_080000", 1, "a"), ("20240101_080000", 2, "b")]
    assert runs.published(spark, path, "themes", report.schema).count() == 2
    (line,) = runs.manifest(spark, path).collect()
    assert (line.run_ts, line.run_type, str(line.run_date)) == ("20240101_080000", "Static Clusters", "2024-01-01")
    # Published again: the new version counts, and only that is left.
    runs.publish_run(members.where("id = 1"), report, path, "20240101_080000", "Static Clusters")
    assert read() == [("20240101_080000", 1, "a")]
    assert len(list((tmp_path / "themes" / "run_ts=20240101_080000").glob("version=*"))) == 1


def test_a_batch_of_cards_is_added_once(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id string, title string")
    for name, rows in (("a", batch("1", "2", "2")), ("b", batch("2", "3")), ("b", batch("2", "3")), ("c", batch())):
        files.append_once(rows, path, name)
    found = spark.read.schema("id string, title string, batch_id string").parquet(path).collect()
    assert sorted((r.id, r.batch_id) for r in found) == [("1", "a"), ("2", "a"), ("3", "b")]
