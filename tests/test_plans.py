"""Whole jobs on small hand-made input."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from voxmill.operators import reports, views
from voxmill.plans.analytics import analyse
from voxmill.plans.ingest import ingest

TEXTS = [
    "Shuffle plays the same song in a loop",
    "The same song again, shuffle is a loop",
    "Stuck in a loop, shuffle repeats the same song",
    "Too many ads between tracks for free users",
    "So many ads, free users hear ads all day",
    "Free users get too many ads",
    "Cannot download music for offline flights",
    "Offline download of music fails",
]


def test_analyse_finds_topics_with_verbatim_quotes(spark):
    rows = [(str(i), "reddit", t, 3) for i, t in enumerate(TEXTS)] + [("x", "reddit", " ok ", 5)]
    reviews = spark.createDataFrame(rows, "review_id string, source string, content string, rating int")
    found = analyse(reviews)
    report = found.report.collect()
    themes = [r for r in report if r.cluster_id != -1]
    assert len(themes) >= 2
    assert sum(r["size"] for r in report) == len(TEXTS)  # the short text is left out
    for r in themes:
        assert len(r.theme_name.split()) <= 7
        assert len(r.action_idea.split()) <= 25
        assert r.representative_quotes and set(r.representative_quotes) <= set(TEXTS)
    assert found.members.count() == len(TEXTS)
    assert views.theme_polarity(found.members).agg(F.sum("neutral")).first()[0] == len(TEXTS)


def test_ingest_to_summary(spark, tmp_path):
    def entry(key, content, updated):
        return {
            "id": {"label": key}, "content": {"label": content}, "title": {"label": "t"},
            "im:rating": {"label": "2"}, "updated": {"label": updated},
        }

    feed = {"feed": {"entry": [
        entry("1", "Too slow", "2026-06-20T10:00:00Z"),
        entry("1", "Seen before", "2026-06-20T10:00:00Z"),
        entry("2", "Too old", "2026-06-18T10:00:00Z"),
        entry("3", "Has an emoji \U0001f600", "2026-06-20T10:00:00Z"),
        entry("4", "No date but kept", "whenever"),
    ]}}
    pages = spark.createDataFrame([(0, json.dumps(feed))], "page_pos long, payload string")
    posts = {"data": {"children": [{"data": {"id": "p", "selftext": "I pay for this", "created_utc": 1782777600}}]}}
    listing = spark.createDataFrame([(0, json.dumps(posts))], "page_pos long, payload string")
    now = F.to_timestamp(F.lit("2026-06-30 12:00:00"))
    job = ingest(now, label_pages=pages, forum_pages=listing, limit=50)
    assert sorted(r.review_id for r in job.clean.collect()) == ["1", "4", "reddit_p"]
    summary = {r.source: (r.raw_count, r.clean_count) for r in job.summary().collect()}
    assert summary == {"app_store": (4, 2), "play_store": (0, 0), "reddit": (1, 1)}
    segments = {r.segment: r.reviews for r in job.segments().collect()}
    assert segments == {"Performance/Stability Issue": 1, "General Feedback": 1, "Premium User": 1}
    job.write(str(tmp_path / "raw"), str(tmp_path / "clean"), "20260630_120000")
    assert spark.read.parquet(str(tmp_path / "clean")).where("run_ts = '20260630_120000'").count() == 3


def test_empty_run_gives_no_document(spark):
    report = spark.createDataFrame(
        [], "run_date string, cluster_id int, theme_name string, action_idea string, size long, representative_quotes array<string>"
    )
    assert reports.digest_text(report, F.lit("June 1, 2026")).count() == 0


def test_message_record(spark):
    report = spark.createDataFrame(
        [("d", 0, "Slow app", "Fix it", 3, ["so slow"]), ("d", -1, "n", "m", 1, ["x"])],
        "run_date string, cluster_id int, theme_name string, action_idea string, size long, representative_quotes array<string>",
    )
    message = reports.message_text(report, F.lit("June 01, 2026"), F.lit("link"), product="Player")
    at = F.to_timestamp(F.lit("2026-06-01 10:00:00"))
    row = reports.message_record(message, F.lit("team@example.org"), F.lit("s"), at).first()
    assert "- **Theme #1:** SLOW APP (3 mentions)" in row.body
    assert "The Player Weekly Product Review Pulse for the week of June 01, 2026" in row.body
    assert row.timestamp == "20260601_100000"
