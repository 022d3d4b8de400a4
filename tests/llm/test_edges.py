"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxmill.llm import chat, codeswitch, credentials, decontam, neardup, notices, packing, quality, token_counts, urllists
from voxmill.llm.shared import bounded_batches

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, node string, _q string, n_words int, kept string, text_ string"
)
LONG = "lorem ipsum dolor " * 40_000
ROWS = [
    (1, None, None, None, None, 1, "x", "q", 3, "no", "t"),
    (2, "", "en", "a", 0, 1, "x", "q", 3, "no", "t"),
    (3, "  \n\t ", "en", "a", 0, 1, "x", "q", 3, "no", "t"),
    (4, LONG, "en", "a", 0, 1, "x", "q", 3, "no", "t"),
    (5, "the same words in two rows", "en", "a", 0, 1, "x", "q", 3, "no", "t"),
    (5, "the same words in two rows", "en", "a", 0, 1, "x", "q", 3, "no", "t"),
    (None, "a row that has no id", "en", "a", 0, 1, "x", "q", 3, "no", "t"),
]
# The columns of each operator's result and the rows it gives for ROWS.
BY_ROW = {
    "quality": (quality.quality_table, 7),
    "near": (neardup.near_duplicates, 7),
    "secrets": (credentials.secret_spans, 7),
    "notices": (notices.notice_spans, 7),
    "languages": (codeswitch.languages, 7),
    "counts": (token_counts.token_counts, 7),
}


@pytest.fixture(scope="module")
def docs(spark):
    return bounded_batches(spark).createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", BY_ROW)
def test_one_row_per_document(docs, name):
    operator, count = BY_ROW[name]
    found = operator(docs).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert len(found) == count


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_table(docs, name):
    assert BY_ROW[name][0](docs.limit(0)).collect() == []


def test_quality_of_odd_rows(docs):
    found = {r.doc_id: r for r in quality.quality_table(docs).collect()}
    assert (found[1].n_words, found[1].kept, found[1].base_failed) == (0, False, True)
    assert found[4].n_words == found[4].n_repeat_words == 120_000
    assert found[4].word_chars == len("loremipsumdolor") * 40_000


def test_near_duplicates_of_odd_rows(docs):
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, words=2).collect()]
    assert (1, 0, 1, True) in found and (2, 0, 2, True) in found and (3, 0, 3, True) in found
    assert found.count((5, 5, 5, True)) == 2 and (None, 5, None, True) in found


@pytest.mark.parametrize("stage", ["quality", "near", "bench", "secrets"])
def test_stages_keep_columns(spark, docs, stage):
    benchmark = spark.createDataFrame([(1, "no such item"), (None, None), (2, "")], "item_id long, text string")
    stages = {
        "quality": quality.keep_good,
        "near": neardup.keep_one_each,
        "bench": lambda d: decontam.drop_contaminated(d, benchmark),
        "secrets": credentials.redact_secrets,
    }
    found = stages[stage](docs)
    assert found.columns == docs.columns
    ids = sorted((r.doc_id for r in found.collect()), key=str)
    expected = {"quality": [], "near": [1, 2, 3, 4, 5, None]}.get(stage, [r[0] for r in ROWS])
    assert ids == sorted(expected, key=str)
    assert stages[stage](docs.limit(0)).collect() == []


def test_packing_of_odd_rows(docs):
    found = packing.pack(docs).where("start = 0").collect()
    assert {r.doc_id: r.doc_tokens for r in found}[1] == 1
    assert len(found) == 7
    assert packing.pack(docs.limit(0)).collect() == []


def test_decontamination_of_odd_rows(spark, docs):
    benchmark = spark.createDataFrame(
        [(1, "The SAME words, in two rows!"), (1, "The SAME words, in two rows!"), (2, None), (None, "a row"), (3, "")],
        "item_id long, text string",
    )
    found = [(r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(docs, benchmark).collect()]
    assert found == [(5, 1, 0), (5, 1, 0)]
    assert decontam.contaminated(docs, benchmark.limit(0)).collect() == []


def test_chat_of_odd_rows(spark):
    rows = [(1, 2, None, None), (1, None, "user", ""), (None, 0, "assistant", "x"), (1, 2, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    found = {r.conv_id: r for r in chat.digests(chat.expand(table)).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[1].n_examples) == (3, 1, 1)
    assert (found[None].n_turns, found[None].loss_chars) == (1, 1)
    assert chat.expand(table.limit(0)).collect() == []


def test_urls_of_odd_rows(spark):
    urls = [(1, None, 5), (2, "", 5), (3, "http://a.b.c/x", None), (4, "HTTP://u@A.B.c:80/?q", 5), (4, "HTTP://u@A.B.c:80/?q", 5)]
    captures = spark.createDataFrame(urls, "page_id long, url string, fetched int").withColumn("pattern", F.lit("p"))
    events = [("l", "b.c", "add", 3), ("l", "b.c", "remove", 9), ("l", None, "add", 1), ("l", "b.c", "odd", 5), (None, "c", "add", 1)]
    listed = spark.createDataFrame(events, "list string, pattern string, action string, day int")
    found = {r.page_id: r for r in urllists.evaluate(captures, urllists.validity(listed)).collect()}
    assert len(found) == 4
    assert (found[4].host, found[4].blocked, found[4].pattern, found[4].active_since) == ("a.b.c", True, "b.c", 3)
    assert not found[1].blocked and not found[2].blocked and not found[3].blocked
    assert urllists.evaluate(captures.limit(0), urllists.validity(listed.limit(0))).collect() == []
