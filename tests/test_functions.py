"""Edge values of the column functions."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from voxmill.functions import dates, ratings
from voxmill.functions import lexicons as lex
from voxmill.functions import text as tx

NBSP = " "

PII = [
    ("mail a.b@c.com. ok", "mail [REDACTED_EMAIL] ok", False),
    ("call +1-555-019-9922 now", "call +[REDACTED_PHONE] now", False),
    ("(555) 123-4567", "([REDACTED_PHONE]", True),
    ("ip 192.168.1.1 x", "ip [REDACTED_IP] x", True),
    ("hey @ünïcode", "hey [REDACTED_HANDLE]", False),
    ("1.2.3.4567", "1.2.3.4567", True),
    ("é5551234567", "é5551234567", False),
    ("5551234567é", "5551234567é", False),
    ("٣٣٣ 444 5555", "[REDACTED_PHONE]", False),
    (f"nbsp{NBSP}here", f"nbsp{NBSP}here", True),
    (None, "", True),
]


def rows_of(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(spark, values, column, kind="string"):
    found = rows_of(spark, values, kind).select("i", column.alias("r")).orderBy("i").collect()
    return [row["r"] for row in found]


def test_redaction(spark):
    texts = [text for text, _, _ in PII]
    assert evaluate(spark, texts, tx.scrub_pii(F.col("v"))) == [want for _, want, _ in PII]


def test_whitelist(spark):
    texts = [text for text, _, _ in PII]
    assert evaluate(spark, texts, tx.passes_characters(F.col("v"))) == [ok for _, _, ok in PII]


def test_redaction_counts(spark):
    counts = tx.count_pii(F.col("v"))
    text = ["a@b.co and c@d.org, 555 123 4567, 10.0.0.1 and @me @you"]
    found = rows_of(spark, text).select(*[c.alias(k) for k, c in counts.items()]).first()
    assert found.asDict() == {"email": 2, "phone": 1, "ip": 1, "handle": 2}


def test_length_gate(spark):
    texts = ["", "   ", None, "x", " " * 9 + "y" * 50 + "\t\n", "z" * 51]
    assert evaluate(spark, texts, tx.passes_length(F.col("v"))) == [
        False, False, False, True, True, False,
    ]


def test_clusterable(spark):
    texts = [None, "abc", " abcd ", "  abc  "]
    assert evaluate(spark, texts, tx.is_clusterable(F.col("v"))) == [False, False, True, False]


def test_english(spark):
    texts = ["", "a" * 88 + "é" * 12, "a" * 89 + "é" * 11, "éé"]
    assert evaluate(spark, texts, tx.is_likely_english(F.col("v"))) == [True, False, True, False]
    assert evaluate(spark, texts, tx.needs_translation(F.col("v"))) == [False, True, False, False]


def test_segments_match_inside_words(spark):
    texts = ["Please BUILD it", "I paid for ads", "nice", "shuffle, and it is slow"]
    found = evaluate(spark, texts, tx.segment_tags(F.col("v")))
    assert found == [
        ["UI/UX Issue"],
        ["Premium User", "Free User"],
        ["General Feedback"],
        ["Discovery Issue", "Performance/Stability Issue"],
    ]
    whole = evaluate(spark, texts[:1], tx.segment_tags(F.col("v"), whole_word=True))
    assert whole == [["General Feedback"]]


def test_dates(spark):
    texts = [
        "2026-06-21T08:41:06-07:00", "2026-06-21T15:41:06Z", "2026-06-21 15:41:06",
        "2026-06-21T15:41:06.500Z", "", "soon", None,
    ]
    found = evaluate(spark, texts, F.unix_millis(dates.parse_date(F.col("v"))))
    base = 1782056466000
    assert found == [base, base, base, base + 500, None, None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("24h", timedelta(hours=24)),
        ("7d", timedelta(days=7)),
        (" 30D ", timedelta(days=30)),
        ("invalid", timedelta(days=7)),
        ("xd", timedelta(days=7)),
        ("", timedelta(days=7)),
    ],
)
def test_timeframe(spark, text, want):
    assert dates.parse_timeframe(text) == want
    found = evaluate(spark, [text], dates.timeframe_seconds(F.col("v")))
    assert found == [int(want.total_seconds())]


def test_names_and_labels(spark):
    assert evaluate(spark, ["  A \t B\n"], tx.normal_name(F.col("v"))) == ["a b"]
    labels = evaluate(spark, ["x" * 20, "y" * 21], tx.short_label(F.col("v")))
    assert labels == ["x" * 20, "y" * 18 + "..."]
    assert evaluate(spark, ["'\"  Quote it.?! \n"], tx.clean_quote(F.col("v"))) == ["Quote it"]


def test_polarity(spark):
    found = evaluate(spark, [5, 4, 3, 2, 1, 0, None], ratings.polarity(F.col("v")), "int")
    assert found == ["positive"] * 2 + ["neutral"] + ["negative"] * 3 + ["neutral"]


def test_actions_are_short():
    assert set(lex.THEME_ACTIONS) == {*lex.THEME_TERMS, lex.DEFAULT_THEME}
    assert all(len(text.split()) <= 25 for text in lex.THEME_ACTIONS.values())
    assert all(len(name.split()) <= 6 for name in lex.THEME_TERMS if "Data" not in name)


def test_date_forms(spark):
    day = "2024-01-05 10:00:00"
    forms = {
        "2024-01-05T10:00Z": day, "20240105T100000Z": day, "2024-01-05 10": day, "2024-01-05T10:00:00.5Z": day + ".5",
        "2024-01-05T10:00:00,5": day + ".5", "2024-01-05T12:00+0200": day, "2024-01-05T12:00:00+02": day,
        "2024-01-05T12:00:00+02:00": day, "2024-01-05": "2024-01-05 00:00:00", "20240105": "2024-01-05 00:00:00",
        " 2024-01-05t10:00:00z ": day, "12:30": None, "2024": None, "2024-01": None, "": None, None: None,
        "2024-01-05 10:00:00 Europe/Berlin": None, "2024-13-05": None, "2024-01-05T25:00": None, "2024-0105": None,
    }
    table = spark.createDataFrame([(form,) for form in forms], "form string")
    found = {r.form: r.at for r in table.select("form", dates.parse_date(F.col("form")).cast("string").alias("at")).collect()}
    assert found == forms
