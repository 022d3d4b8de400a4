"""Limits, running sums and skew-safe joins against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import selection, themes
from voxmill.operators.joins import lookup_join


def test_large_limit_on_a_hot_group(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), F.col("id").alias("pos")
    )
    found = selection.top_per_group(rows, ["g"], [F.col("pos").desc()], 1500, ["pos"])
    got = {r.g: (r.n, r.low) for r in found.groupBy("g").agg(F.count("*").alias("n"), F.min("pos").alias("low")).collect()}
    tail = [i for i in range(20_000) if i % 10][-1500]
    assert got == {"a": (1500, tail), "b": (1500, 19_990 - 1499 * 10)}


def test_small_limit_is_cut_in_the_map_tasks(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    found = selection.top_per_group(rows, ["g"], [F.col("id")], 3, ["id"])
    plan = found._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 4, 5]


def test_running_sum_over_blocks(spark):
    values = [(g, p, (g + 3) * p % 7) for g in (0, 1) for p in range(5, 60, 1 + g)]
    rows = spark.createDataFrame(values, "g int, p int, v int")
    found = selection.running_sum(rows, ["g"], "p", "v", "before", block=10)
    for r in found.collect():
        assert r.before == sum(v for g, p, v in values if g == r.g and p < r.p)
    assert found.count() == len(values)


def test_lookup_join_equals_join(spark):
    big = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.createDataFrame([(1, "x"), (450, "y")], "k long, v string")
    for how, count in (("left", 500), ("inner", 401)):
        found = lookup_join(big, lookup, ["k"], how)
        assert found.count() == count
        assert found.where(F.col("v").isNotNull()).count() == 401


def test_short_texts_only_serve_as_fallback(spark):
    rows = [
        (1, "short", 0), (1, "a text with more than ten", 1), (1, "a text with more than ten", 2),
        (2, "tiny", 5), (2, "wee", 4), (2, " ", 3), (3, None, 0),
    ]
    table = spark.createDataFrame(rows, "cluster_id int, content string, pos int")
    found = themes.quote_rows(table, "pos")
    assert {(r.cluster_id, r.quote_rank, r.quote) for r in found.collect()} == {
        (1, 1, "a text with more than ten"), (2, 1, "wee"),
    }
    report = themes.cluster_report(table, "pos").where("cluster_id = 3").first()
    assert (report.theme_name, report.representative_quotes) == ("General Feedback", [])


def test_action_goes_to_the_last_row_larger_than_all_before(spark):
    rows = [("d", 0, "A", "a0", 2), ("d", 1, " a ", "a1", 3), ("d", 2, "A", "a2", 5), ("d", 3, "a", "a3", 11)]
    table = spark.createDataFrame(rows, "run_date string, cluster_id int, theme_name string, action_idea string, size long")
    merged = themes.merge_themes(table).first()
    assert (merged["size"], merged.action_idea) == (21, "a3")
    merged = themes.merge_themes(table.where("cluster_id < 3")).first()
    assert (merged["size"], merged.action_idea, merged.theme_name) == (10, "a1", "A")


def test_outside_names_are_capped(spark):
    table = spark.createDataFrame([("n" * 60, None), (None, "do")], "theme_name string, action_idea string")
    found = [tuple(r) for r in themes.fill_synthesis_defaults(table).collect()]
    assert found == [("n" * 50, "Improve recommendation quality."), ("Feedback Cluster", "do")]
