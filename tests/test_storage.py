"""What iterative jobs leave on the shared storage, and damaged inputs."""

from __future__ import annotations

from pathlib import Path

import pytest

from voxmill import schemas
from voxmill.operators.components import components
from voxmill.plans import ingest
from voxmill.operators import density
from voxmill.session import cut_lineage, scratch
from voxmill.sources import files
from voxmill.streaming import streams


def _folders(spark):
    return set(Path(spark.conf.get("spark.checkpoint.dir")).glob("voxmill-*"))


def test_rounds_replace_each_other(spark):
    before = _folders(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components(edges, one_task_edges=0).count() == 41
    assert len(_folders(spark) - before) == 1
    first = cut_lineage(spark.range(3))
    second = cut_lineage(first, replaces=first)
    assert second.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|not exist"):
        spark.read.parquet(first._folder + "/rows").count()


def test_only_what_is_handed_over_outlives_a_block(spark):
    before = _folders(spark)
    with scratch(spark) as hand_over:
        inner = cut_lineage(spark.range(5))
        with scratch(spark) as deeper:
            kept = deeper(cut_lineage(inner.where("id > 1")))
        result = hand_over(kept.where("id > 2"))
        assert kept.count() == 3
    assert sorted(r.id for r in result.collect()) == [3, 4]
    assert len(_folders(spark) - before) == 1
    with pytest.raises(ValueError), scratch(spark):
        cut_lineage(spark.range(5))
        raise ValueError
    assert len(_folders(spark) - before) == 1


def test_clusters_leave_one_table(spark):
    before = _folders(spark)
    points = spark.range(60).selectExpr("id", "array(id % 3 * 100.0 + id / 60, id * 0.01) AS point")
    labels = density.cluster(points, "id", 5, block_rows=20, piece_rows=10)
    assert labels.select("cluster_id").distinct().count() == 3
    assert len(_folders(spark) - before) == 1


def test_micro_batches_leave_nothing(spark, tmp_path):
    before = _folders(spark)
    write = streams.merge_days(str(tmp_path / "days"), ["norm_name"])
    for batch in range(10):
        rows = [("2024-01-01", "a", batch), ("2024-01-02", f"b{batch}", 1)]
        write(spark.createDataFrame(rows, "run_date string, norm_name string, size long"), batch)
    assert _folders(spark) == before
    found = spark.read.parquet(str(tmp_path / "days"))
    assert found.count() == 11 and found.where("norm_name = 'a'").first().size == 9


def test_damaged_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"id": "card_1", "title": "t"}, {"id": "card_2"}]')
    (tmp_path / "bad.json").write_text('[{"id": "card_3", ')
    found = files.read_or_empty(spark, str(tmp_path), schemas.EXPERIMENT_CARD, "json")
    assert sorted(r.id for r in found.collect()) == ["card_1", "card_2"]
    damaged = files.damaged_records(spark, str(tmp_path), schemas.EXPERIMENT_CARD).collect()
    assert [(r.filename, r.record[:14]) for r in damaged] == [("bad.json", '[{"id": "card_')]
    assert files.damaged_records(spark, str(tmp_path / "none"), schemas.EXPERIMENT_CARD).count() == 0


def test_a_failing_source_stops_no_other(spark, tmp_path):
    good = spark.createDataFrame([("r1", "app_store")], "review_id string, source string")

    def missing():
        return spark.read.parquet(str(tmp_path / "missing"))

    def failing():  # fails only when it is run
        return good.selectExpr("raise_error('no') AS review_id", "source")

    for _ in range(2):
        told = ingest.land_each({"a": lambda: good, "b": missing, "c": failing}, str(tmp_path / "landed"), "b1")
    assert [(name, error is None) for name, error in told] == [("a", True), ("b", False), ("c", False)]
    assert spark.read.parquet(str(tmp_path / "landed/source=a")).count() == 1
