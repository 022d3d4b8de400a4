"""What one task holds does not grow with the table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from voxmill.checks import streams, vectors
from voxmill.operators import components as comp
from voxmill.operators.density import PIECE_ROWS
from voxmill.operators.spanning_tree import BLOCK_ROWS


class Told(Exception):
    pass


def test_boxes_and_pieces_of_large_tables_are_bounded(spark, tmp_path, monkeypatch):
    count = 40 * PIECE_ROWS
    spark.range(count).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))

    def told(*_, block_rows, piece_rows):
        raise Told(block_rows, piece_rows)

    monkeypatch.setattr(vectors.density, "cluster", told)
    monkeypatch.setattr(streams.clusters, "keep_clusters", told)
    for query in (vectors.density_blocks, streams.stream_clusters, streams.stream_clusters_frame):
        with pytest.raises(Told) as found:
            query(spark, str(tmp_path))
        assert found.value.args == (BLOCK_ROWS, PIECE_ROWS)


@pytest.mark.parametrize("spread", [False, True])
def test_components_by_neighbourhoods(spark, spread):
    """Chains over many tasks, with and without neighbours in one task."""
    rng = random.Random(5)
    names = list(range(0, 3000, 3))
    rng.shuffle(names)
    chains = [names[k : k + 100] for k in range(0, 1000, 100)]
    rows = [(a, b, rng.randrange(50) if spread else k) for k, c in enumerate(chains) for a, b in zip(c, c[1:], strict=False)]
    rows += [(rows[0][0], rows[0][0], 3), (*rows[5][1::-1], 7)]
    edges = spark.createDataFrame(rows, "a long, b long, near long")
    found = {r.vertex: r.component for r in comp.components(edges, 40, near="near").collect()}
    assert found == {v: min(c) for c in chains for v in c}


def test_neighbours_are_joined_within_tasks(spark, monkeypatch):
    """Long chains went by rounds of joins over all edges; their links are few."""
    asked = []
    state = comp._state
    monkeypatch.setattr(comp, "_state", lambda pairs: asked.append(state(pairs)) or asked[-1])
    edges = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.floor(F.col("id") / 10).alias("near"))
    assert {r.component for r in comp.components(edges, 1000, near="near").collect()} == {0}
    assert [count for count, _ in asked] == [asked[0][0]] and asked[0][0] < 100
