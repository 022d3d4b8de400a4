"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.joins import lookup_join
from voxmill.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

# Edges that one task joins in about a second and 100 MB; more go by rounds over all tasks.
ONE_TASK_EDGES = 500_000


def _in_one_task(edges: pd.DataFrame) -> pd.DataFrame:
    """Every vertex of a few edges with the smallest one of its component."""
    codes, names = pd.factorize(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), sort=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(codes) // 2
    for u, v in zip(codes[:half].tolist(), codes[half:].tolist(), strict=True):
        u, v = root(u), root(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    roots = [root(x) for x in range(len(names))]
    return pd.DataFrame({"vertex": names, "component": names[roots]})


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """Add the smallest member ``m`` of each neighbourhood ``{u} + its v``.

    The minimum is combined in the map tasks and joined back with the hub's
    rows spread out, so a hub with a third of all edges is no hot task.
    """
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = lookup_join(pairs, smallest, ["u"], how="inner")
    return joined.withColumn("m", F.least("m", "u"))


def _joined_nearby(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every vertex of a task's edges with the smallest one it reaches by them."""
    if edges := list(batches):
        yield _in_one_task(pd.concat(edges, ignore_index=True))


def _by_neighbourhoods(edges: DataFrame, near: str, count: int, one_task_edges: int) -> DataFrame:
    """Components by tasks that join edges with close values of ``near``, and links between these.

    A vertex that several tasks have links what they found; where ``near`` tells
    neighbours, these are few.
    """
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, 4 * count // one_task_edges + 1)
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), near)
    local = pairs.repartitionByRange(tasks, near).select("u", "v")
    local = cut_lineage(local.mapInPandas(_joined_nearby, f"vertex {kind}, component {kind}"))
    least = cut_lineage(
        local.groupBy("vertex").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    )
    shared = least.where(F.col("least") < F.col("most")).select("vertex", "least")
    links = lookup_join(local, shared, ["vertex"], how="inner").select(
        F.col("component").alias("a"), F.col("least").alias("b")
    )
    linked = components(links, one_task_edges).withColumnsRenamed({"vertex": "least", "component": "_all"})
    found = lookup_join(least.select("vertex", "least"), linked, ["least"])
    return found.select("vertex", F.coalesce("_all", "least").alias("component"))


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES, near: str | None = None) -> DataFrame:
    """Rows ``(vertex, component)`` of the edges ``(a, b)``.

    The component is its smallest vertex.  Up to ``one_task_edges`` different
    edges are joined in one task.  More are first joined by tasks, each with
    edges of close values of the column ``near`` if there is one, so that only
    links between these are left.  What is still more goes by rounds that alternate two steps (Kiveris,
    Lattanzi, Mirrokni, Rastogi, Vassilvitskii: "Connected Components in
    MapReduce and Beyond", 2014) until the edges form one star per component:
    link the larger neighbours of each vertex to its smallest neighbour, then
    link the smaller ones.  Few rounds; the edges never grow in number.
    """
    if near is not None and (count := edges.count()) > one_task_edges:
        return _by_neighbourhoods(edges, near, count, one_task_edges)
    stars = cut_lineage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(stars)
    if state[0] <= one_task_edges:
        kind = stars.schema["u"].dataType.simpleString()
        whole = stars.withColumn("all", F.lit(True)).groupBy("all")
        return whole.applyInPandas(_in_one_task, f"vertex {kind}, component {kind}")
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_smallest(both)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        near = _with_smallest(large)
        small = (
            near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        stars = cut_lineage(small, replaces=stars)
        previous, state = state, _state(stars)
        if state == previous:
            break
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )


def _state(pairs: DataFrame) -> tuple:
    """Count and order-free hash of the pairs: equal when nothing changed."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(hashed)).first())
