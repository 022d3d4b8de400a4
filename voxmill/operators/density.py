"""Density clusters: single linkage, condensed tree, excess of mass.

With one neighbour per point the core distance is zero, so the hierarchy is
single linkage on plain distance (Campello, Moulavi, Sander: "Density-Based
Clustering Based on Hierarchical Density Estimates", 2013).  Labels start at 0;
-1 is noise.

The spanning tree is cut into pieces of at most ``piece_rows`` edges (long edges
apart from short ones), and each piece is turned into its part of the hierarchy
in one task.  Pieces meet only through one row each, so the number of points is
bounded by the cluster, not by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.components import components
from voxmill.operators.joins import lookup_join
from voxmill.operators.selection import numbered
from voxmill.operators.spanning_tree import BLOCK_ROWS, split_into_boxes, tree_of_boxes
from voxmill.session import cut_lineage, scratch, ship_with_tasks

# Sums of stabilities depend on their order in the last digits: a cluster that reaches the sum of
# its parts but for this share counts as equal, in one task and in joins alike.
TIE = 1e-9

NOISE = -1
PIECE_ROWS = 200_000

ship_with_tasks(__name__)

_HIERARCHY = (
    "piece bigint, id bigint, region bigint, parent_region bigint, birth double, "
    "is_top boolean, is_link boolean, mass double, lambda_mass double"
)


def cluster(
    points: DataFrame,
    row_id: str,
    min_size: int = 2,
    point: str = "point",
    block_rows: int = BLOCK_ROWS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Rows ``(row_id, cluster_id)`` for every row of ``(row_id, point)``.

    The smallest cluster has ``max(2, min(min_size, rows))`` rows.  If nothing
    clusters, the rows are split in two halves; a single row is cluster 0.
    """
    with scratch(points.sparkSession) as hand_over:
        return hand_over(_clustered(points, row_id, min_size, point, block_rows, piece_rows))


def _clustered(
    points: DataFrame, row_id: str, min_size: int, point: str, block_rows: int, piece_rows: int
) -> DataFrame:
    rows = cut_lineage(points.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(point).alias("x")))
    # Equal points are one point with a weight.
    distinct = cut_lineage(rows.groupBy("x").agg(F.min("row_id").alias("vid")))
    boxed = cut_lineage(split_into_boxes(distinct.select("vid", "x"), block_rows)[0])
    tree = cut_lineage(tree_of_boxes(boxed))
    named = cut_lineage(lookup_join(rows, boxed, ["x"], how="inner").select("row_id", "vid", "box"))
    return _named(label(named, tree, min_size, piece_rows), row_id)


def label(rows: DataFrame, tree: DataFrame, min_size: int = 2, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(row_id, cluster_id)`` of rows ``(row_id, vid)`` on the spanning tree ``(lo, hi, w)`` of their points.

    Both are read several times and should be written.  A column ``box`` of the
    rows, with close values for close points, keeps neighbours in one task.
    """
    near = F.min("box" if "box" in rows.columns else "vid").alias("near")
    points = cut_lineage(rows.groupBy("vid").agg(F.count("*").alias("weight"), near))
    total = rows.count()
    if total < 2:
        return rows.select("row_id", F.lit(0).alias("cluster_id"))
    if points.limit(2).count() < 2:
        return halves(rows, "row_id")
    smallest = max(2, min(min_size, total))
    regions = cut_lineage(_regions(tree, points, smallest, piece_rows))
    chosen = cut_lineage(select_clusters(_cluster_tree(regions), piece_rows))
    members = regions.where(F.col("id") < 0).select(
        (-F.col("id") - 1).alias("vid"), F.col("region").alias("node")
    )
    labelled = lookup_join(members, chosen, ["node"])
    per_row = cut_lineage(
        lookup_join(rows, labelled.select("vid", "chosen"), ["vid"], how="inner").select("row_id", "chosen")
    )
    if per_row.where(F.col("chosen").isNotNull()).isEmpty():
        return halves(rows, "row_id")
    return _number(per_row)


def _named(labels: DataFrame, row_id: str) -> DataFrame:
    return labels.withColumnRenamed("row_id", row_id)


def halves(rows: DataFrame, position: str) -> DataFrame:
    """The first half of the rows by position gets 0, the rest 1."""
    ranked = numbered(rows.select(position), [F.col(position)], "_before")
    half = F.floor(rows.agg(F.count("*")).scalar() / 2)
    return ranked.select(position, F.when(F.col("_before") < half, 0).otherwise(1).alias("cluster_id"))


def _number(per_row: DataFrame) -> DataFrame:
    """Number the chosen clusters by their first row."""
    first = (
        per_row.where(F.col("chosen").isNotNull())
        .groupBy("chosen")
        .agg(F.min("row_id").alias("_first"))
    )
    numbers = numbered(first, [F.col("_first")], "_no").select("chosen", "_no")
    clustered = lookup_join(per_row.where(F.col("chosen").isNotNull()), numbers, ["chosen"]).select(
        "row_id", F.col("_no").cast("int").alias("cluster_id")
    )
    noise = per_row.where(F.col("chosen").isNull())
    return clustered.unionByName(noise.select("row_id", F.lit(NOISE).alias("cluster_id")))


# --- the hierarchy, piece by piece --------------------------------------------
#
# Ids: a point is -(vid + 1), the merge made by an edge is the edge's rank.
# A region is a part of the hierarchy between two splits: one cluster of the
# condensed tree.  It is named after its top.


def _regions(
    tree: DataFrame, distinct: DataFrame, smallest: int, piece_rows: int
) -> DataFrame:
    """Every point and merge with its region, and what the region gains from it."""
    weights = distinct.select("vid", F.col("weight").cast("double").alias("weight"), "near")
    ends = [
        ("lo", "a", weights.withColumnsRenamed({"vid": "lo", "weight": "wa"})),
        ("hi", "b", weights.withColumnsRenamed({"vid": "hi", "weight": "wb"}).drop("near")),
    ]
    ranked = tree.orderBy("w", "lo", "hi").withColumn("rank", F.monotonically_increasing_id())
    ranked = cut_lineage(ranked)
    for end, side, table in ends:
        ranked = ranked.join(table, end).withColumn(side, -F.col(end) - 1)
    last, shortest, merges = ranked.agg(F.max("rank"), F.min("w"), F.count("*")).first()
    whole = F.lit(last).cast("bigint")
    edges = ranked.select(whole.alias("piece"), "rank", "w", "a", "wa", "b", "wb", "near")
    in_pieces = merges > piece_rows
    if in_pieces:
        edges = _cut_into_pieces(cut_lineage(edges), piece_rows)

    def hierarchy(rows: pd.DataFrame) -> pd.DataFrame:
        return _piece_hierarchy(rows, smallest, 1.0 / shortest)

    edges = edges.drop("near")
    if not in_pieces:  # the top of the only piece is the root
        parts = edges.groupBy("piece").applyInPandas(hierarchy, _HIERARCHY)
        return _fill_regions(parts.withColumn("top_region", whole))

    def hierarchies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(hierarchy, _whole_pieces(batches, piece_rows))

    # Most pieces have a few edges: a task takes many at once, as they come one after the other.
    tasks = max(2 * edges.sparkSession.sparkContext.defaultParallelism, -(-merges // piece_rows))
    parts = edges.repartition(tasks, "piece").sortWithinPartitions("piece").mapInPandas(hierarchies, _HIERARCHY)
    parts = cut_lineage(parts)
    tops = _piece_regions(parts, last)
    return _fill_regions(lookup_join(parts, tops, ["piece"]))


def _cut_into_pieces(edges: DataFrame, piece_rows: int) -> DataFrame:
    """Halve each large piece: short edges in connected parts, long edges between them.

    A connected part of short edges becomes a piece of its own, named after its
    last edge, and one end point in the piece of the long edges.
    """
    while True:
        large = cut_lineage(
            edges.groupBy("piece")
            .agg(F.count("*").alias("n"), F.percentile_approx("rank", 0.5).alias("middle"))
            .where(F.col("n") > piece_rows)
            .select("piece", "middle")
        )
        if large.isEmpty():
            return edges
        marked = cut_lineage(lookup_join(edges, large, ["piece"]))
        short = marked.where(F.col("rank") <= F.col("middle"))
        rest = marked.where(F.col("middle").isNull() | (F.col("rank") > F.col("middle")))
        part_of = cut_lineage(components(short.select("a", "b", "near"), near="near"))
        named = cut_lineage(
            lookup_join(
                short, part_of.withColumnRenamed("vertex", "a"), ["a"], how="inner"
            )
        )
        weights = (
            named.select("component", F.col("a").alias("v"), F.col("wa").alias("w"))
            .unionByName(named.select("component", F.col("b").alias("v"), F.col("wb").alias("w")))
            .distinct()
            .groupBy("component")
            .agg(F.sum("w").alias("part_weight"))
        )
        parts = cut_lineage(
            named.groupBy("component").agg(F.max("rank").alias("part")).join(weights, "component")
        )
        ends = cut_lineage(
            lookup_join(part_of, parts, ["component"], how="inner").select(
                "vertex", "part", "part_weight"
            )
        )
        inner = lookup_join(
            named, parts.select("component", "part"), ["component"], how="inner"
        ).withColumn("piece", F.col("part"))
        outer = rest
        for side in ("a", "b"):
            joined = lookup_join(outer, ends.withColumnRenamed("vertex", side), [side])
            outer = joined.withColumns(
                {
                    side: F.coalesce("part", side),
                    f"w{side}": F.coalesce("part_weight", f"w{side}"),
                }
            ).drop("part", "part_weight")
        columns = ["piece", "rank", "w", "a", "wa", "b", "wb", "near"]
        edges = cut_lineage(inner.select(*columns).unionByName(outer.select(*columns)))


def _whole_pieces(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows that come by piece, in frames of whole pieces: ``most`` rows, and what then is left of a piece."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if held and sum(map(len, held)) + len(batch) > most:
            begun = int((batch["piece"] == held[-1]["piece"].iloc[-1]).sum())
            if begun < len(batch):
                yield pd.concat([*held, batch[:begun]])
                held = []
                batch = batch[begun:]
        if len(batch):
            held.append(batch)
    if held:
        yield pd.concat(held)


def _piece_hierarchy(rows: pd.DataFrame, smallest: int, top_lambda: float) -> pd.DataFrame:
    """Merges of whole pieces in order of length, then regions from the top down.

    Pieces have no point in common.  A null region or parent region means: that of the piece's own top, which the
    piece cannot know.
    """
    rows = rows.sort_values("rank", ignore_index=True)
    piece = rows["piece"].to_numpy()
    ends = np.concatenate([rows["a"], rows["b"]])
    sizes = np.concatenate([rows["wa"], rows["wb"]])
    ids, first, code = np.unique(ends, return_index=True, return_inverse=True)
    size = list(sizes[first])
    n, m = len(ids), len(rows)
    left, right = code[:m], code[m:]
    group = list(range(n))  # union-find over end points
    node = list(range(n))  # what each group's top is: an end point, or n + merge
    children = np.zeros((m, 2), dtype=np.int64)
    child_sizes = np.zeros((m, 2))

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for k in range(m):
        one, two = find(left[k]), find(right[k])
        children[k] = node[one], node[two]
        child_sizes[k] = size[one], size[two]
        group[two] = one
        size[one] += size[two]
        node[one] = n + k

    split = (child_sizes >= smallest).all(axis=1)
    name = np.concatenate([ids, rows["rank"].to_numpy()])
    unknown = np.iinfo(np.int64).min
    region = np.full(n + m, unknown, dtype=np.int64)
    above = np.full(n + m, unknown, dtype=np.int64)
    birth = np.full(n + m, np.nan)
    lam = 1.0 / rows["w"].to_numpy()
    for k in range(m - 1, -1, -1):
        for child in children[k]:
            region[child] = name[child] if split[k] else region[n + k]
            if split[k]:
                above[child], birth[child] = region[n + k], lam[k]
    is_top = ~np.isnan(birth)

    # What leaves a region: both sides of a split or of the first merge that is
    # large enough, else the small side; a merge that is not large enough leaves
    # as a whole further up.  A heavy end point dissolves at the shortest length.
    both = split | (child_sizes < smallest).all(axis=1)
    leaving = np.where(both, child_sizes.sum(axis=1), child_sizes.min(axis=1))
    leaving[child_sizes.sum(axis=1) < smallest] = 0.0
    own = sizes[first]
    heavy = np.where((own >= smallest) & (ids < 0), own, 0.0)
    mass = np.concatenate([heavy, leaving])
    lambda_mass = np.concatenate([heavy * top_lambda, leaving * lam])

    def known(values: np.ndarray) -> pd.Series:
        return pd.Series(values, dtype="Int64").where(values != unknown)

    return pd.DataFrame(
        {
            "piece": np.concatenate([np.concatenate([piece, piece])[first], piece]),
            "id": name,
            "region": known(region),
            "parent_region": known(above),
            "birth": pd.Series(birth).where(is_top, None),
            "is_top": is_top,
            "is_link": np.concatenate([ids >= 0, np.zeros(m, dtype=bool)]),
            "mass": mass,
            "lambda_mass": lambda_mass,
        }
    )


def _piece_regions(parts: DataFrame, last: int) -> DataFrame:
    """The region of each piece's top, from the piece above it.

    A top that continues in the piece above takes the region found there, or
    else that of the top above; pointers double each round.  The piece of the
    ``last`` merge holds the root, which is its own region.
    """
    root = parts.sparkSession.range(1).select(
        *[F.lit(last).cast("bigint").alias(name) for name in ("piece", "up", "region")]
    )
    links = parts.where("is_link").select(
        F.col("id").alias("piece"), F.col("piece").alias("up"), "region"
    )
    state = cut_lineage(links.unionByName(root))
    while not state.where(F.col("region").isNull()).isEmpty():
        open_ = state.where(F.col("region").isNull()).drop("region")
        above = state.select(
            F.col("piece").alias("up"), F.col("up").alias("_up"), "region"
        )
        moved = lookup_join(open_, above, ["up"]).select(
            "piece", F.col("_up").alias("up"), "region"
        )
        state = cut_lineage(state.where(F.col("region").isNotNull()).unionByName(moved))
    return state.select("piece", F.col("region").alias("top_region"))


def _fill_regions(parts: DataFrame) -> DataFrame:
    """Put in the regions that the pieces could not know."""
    above = F.when(F.col("is_top"), F.coalesce("parent_region", "top_region"))
    return parts.withColumns(
        {"region": F.coalesce("region", "top_region"), "parent_region": above}
    ).drop("top_region")


# --- clusters of the condensed tree -------------------------------------------


def _cluster_tree(regions: DataFrame) -> DataFrame:
    """Rows ``(node, parent, stability)``; the root has no parent."""
    gains = regions.where(~F.col("is_link")).groupBy(F.col("region").alias("node")).agg(
        F.sum("mass").alias("mass"), F.sum("lambda_mass").alias("lambda_mass")
    )
    born = regions.where("is_top").select(
        F.col("id").alias("node"), F.col("parent_region").alias("parent"), "birth"
    )
    stability = F.col("lambda_mass") - F.coalesce("birth", F.lit(0.0)) * F.col("mass")
    return gains.join(born, "node", "left").select(
        "node", "parent", F.coalesce(stability, F.lit(0.0)).alias("stability")
    )


def select_clusters(tree: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows ``(node, chosen)``: the selected cluster at or above each node, or null.

    A cluster is selected if it is at least as stable as its best descendants
    together and no cluster above it is; the root never is.  Up to
    ``piece_rows`` clusters are decided in one task, more by joins.
    """
    if tree.limit(piece_rows + 1).count() <= piece_rows:
        whole = tree.withColumn("_all", F.lit(0)).groupBy("_all")
        return whole.applyInPandas(_select, "node bigint, chosen bigint")
    return _topmost(_selectable(tree))


def _select(tree: pd.DataFrame) -> pd.DataFrame:
    stability = dict(zip(tree["node"], tree["stability"], strict=True))
    parent = {
        int(n): None if pd.isna(p) else int(p)
        for n, p in zip(tree["node"], tree["parent"], strict=True)
    }
    children: dict[int | None, list[int]] = {}
    for node, up in parent.items():
        children.setdefault(up, []).append(node)
    order = list(children[None])
    for node in order:
        order.extend(children.get(node, []))
    best, selectable = {}, set()
    for node in reversed(order):
        below = sum(best[child] for child in children.get(node, []))
        best[node] = max(stability[node], below)
        if parent[node] is not None and stability[node] >= below * (1 - TIE):
            selectable.add(node)
    chosen: dict[int, int | None] = {}
    for node in order:
        above = chosen.get(parent[node])
        chosen[node] = above if above is not None else (node if node in selectable else None)
    return pd.DataFrame(
        {"node": order, "chosen": pd.Series([chosen[n] for n in order], dtype="Int64")}
    )


def _selectable(tree: DataFrame) -> DataFrame:
    """Add ``selectable``, from the leaves up, in a logarithmic number of rounds.

    A node with both children decided is decided.  A node with one open child
    ``x`` is worth ``greatest(least, extra + worth(x))``; such nodes in a row are
    merged two by two each round, so long chains shorten like broad trees do.
    """
    number = F.lit(None).cast("double")
    state = cut_lineage(
        tree.withColumns(
            {"worth": number, "least": number, "extra": number, "child": F.lit(None).cast("bigint")}
        )
    )
    while not state.where(F.col("worth").isNull()).isEmpty():
        below = state.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
            F.coalesce(F.sum("worth"), F.lit(0.0)).alias("_gained"),
            F.count_if(F.col("worth").isNull()).alias("_open"),
            F.min(F.when(F.col("worth").isNull(), F.col("node"))).alias("_child"),
        )
        gained, waiting = F.coalesce("_gained", F.lit(0.0)), F.coalesce("_open", F.lit(0))
        starts = (waiting == 1) & F.col("child").isNull()
        raked = cut_lineage(
            state.join(below, "node", "left")
            .withColumns(
                {
                    "worth": F.coalesce(
                        "worth", F.when(waiting == 0, F.greatest("stability", gained))
                    ),
                    "least": F.when(starts, F.col("stability")).otherwise(F.col("least")),
                    "extra": F.when(starts, gained).otherwise(F.col("extra")),
                    "child": F.when(starts, F.col("_child")).otherwise(F.col("child")),
                }
            )
            .drop("_gained", "_open", "_child")
        )
        chains = F.col("worth").isNull() & F.col("child").isNotNull()
        lower = raked.select(
            F.col("node").alias("child"),
            F.col("worth").alias("_worth"),
            F.col("least").alias("_least"),
            F.col("extra").alias("_extra"),
            F.col("child").alias("_next"),
        )
        merges = F.col("_worth").isNull() & F.col("_next").isNotNull()
        merged = (
            lookup_join(raked.where(chains), lower, ["child"])
            .withColumns(
                {
                    "worth": F.when(
                        F.col("_worth").isNotNull(),
                        F.greatest("least", F.col("extra") + F.col("_worth")),
                    ),
                    "least": F.when(
                        merges, F.greatest("least", F.col("extra") + F.col("_least"))
                    ).otherwise(F.col("least")),
                    "extra": F.when(merges, F.col("extra") + F.col("_extra")).otherwise(
                        F.col("extra")
                    ),
                    "child": F.when(merges, F.col("_next")).otherwise(F.col("child")),
                }
            )
            .select(*raked.columns)
        )
        state = cut_lineage(raked.where(~chains).unionByName(merged), replaces=state)
    below = state.groupBy(F.col("parent").alias("node")).agg(F.sum("worth").alias("_gained"))
    enough = F.col("stability") >= F.coalesce("_gained", F.lit(0.0)) * (1 - TIE)
    return state.join(below, "node", "left").select(
        "node", "parent", (enough & F.col("parent").isNotNull()).alias("selectable")
    )


def _topmost(tree: DataFrame) -> DataFrame:
    """The topmost selectable node at or above each node; pointers double each round."""
    state = cut_lineage(
        tree.select(
            "node",
            F.col("parent").alias("up"),
            F.when(F.col("selectable"), F.col("node")).alias("chosen"),
        )
    )
    while not state.where(F.col("up").isNotNull()).isEmpty():
        above = state.select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("chosen").alias("_chosen")
        )
        moved = lookup_join(state.where(F.col("up").isNotNull()), above, ["up"]).select(
            "node", F.col("_up").alias("up"), F.coalesce("_chosen", "chosen").alias("chosen")
        )
        state = cut_lineage(state.where(F.col("up").isNull()).unionByName(moved), replaces=state)
    return state.select("node", "chosen")
