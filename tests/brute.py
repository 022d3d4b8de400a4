"""Plain single-machine definitions, written apart from the library, to test against."""

from __future__ import annotations

import numpy as np


def tree_edges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree by sorting all pairs."""
    n = len(x)
    pairs = sorted(
        (float(np.sqrt(((x[i] - x[j]) ** 2).sum())), i, j)
        for i in range(n)
        for j in range(i + 1, n)
    )
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    kept = []
    for w, i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            kept.append((w, i, j))
    return kept


def density_labels(x: np.ndarray, weight: list[int], smallest: int) -> list[int | None]:
    """A name of the selected cluster of each distinct point, or None for noise."""
    edges = tree_edges(x)
    top_lambda = 1 / edges[0][0]

    class Node:
        def __init__(self, points, lam, parts):
            self.points, self.lam, self.parts = points, lam, parts
            self.size = sum(weight[p] for p in points)

    home = {i: Node([i], top_lambda, []) for i in range(len(x))}
    for w, i, j in edges:
        a, b = home[i], home[j]
        merged = Node(a.points + b.points, 1 / w, [a, b])
        for p in merged.points:
            home[p] = merged
    root = home[0]

    def condense(node, birth):
        """(points, stability, child clusters) of the cluster that starts at ``node``."""
        points, stability = node.points, 0.0
        while True:
            if not node.parts:
                stability += node.size * (node.lam - birth)
                return [points, stability, []]
            big = [p for p in node.parts if p.size >= smallest]
            if len(big) == 2:
                stability += node.size * (node.lam - birth)
                return [points, stability, [condense(p, node.lam) for p in big]]
            if not big:
                stability += node.size * (node.lam - birth)
                return [points, stability, []]
            small = node.parts[0] if node.parts[1] is big[0] else node.parts[1]
            stability += small.size * (node.lam - birth)
            node = big[0]

    def choose(cluster):
        points, stability, children = cluster
        results = [choose(c) for c in children]
        below = sum(r[0] for r in results)
        if stability >= below:
            return stability, [points]
        return below, [group for r in results for group in r[1]]

    labels: list[int | None] = [None] * len(x)
    top = condense(root, 0.0)
    groups = [g for child in top[2] for g in choose(child)[1]]
    for number, group in enumerate(groups):
        for p in group:
            labels[p] = number
    return labels


def same_partition(one: list, two: list) -> bool:
    """Equal up to the names of the groups; None stays None."""
    if [v is None for v in one] != [v is None for v in two]:
        return False
    pairs = {(a, b) for a, b in zip(one, two, strict=True) if a is not None}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
