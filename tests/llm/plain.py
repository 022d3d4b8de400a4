"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re


def sets_of(texts: dict[int, str | None], size: int) -> dict[int, frozenset]:
    found = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        runs = range(max(1, len(words) - size + 1)) if words else ()
        found[key] = frozenset(tuple(words[k : k + size]) for k in runs)
    return found


def components(sets: dict[int, frozenset], similarity: int = 80) -> dict[int, int]:
    """Smallest id of each set's component, by comparing all pairs."""
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {key: find(key) for key in keys}


def edit_distance(item: str, text: str) -> int:
    """Least distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
    return min(row)


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """Of the secret scan's contract, found step by step."""
    kinds = [
        (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I, 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 0, 18),
        (r"[0-9a-f]+", 0, 0, 16),
    ]
    found = []
    for kind, (pattern, flags, group, least) in enumerate(kinds):
        at = 0
        while match := re.compile(pattern, flags).search(text, at):
            at = match.end()
            if len(match[group]) >= least:
                found.append((match.start(), kind, match.end()))
    return sorted(found)
