"""Conversation repair against enumeration and a plain version of the whole query."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from voxmill.llm import turn_repair
from voxmill.llm.queries import QUERIES
from voxmill.llm.shared import bounded_batches, read_table

BLANKS = re.compile(r"[\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def _apply(rows: list[tuple[str, str, str]], audit: str) -> tuple[int, list[tuple[str, str]]] | None:
    """Cost and result of an audit over rows (role, text, fault); None if it isn't one."""
    written, cost, at = [], 0, 0
    for letter in audit:
        turn = "assistant" if written and written[-1][0][:1] == "u" else "user"
        if letter == "I":
            written.append((turn, ""))
            cost += 2
            continue
        if at == len(rows):
            return None
        role, text, fault = rows[at]
        at += 1
        if letter == "D":
            cost += 3
        elif fault in ("blank", "duplicate"):
            return None
        else:
            cost += (fault == "truncated") + 2 * (letter == "R")
            written.append((role if letter == "K" else turn, text))
    legal = LEGAL.fullmatch("".join(role[:1] or "?" for role, _ in written))
    return (cost, written) if at == len(rows) and legal else None


def plain_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str]:
    """The least (cost, audit) by going over all prefixes row by row, at most three inserts in a place."""
    first = {"s": {"b"}, "u": {"b", "s", "a"}, "a": {"u"}}

    def inserted(labels):
        for _ in range(3):
            for state, (cost, audit) in list(labels.items()):
                then = "a" if state == "u" else "u"
                labels[then] = min(labels.get(then, (10**9, "")), (cost + 2, audit + "I"))
        return labels

    labels = {"b": (0, "")}
    for role, _, fault in rows:
        after: dict[str, tuple[int, str]] = {}
        for state, (cost, audit) in inserted(labels).items():
            then = "a" if state == "u" else "u"
            options = [("D", 3, state)]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                options.append(("R", 2 + more, then))
                if state in first.get(role[:1], ()):
                    options.append(("K", more, role[:1]))
            for letter, more, to in options:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, audit + letter))
        labels = after
    return min(label for state, label in inserted(labels).items() if state in "ba")


def plain_result(rows: list[tuple]) -> tuple:
    """The query's columns after conv_id, from a conversation's (conv, turn, role, text)."""
    after = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        damage = zlib.crc32(name.encode()) % 20
        text = "" if damage == 1 else re.sub(r"[.!?]", "", text) if damage == 2 else text
        row = (turn, "user" if damage == 4 else role, text)
        after.extend([] if damage == 0 else [row, row] if damage == 3 else [row])
    digest = lambda r: hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
    seen, told = set(), []
    for _, role, text in after:
        bare = BLANKS.sub("", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        told.append((role, text, fault))
    turns = [turn for turn, _, _ in after if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [sum(fault == name for _, _, fault in told) for name in ("blank", "duplicate", "truncated")]
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(told)]
    cost, audit = plain_repair(told)
    checked = _apply(told, audit)
    assert checked is not None and checked[0] == cost
    text = "\n".join(f"{role}:{text}" for role, text in checked[1])
    illegal = sum(pair not in ("su", "ua", "au") for pair in pairs)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _expected(rows: list[tuple]) -> list[tuple]:
    by_conv: dict = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    return sorted(((conv, *plain_result(own)) for conv, own in by_conv.items()), key=repr)


def _codes(rows: list[tuple[str, str, str]]) -> str:
    faults = {"": "0", "blank": "1", "duplicate": "2", "truncated": "3"}
    return "".join((role[:1] if role[:1] in "sua" and role else "-") + faults[fault] for role, _, fault in rows)


def _random_rows(draw: random.Random, count: int) -> list[tuple[str, str, str]]:
    roles = ["system", "user", "user", "assistant", "assistant", "tool", ""]
    faults = ["", "", "", "blank", "duplicate", "truncated"]
    return [(draw.choice(roles), "t", draw.choice(faults)) for _ in range(count)]


def test_search_against_all_audits():
    draw = random.Random(1)
    for _ in range(25):
        rows = _random_rows(draw, draw.randrange(4))
        every = (
            (found[0], audit)
            for size in range(len(rows), 8)
            for audit in map("".join, itertools.product("DIKR", repeat=size))
            if (found := _apply(rows, audit)) is not None
        )
        assert turn_repair._whole(_codes(rows)) == min(every) == plain_repair(rows)


def test_search_of_longer_conversations():
    draw = random.Random(2)
    for _ in range(400):
        rows = _random_rows(draw, draw.randrange(1, 60))
        assert turn_repair._whole(_codes(rows)) == plain_repair(rows)


def test_segments_combine():
    draw = random.Random(3)
    for _ in range(150):
        rows = _random_rows(draw, draw.randrange(2, 30))
        codes, step = _codes(rows), draw.randrange(1, 7)
        parts = [codes[2 * k : 2 * (k + step)] for k in range(0, len(rows), step)]
        costs, ranks = [], []
        for part in parts:
            found = {(p, q): turn_repair.least_audit(part, p, {q: 0}) for p in range(4) for q in range(4)}
            costs.append([found[p, q] and found[p, q][0] for p in range(4) for q in range(4)])
            order = {p: sorted((found[p, q][1], q) for q in range(4) if found[p, q]) for p in range(4)}
            ranks.append([found[p, q] and order[p].index((found[p, q][1], q)) for p in range(4) for q in range(4)])
        states = turn_repair.best_states(costs, ranks)
        audit, cost = "", 0
        for k, (part, (p, q)) in enumerate(zip(parts, states, strict=True)):
            more = turn_repair._whole(part, p, q) if k + 1 == len(parts) else turn_repair.least_audit(part, p, {q: 0})[:2]
            cost, audit = cost + more[0], audit + more[1]
        assert (cost, audit) == plain_repair(rows)


@pytest.mark.parametrize("segment_rows", [None, 3])
def test_query(spark, data_dir, segment_rows):
    table = read_table(spark, data_dir, "conversations")
    found = QUERIES["op13_turn_repair"](spark, data_dir) if segment_rows is None else turn_repair.repair(table, segment_rows)
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _expected(rows)


def test_odd_rows(spark):
    rows = [
        *[(None, k, "user", f"one {k}.") for k in range(30)],
        *[(7, 5, "user", "the same.")] * 25,
        (8, None, None, None), (8, None, "assistant", "x"), (8, 9, "", "y?"), (8, -4, "system", " \t\n"),
        (9, None, "user", "only turns without a number"),
        *[(k, 0, "user", "short.") for k in range(100, 140)],
        (10, 1, "user", "long " * 200_000), (10, 1, "assistant", "a tie!"), (10, 1, "user", "a tie!"),
    ]
    table = bounded_batches(spark).createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int")
    for segment_rows in (2_048, 4):
        found = sorted((tuple(r) for r in turn_repair.repair(table, segment_rows).collect()), key=repr)
        assert found == _expected(rows)
    gone = [r for r in _expected(rows) if r[-2] == "" and r[-1] == hashlib.sha256(b"").hexdigest()]
    assert any(r[1:7] == (0,) * 6 for r in gone)
    assert turn_repair.repair(table.limit(0)).collect() == []
