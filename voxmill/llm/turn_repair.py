"""Repair of conversations: the cheapest edits that give a legal order of turns.

The edits of a conversation are the paths of a lattice: node ``(i, state)``
stands for ``i`` rows read and the role written last; Keep, Rerole and Delete
read a row, Insert does not.  A bidirectional Dijkstra search runs from the
start and, over reversed edges, from the legal ends.  When the two heaps have
met, both go on until no crossing of equal cost can be left; of all cheapest
paths over these crossings, the one with the least audit is taken.  A letter
leads from a node to just one other, so the least audit is found letter by
letter, without writing any other audit down.

No task holds a whole conversation for that.  Rows are sorted over all tasks
by conversation and turn, and a conversation is cut where a task ends and
after ``SEGMENT_ROWS`` rows.  A segment of a conversation that was cut is
searched between each pair of states; the few costs per segment are combined
along the conversation, and each segment then follows its own part of the path.
Only digests and flags are sorted; texts are shuffled once, for the hash of
the repaired text, which streams through one task per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import SPACES, only
from voxmill.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

SEGMENT_ROWS = 2_048

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: nothing written yet, or the role written last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
# The state after a user or assistant turn of ours, whichever may follow.
_FORCED = [USER, USER, ASSISTANT, USER]
_BEFORE_FORCED = [[state for state in range(4) if _FORCED[state] == after] for after in range(4)]
_BEFORE = {
    initial: [[state for state in range(4) if _NEXT[state].get(initial) == after] for after in range(4)]
    for initial in "sua"
}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
# Turns to insert after the last row, by the state it leaves.
_END = {BEGIN: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}

FINE, BLANK, DUPLICATE, CUT = "0123"


# --- the search ---------------------------------------------------------------


def _steps(codes: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edges ``(letter, cost, i, state)`` out of a node, by letter."""
    if 2 * i >= len(codes):
        return []
    initial, fault = codes[2 * i], codes[2 * i + 1]
    found = [("D", DELETE, i + 1, state), ("I", INSERT, i, _FORCED[state])]
    if fault in (FINE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if (kept := _NEXT[state].get(initial)) is not None:
            found.append(("K", extra, i + 1, kept))
        found.append(("R", REROLE + extra, i + 1, _FORCED[state]))
    return found


def _steps_back(codes: str, i: int, state: int) -> list[tuple[int, int, int]]:
    """``(cost, i, state)`` of the nodes with an edge into this one."""
    found = []
    if 2 * i < len(codes):
        found.extend((INSERT, i, before) for before in _BEFORE_FORCED[state])
    if i:
        initial, fault = codes[2 * i - 2], codes[2 * i - 1]
        found.append((DELETE, i - 1, state))
        if fault in (FINE, CUT):
            extra = TRUNCATED if fault == CUT else 0
            if initial in _BEFORE:
                found.extend((extra, i - 1, before) for before in _BEFORE[initial][state])
            found.extend((REROLE + extra, i - 1, before) for before in _BEFORE_FORCED[state])
    return found


def least_audit(codes: str, start: int, ends: dict[int, int]) -> tuple[int, str, int] | None:
    """Cost, least audit and end state of the cheapest paths over the rows of ``codes``.

    ``codes`` has two characters a row: role initial and fault.  ``ends`` has the
    cost that follows each allowed end state.  None if no path leads there.
    """
    rows = len(codes) // 2
    ahead, back = {(0, start): 0}, {(rows, state): cost for state, cost in ends.items()}
    # Edges of no cost read a row, so among equal costs the earlier row comes first.
    forward = [(0, 0, start)]
    reverse = [(cost, -rows, state) for state, cost in ends.items()]
    heapify(reverse)
    done_ahead: set[tuple[int, int]] = set()
    done_back: set[tuple[int, int]] = set()
    best = ahead[0, start] + back[0, start] if (0, start) in back else float("inf")
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0][0] <= reverse[0][0]:
            cost, i, state = heappop(forward)
            if (i, state) in done_ahead:
                continue
            done_ahead.add((i, state))
            for _, more, k, then in _steps(codes, i, state):
                total = cost + more
                if total < ahead.get((k, then), float("inf")):
                    ahead[k, then] = total
                    heappush(forward, (total, k, then))
                    if (k, then) in back:
                        best = min(best, total + back[k, then])
        else:
            cost, i, state = heappop(reverse)
            i = -i
            if (i, state) in done_back:
                continue
            done_back.add((i, state))
            for more, k, then in _steps_back(codes, i, state):
                total = cost + more
                if total < back.get((k, then), float("inf")):
                    back[k, then] = total
                    heappush(reverse, (total, -k, then))
                    if (k, then) in ahead:
                        best = min(best, total + ahead[k, then])
    if best == float("inf"):
        return None
    # Up to here all distances are final, so each cheapest path goes through nodes known from the
    # start, one crossing edge, and nodes known from the end.
    far = forward[0][0] if forward else float("inf")
    near = reverse[0][0] if reverse else float("inf")
    from_end = {node: cost for node, cost in back.items() if cost < near or node[0] == rows}
    from_start = {node: cost for node, cost in ahead.items() if cost < far}
    leads: set[tuple[int, int]] = set()
    for (i, state), cost in sorted(from_start.items(), key=lambda item: (-item[1], -item[0][0])):
        for _, more, k, then in _steps(codes, i, state):
            crossing = cost + more + from_end.get((k, then), float("inf")) == best
            if crossing or ((k, then) in leads and from_start.get((k, then)) == cost + more):
                leads.add((i, state))
                break
    letters = []
    i, state = 0, start
    while 2 * i < len(codes):
        known, cost = from_end.get((i, state)), from_start.get((i, state))
        for letter, more, k, then in _steps(codes, i, state):
            if known is not None:
                onward = from_end.get((k, then), float("inf")) + more == known
            else:
                onward = cost + more + from_end.get((k, then), float("inf")) == best or (
                    (k, then) in leads and from_start.get((k, then)) == cost + more
                )
            if onward:
                letters.append(letter)
                i, state = k, then
                break
        else:
            raise RuntimeError("the search lost its path")
    return int(best), "".join(letters), state


def _whole(codes: str, start: int = BEGIN, end: int | None = None) -> tuple[int, str]:
    """Cost and audit up to the end of a conversation, closing inserts included."""
    cost, audit, state = least_audit(codes, start, _END if end is None else {end: _END[end]})
    return cost, audit + "I" * (_END[state] // INSERT)


# --- damage and faults --------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``(key, conv, turn, role, text, dropped)`` after the damage that the check value of a row stands for.

    Nulls of role and text, and in the check value those of id and turn, count
    as one space.  0 drops a row (it stays here as ``dropped``), 1 empties its
    text, 2 takes out its full stops, exclamation and question marks, 3 repeats
    it, 4 makes its role user.
    """
    rows = only(conversations, conv="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv").cast("long"),
        F.col("turn").cast("long"),
        *(F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")),
    )
    named = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv", "turn")]
    rows = rows.withColumn("_d", F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20)
    times = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = (
        F.when(F.col("_d").isin(0, 1), F.lit(""))
        .when(F.col("_d") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    return rows.select(
        F.concat(F.when(F.col("conv").isNull(), F.lit("-")).otherwise(F.lit("=")), named[0]).alias("key"),
        "conv",
        "turn",
        F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_d") == 0).alias("dropped"),
        F.explode(times).alias("_time"),
    ).drop("_time")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))).alias("digest")


def _cutter(segment_rows: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the rows of a task's conversations by segment and place."""
        part = TaskContext.get().partitionId()
        last, seg, pos = None, -1, 0
        for batch in batches:
            segs, places = [], []
            for key in batch.column(0).to_pylist():
                if key != last or pos + 1 == segment_rows:
                    last, seg, pos = key, seg + 1, 0
                else:
                    pos += 1
                segs.append(seg)
                places.append(pos)
            columns = [
                *batch.columns,
                pa.array([part] * len(segs), pa.int64()),
                pa.array(segs, pa.int64()),
                pa.array(places, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "seg", "pos"])

    return cut


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Rows ``(key, part, seg, codes, blank, duplicate, truncated)``, a segment each."""
    stripped = F.rtrim("text", F.lit(SPACES))
    last = F.substring(stripped, -1, 1)
    flagged = rows.select(
        "key",
        "turn",
        "role",
        _digest(),
        F.when(F.length(stripped) == 0, F.lit(BLANK)).when(last.isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(CUT)).alias("fault"),
        # Equal rows may be many: they go apart.
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest", "_salt"]
    initial = F.substring("role", 1, 1)
    small = (
        flagged.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("-")).alias("initial"), "fault")
    )
    names = "key string, digest binary, initial string, fault string, part long, seg long, pos int"
    small = cut_lineage(small.mapInArrow(_cutter(segment_rows), names))
    place = F.struct("part", "seg", "pos")
    seen = (
        small.where(F.col("fault") != BLANK)
        .groupBy("key", "digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", "digest", "first")
    )
    again = (F.col("fault") != BLANK) & F.coalesce(F.col("first") != place, F.lit(False))
    marked = small.join(seen, ["key", "digest"], "left").withColumn(
        "fault", F.when(again, F.lit(DUPLICATE)).otherwise(F.col("fault"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.concat("initial", "fault").alias("code"))))
    count = lambda fault, name: F.count_if(F.col("fault") == fault).alias(name)
    return marked.groupBy("key", "part", "seg").agg(
        F.array_join(F.transform(ordered, lambda row: row["code"]), "").alias("codes"),
        count(BLANK, "blank"),
        count(DUPLICATE, "duplicate"),
        count(CUT, "truncated"),
    )


# --- paths of segments --------------------------------------------------------


def _between_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost between each pair of states, and the order of the audits that begin alike (null: no path)."""
    for batch in batches:
        costs, ranks = [], []
        for codes in batch.column(3).to_pylist():
            cost: list[int | None] = [None] * 16
            rank: list[int | None] = [None] * 16
            for start in range(4):
                found = [(end, least_audit(codes, start, {end: 0})) for end in range(4)]
                audits = sorted((path[1], end) for end, path in found if path is not None)
                for end, path in found:
                    if path is not None:
                        cost[4 * start + end] = path[0]
                        rank[4 * start + end] = audits.index((path[1], end))
            costs.append(cost)
            ranks.append(rank)
        columns = [*batch.columns[:3], pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "part", "seg", "costs", "ranks"])


def best_states(costs: list[list[int | None]], ranks: list[list[int | None]]) -> list[tuple[int, int]]:
    """Start and end state of each segment on the cheapest path with the least audit."""
    after = [dict(_END)]
    for cost in reversed(costs):
        after.append(
            {
                start: min(
                    (c + after[-1][end] for end in range(4) if (c := cost[4 * start + end]) is not None and end in after[-1]),
                    default=float("inf"),
                )
                for start in range(4)
            }
        )
    after.reverse()
    state, found = BEGIN, []
    for k, (cost, rank) in enumerate(zip(costs, ranks, strict=True)):
        _, end = min(
            (rank[4 * state + end], end)
            for end in range(4)
            if (c := cost[4 * state + end]) is not None and c + after[k + 1][end] == after[k][state]
        )
        found.append((state, end))
        state = end
    return found


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's segments in order to the states each one goes between."""
    for batch in batches:
        out: list[tuple] = []
        for key, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            states = best_states([s["costs"] for s in segments], [s["ranks"] for s in segments])
            for number, (segment, (start, end)) in enumerate(zip(segments, states, strict=True), 1):
                out.append((key, segment["part"], segment["seg"], start, end, number == len(segments)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "part", "seg", "start", "end", "last"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of each segment."""
    for batch in batches:
        costs, audits = [], []
        told = zip(*(batch.column(name).to_pylist() for name in ("codes", "start", "end", "last")), strict=True)
        for codes, start, end, last in told:
            cost, audit = _whole(codes, start, end) if last else least_audit(codes, start, {end: 0})[:2]
            costs.append(cost)
            audits.append(audit)
        names = ["key", "part", "seg", "blank", "duplicate", "truncated"]
        columns = [*(batch.column(name) for name in names), pa.array(costs, pa.int64()), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "cost", "audit"])


_AUDITS = "key string, part long, seg long, blank long, duplicate long, truncated long, cost long, audit string"


def _audits(segments: DataFrame) -> DataFrame:
    counted = segments.groupBy("key").agg(F.count("*").alias("segments"))
    cut = counted.where("segments > 1").select("key")
    several = segments.join(cut, "key", "left_semi").select("key", "part", "seg", "codes")
    between = several.mapInArrow(_between_states, "key string, part long, seg long, costs array<long>, ranks array<int>")
    along = between.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "costs", "ranks"))).alias("segments"))
    states = "key string, part long, seg long, start int, end int, last boolean"
    placed = segments.join(along.mapInArrow(_combine, states), ["key", "part", "seg"], "left")
    placed = placed.withColumns(
        {"start": F.coalesce("start", F.lit(BEGIN)), "last": F.coalesce("last", F.lit(True))}
    )
    return placed.mapInArrow(_follow, _AUDITS)


# --- the repaired text --------------------------------------------------------


class _Conversation:
    """What a conversation's rows add up to, in order."""

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.audits: list[str] = []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, cost
        self.letters: str | None = None
        self.at, self.state, self.written = 0, BEGIN, False
        self.hash = hashlib.sha256()
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.initial: str | None = None

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.written else ''}{role}:{text}".encode())
        self.written = True

    def _ours(self, text: str) -> None:
        self.state = _FORCED[self.state]
        self._write(_ROLES[self.state], text)

    def _inserts(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self._ours("")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if self.letters is None:
            self.letters = "".join(self.audits)
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in _LEGAL
        self.initial = role[:1]
        self._inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = _NEXT[self.state][role[:1]]
            self._write(role, text)
        elif letter == "R":
            self._ours(text)

    def result(self) -> tuple:
        self.letters = "".join(self.audits) if self.letters is None else self.letters
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        blank, duplicate, truncated, cost = self.counts
        return (self.conv, gaps, blank, duplicate, truncated, self.illegal, cost, self.letters, self.hash.hexdigest())


_RESULT = {
    "conv_id": pa.int64(),
    **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()),
    "audit": pa.string(),
    "repaired_sha256": pa.string(),
}


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(_RESULT.values())]
        return pa.RecordBatch.from_arrays(columns, list(_RESULT))

    last, open_ = None, None
    for batch in batches:
        found = []
        names = ("key", "kind", "conv", "turn", "role", "text", "audit", "blank", "duplicate", "truncated", "cost")
        for key, kind, conv, turn, role, text, audit, *counts in zip(
            *(batch.column(name).to_pylist() for name in names), strict=True
        ):
            if key != last:
                if open_ is not None:
                    found.append(open_.result())
                last, open_ = key, _Conversation(conv)
            if kind == 0:
                open_.audits.append(audit)
                open_.counts = [a + b for a, b in zip(open_.counts, counts, strict=True)]
                continue
            open_.conv = conv
            if kind == 1:
                open_.row(turn, role, text)
        yield made(found)
    if open_ is not None:
        yield made([open_.result()])


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are damaged first (``damaged``) and then taken by turn, nulls first;
    rows of one turn go by role and then by digest.  A null id is a conversation
    of its own, rows that repeat a turn stay rows of their own, an empty or
    other role can be rewritten or deleted but not kept.  A conversation without
    rows after the damage has zeros, an empty audit and the empty text's hash.
    Other columns are left out.  One conversation's audit must fit in a task.
    """
    rows = damaged(conversations)
    audits = cut_lineage(_audits(cut_lineage(_segments(rows.where(~F.col("dropped")), segment_rows))))
    texts = rows.select(
        "key", F.when(F.col("dropped"), F.lit(2)).otherwise(F.lit(1)).alias("kind"), "conv", "turn", "role", "text", _digest()
    )
    both = audits.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    schema = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _RESULT.items())
    return (
        both.repartition("key")
        .sortWithinPartitions("key", "kind", "part", "seg", F.col("turn").asc_nulls_first(), "role", "digest")
        .mapInArrow(_results, schema)
    )
