"""Streams with state of their own: caps per source, and rows that wait for their time."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

BUCKETS = 64

# --- caps ---------------------------------------------------------------------


def _first_rows(limit: int, position: str, keys: Sequence[str]):
    def least(rows: pd.DataFrame) -> pd.DataFrame:
        """The first ``limit`` rows of each key by position."""
        ordered = rows.sort_values(position, kind="stable")
        return ordered.groupby(list(keys), sort=False, dropna=False).head(limit)

    return least


def cap_in_state(
    rows: DataFrame,
    limit: int,
    position: str,
    keys: Sequence[str] = ("source",),
    until: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """At most ``limit`` rows per key over all batches of a stream, the first ones by arrival.

    Rows of one batch go by ``position``.  The state is one number per key, so
    no earlier output is read, and a stream that is started again from its
    checkpoint goes on counting.  Every task first cuts its rows to ``limit`` per
    key: what meets in a task is at most that per task before, however hot the
    key.  With ``until``, a time at which a key's period ends (the same for all
    its rows, a key column itself or a function of one), the number is forgotten
    once the watermark has passed it; rows that come after that are dropped as
    late, as everywhere in a stream.  A period without an end is never forgotten.
    """
    least = _first_rows(limit, position, keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            kept = least(batch if kept is None else pd.concat([kept, batch], ignore_index=True))
        if kept is not None:
            yield kept

    def accept(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        kept: pd.DataFrame | None = None
        for part in parts:
            both = part if kept is None else pd.concat([kept, part], ignore_index=True)
            kept = both.sort_values(position, kind="stable").head(max(limit - used, 0))
        if kept is None:
            return
        if until is not None and len(part) and pd.notna(part[until].iloc[0]):
            end = int(part[until].iloc[0].tz_localize("UTC").timestamp() * 1000)
            if end > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end)
        state.update((used + len(kept),))
        if len(kept):
            yield kept

    timeout = GroupStateTimeout.NoTimeout if until is None else GroupStateTimeout.EventTimeTimeout
    cut_first = rows.mapInPandas(cut, rows.schema)
    if until is not None:
        cut_first = cut_first.withWatermark(until, delay)
    return cut_first.groupBy(*keys).applyInPandasWithState(accept, rows.schema, "used long", "append", timeout)


# --- rows ahead of the clock --------------------------------------------------

KEPT, LATE, HELD, RELEASED = "kept", "late", "held", "released"
_WAITING = "row string, at long, arrived long, tick boolean, bucket int"
_TOLD = "kind string, row string"


def hold_future(
    rows: DataFrame, row_id: str, at: str, arrived: str, frame_seconds: int, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of a stream with what becomes of them: the columns of ``rows`` and ``kind``.

    The clock of the stream is the latest ``arrived`` of all rows so far, this
    batch included; the watermark is the clock before this batch less
    ``frame_seconds``.  A row with ``at`` behind the watermark is ``late``.  One
    ahead of the clock is ``held``: it waits in the state, and comes again as
    ``released`` when the clock has reached its time.  All others, and those
    without ``at``, are ``kept``.  So every row is late, kept or held once, and
    what was held and not released is still in the state.

    State is split by ``row_id`` into ``buckets`` keys, so no source is a hot
    key; every task tells each bucket how far its clock is.
    """
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    whole = F.to_json(F.struct(*(F.col(f"`{name}`") for name in rows.columns)), micros)
    time = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    flat = rows.select(
        whole.alias("row"),
        time(at).alias("at"),
        time(arrived).alias("arrived"),
        F.lit(False).alias("tick"),
        F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("int").alias("bucket"),
    )

    def ticking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock = None
        for batch in batches:
            seen = batch["arrived"].max()
            if pd.notna(seen):
                clock = int(seen) if clock is None else max(clock, int(seen))
            yield batch
        if clock is not None:
            ticks = {"row": None, "at": None, "arrived": clock, "tick": True, "bucket": range(buckets)}
            yield pd.DataFrame(ticks).astype({"at": "Int64", "row": object})

    def sort_out(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        now, fresh = before, []
        for part in parts:
            for row, due, seen, tick in zip(part["row"], part["at"], part["arrived"], part["tick"], strict=True):
                if pd.notna(seen):
                    now = int(seen) if now is None else max(now, int(seen))
                if not tick:
                    fresh.append((None if pd.isna(due) else int(due), row))
        told = []
        still = []
        for due, row in waiting:
            if due <= now:
                told.append((RELEASED, row))
            else:
                still.append((due, row))
        for due, row in fresh:
            if due is not None and before is not None and due < before - frame_seconds * 1_000_000:
                told.append((LATE, row))
            elif due is not None and now is not None and due > now:
                told.append((HELD, row))
                still.append((due, row))
            else:
                told.append((KEPT, row))
        state.update((json.dumps([now, still]),))
        if told:
            yield pd.DataFrame(told, columns=["kind", "row"])

    sorted_out = (
        flat.mapInPandas(ticking, _WAITING)
        .groupBy("bucket")
        .applyInPandasWithState(sort_out, _TOLD, "waiting string", "append", GroupStateTimeout.NoTimeout)
    )
    parsed = F.from_json("row", T.StructType(rows.schema.fields), micros)
    return sorted_out.select("kind", parsed.alias("row")).select("kind", "row.*")


def fates(told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``hold_future`` told of each row so far, one kind per row: ``kept``, ``late``, ``held`` or ``released``."""
    last = F.when(F.bool_or(F.col("kind") == RELEASED), F.lit(RELEASED)).otherwise(F.first("kind"))
    return told.groupBy(*keys).agg(last.alias("kind"))
