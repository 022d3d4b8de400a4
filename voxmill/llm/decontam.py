"""Benchmark decontamination: pigeonhole pieces find places, bit-parallel distance decides.

Items and texts are compared as lower-case words with single spaces.  An item
of m characters may differ in k = m * ERROR_SHARE edits.  Cut into k + 1
pieces, at least one piece stands in a match unchanged, so an automaton over all
pieces finds every place worth a look; there Myers' bit-vectors give the edit
distance of the item to the best stretch of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

ERROR_SHARE = 0.06
BLOCK_CHARS = 500_000  # of items searched in one pass over the texts
_BETWEEN = re.compile(r"[\W_]+")

SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def normal(text: str) -> str:
    """Lower-case words with one space between, before and behind them."""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


def budget(item: str) -> int:
    return int(len(item) * ERROR_SHARE)


def pieces(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of about equal length, with their places."""
    parts = budget(item) + 1
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of the text, and where the first such ends."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down = full, 0
    score = best = len(item)
    end = 0
    for j, c in enumerate(text):
        match = masks.get(c, 0)
        across = ((((match & up) + up) ^ up) | match | down) & full
        plus = (down | ~(across | up)) & full
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = (minus | ~((match | down) | plus)) & full
        down = plus & (match | down)
        if score < best:
            best, end = score, j + 1
    return best, end


class PieceSearch:
    """All items of one block, searched at once."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            for place, piece in pieces(item):
                found.setdefault(piece, []).append((number, place))
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """``(item id, distance, start, end)``: the best stretch for each item within its budget."""
        windows: dict[int, set[int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for number, place in places:
                windows.setdefault(number, set()).add(last + 1 - length - place)
        for number, starts in sorted(windows.items()):
            item_id, item = self.items[number]
            room = budget(item)
            best = None
            seen = None
            for start in sorted(starts):
                # Hits along one alignment share a window.
                if seen is not None and start - seen <= room:
                    continue
                seen = start
                low = max(0, start - 2 * room)
                window = text[low : max(0, start) + len(item) + 3 * room + 1]
                distance, end = best_end(item, window)
                if distance <= room and (best is None or distance < best[0]):
                    back, length = best_end(item[::-1], window[:end][::-1])
                    best = (distance, low + end - length, low + end)
                    if distance == 0:
                        break
            if best is not None:
                yield item_id, *best


def _searcher(items: list[tuple[int, str]]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = PieceSearch(items)
        names = ["doc_id", "item_id", "distance", "start", "end"]
        for batch in batches:
            rows = [
                (doc_id, *match)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if text
                for match in block.matches(normal(text))
            ]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names)

    return search


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of at most BLOCK_CHARS (or one item)."""
    rows = only(benchmark, item_id="item_id", text="text").where("text IS NOT NULL AND item_id IS NOT NULL")
    block, size = [], 0
    for row in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        item = normal(row["text"])
        if not item.strip():
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    if block:
        yield block


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows ``doc_id, item_id, distance, start, end``: an item and its best stretch in a text.

    ``start`` and ``end`` count characters of the normalised text.  Each block
    of items is one pass over the texts, so memory is bounded whatever the
    number of items.  Null texts, null or empty items match nothing; an item id
    on several rows can match once for each; repeated documents are each
    searched.  Items of less than ``1 / ERROR_SHARE`` characters match exactly.
    """
    texts = only(documents, id="doc_id", text="text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    found = texts.sparkSession.createDataFrame([], SCHEMA)
    for block in item_blocks(benchmark):
        found = found.unionByName(texts.mapInArrow(_searcher(block), SCHEMA))
    return found


def _flagger(items: list[tuple[int, str]]):
    @F.pandas_udf(BooleanType())
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = PieceSearch(items)
        for texts in batches:
            yield texts.map(lambda text: bool(text) and any(block.matches(normal(text)))).astype(bool)

    return flag


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, with all their columns."""
    for block in item_blocks(benchmark):
        documents = documents.where(~_flagger(block)(F.col("text").cast("string")))
    return documents
