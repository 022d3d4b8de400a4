"""Hierarchical packing of documents into training windows of several context sizes.

Each task packs the documents of its partition: no shuffle, and no more memory
than one block of tokens.  A document gives its full windows of the longest
context at once; the rest is routed to the tier of the smallest context that
holds it.  Windows are then opened by the longest rests and their gaps filled
from the tiers that fit, longest first; where none fits, the shortest rest is
cut.  What does not fill a window is carried to the next block and in the end
cut at powers of two, each a window of a shorter context.  So nothing is padded.
Windows of one context are dealt in turns, by attention cost, to step groups.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary
END = 1  # id that closes every document
CONTEXT = 2048
TIERS = tuple(CONTEXT >> k for k in range(12))  # 2048 to 1
BLOCK_TOKENS = 2_000_000  # packed together
GROUP = 8  # windows of one step group

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context long, step_group long"
)

# Beyond these the two libraries may know different versions of Unicode.
_LATIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")


class DocumentEncoder:
    """Ids of whole texts as the tokenizer file gives them.

    Plain Latin texts go through the library for merge ranks, which gives the
    same ids several times faster; all others, and those with special strings,
    through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([_LATIN.pattern, *special]))
        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ranks = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )

    def ids(self, text: str) -> list[int]:
        if self.other.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


class TierPacker:
    """Windows ``[(document, start, length), ...]`` out of documents of known length."""

    def __init__(self) -> None:
        self.tiers: dict[int, list[tuple[int, int, int]]] = {context: [] for context in TIERS}
        self.waiting = 0

    def route(self, length: int, document: int, start: int) -> None:
        context = 1 << (length - 1).bit_length()
        insort(self.tiers[context], (length, document, start))
        self.waiting += length

    def add(self, document: int, length: int) -> list[list[tuple[int, int, int]]]:
        """The document's full windows; its rest waits."""
        full = length // CONTEXT
        if rest := length % CONTEXT:
            self.route(rest, document, full * CONTEXT)
        return [[(document, k * CONTEXT, CONTEXT)] for k in range(full)]

    def _longest_within(self, room: int) -> tuple[int, int, int] | None:
        for context in TIERS:
            items = self.tiers[context]
            if context <= 2 * room and (k := bisect_right(items, (room + 1,)) - 1) >= 0:
                self.waiting -= items[k][0]
                return items.pop(k)
        return None

    def _cut_shortest(self, room: int) -> tuple[int, int, int]:
        context = next(c for c in reversed(TIERS) if self.tiers[c])
        length, document, start = self.tiers[context].pop(0)
        self.waiting -= length
        self.route(length - room, document, start + room)
        return room, document, start

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows of the longest context, as long as enough tokens wait."""
        while self.waiting >= CONTEXT:
            yield self._window(CONTEXT)

    def last_windows(self) -> Iterator[list[tuple[int, int, int]]]:
        for context in TIERS:
            while self.waiting >= context:
                yield self._window(context)

    def _window(self, context: int) -> list[tuple[int, int, int]]:
        window, room = [], context
        while room:
            length, document, start = self._longest_within(room) or self._cut_shortest(room)
            window.append((document, start, length))
            room -= length
        return window


def step_groups(windows: list[list[tuple[int, int, int]]], first: int) -> list[int]:
    """A group number for each window.

    Groups hold windows of one context, up to GROUP of them.  Windows in order
    of attention cost (the sum of squared piece lengths) are dealt to the
    groups forth and back, so that all groups cost about the same.
    """
    sizes = [sum(piece[2] for piece in window) for window in windows]
    costs = [sum(piece[2] ** 2 for piece in window) for window in windows]
    given = [0] * len(windows)
    for context in sorted(set(sizes), reverse=True):
        own = sorted((k for k in range(len(windows)) if sizes[k] == context), key=lambda k: (-costs[k], k))
        groups = -(-len(own) // GROUP)
        for turn, k in enumerate(own):
            lap, place = divmod(turn, groups)
            given[k] = first + (place if lap % 2 == 0 else groups - 1 - place)
        first += groups
    return given


def _packer(path: str, ranks: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = DocumentEncoder(path, ranks), TierPacker()
        base = TaskContext.get().partitionId() << 40
        documents: dict[int, tuple[int | None, np.ndarray]] = {}
        number = sequences = groups = 0
        names = [field.split()[0] for field in SCHEMA.split(", ")]

        def emit(windows: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequences, groups
            rows = []
            given = step_groups(windows, groups)
            for window, group in zip(windows, given, strict=True):
                offset, context = 0, sum(piece[2] for piece in window)
                for document, start, length in window:
                    doc_id, ids = documents[document]
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), base + sequences, offset, context, base + group))
                    offset += length
                sequences += 1
            groups = max(given, default=groups - 1) + 1
            waiting = {item[1] for items in packer.tiers.values() for item in items}
            for document in [d for d in documents if d not in waiting]:
                del documents[document]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names)

        ready: list[list[tuple[int, int, int]]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), END], "<u4")
                documents[number] = (doc_id, ids)
                ready += packer.add(number, len(ids))
                number, held = number + 1, held + len(ids)
                if held >= BLOCK_TOKENS:
                    yield emit(ready + list(packer.windows()))
                    ready, held = [], 0
        yield emit(ready + list(packer.last_windows()))

    return pack


def pack(documents: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: where the ids of a document lie and in which window.

    A null text is an empty one: its only id is the closing one.  Every row is
    a document of its own, also if ids repeat or are null.  An empty table has
    no windows.  ``tokenizer`` and ``ranks`` are files of one vocabulary, at
    paths that every executor can open.
    """
    packer = _packer(tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS))
    texts = only(documents, id="doc_id", text="text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(packer, SCHEMA)
