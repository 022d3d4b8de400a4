"""Token counts by byte-pair merging, without making a single id.

A word starts as a list of symbols.  Its adjacent pairs lie in a heap by merge
rank; the lowest is popped, its right symbol is unlinked from a doubly linked
list, and the two pairs that arise are pushed.  Each merge makes one symbol
less, so the count is symbols minus merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MEMO_CHUNKS = 400_000  # chunks a task remembers

# White space for Python, but not for the pattern of the vocabulary.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others follow from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (byte for byte in range(256) if byte not in plain)
    shifted = {byte: 256 + k for k, byte in enumerate(others)}
    return [chr(shifted.get(byte, byte)) for byte in range(256)]


class MergeCounter:
    """Counts the tokens of whole texts for a vocabulary file of merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        split = next(p for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = [re.escape(token["content"]) for token in told["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True)))
        self.chunks: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols minus merges of one word."""
        parts = [self.symbols[byte] for byte in word.encode()]
        parts[-1] += self.suffix
        count, ranks = len(parts), self.ranks
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        heap = [
            (rank, i, parts[i], parts[i + 1])
            for i in range(count - 1)
            if (rank := ranks.get((parts[i], parts[i + 1]))) is not None
        ]
        heapify(heap)
        total = count
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            # Stale: one of the two symbols has been merged since.
            if parts[i] != left or j >= total or parts[j] != right:
                continue
            parts[i] = left + right
            parts[j] = ""
            count -= 1
            k = after[i] = after[j]
            if k < total:
                before[k] = i
                if (rank := ranks.get((parts[i], parts[k]))) is not None:
                    heappush(heap, (rank, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get((parts[h], parts[i]))) is not None:
                heappush(heap, (rank, h, parts[h], parts[i]))
        return count

    def _chunk(self, chunk: str) -> int:
        found = sum(map(self.word, self.words.findall(chunk)))
        if len(self.chunks) >= MEMO_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower case goes character by character: no final sigma.
            text = text.replace("Σ", "σ")
        text = text.lower()
        if _SEPARATORS.search(text):
            return sum(map(self.word, self.words.findall(text)))
        total, known = 0, self.chunks
        for chunk in text.split():
            count = known.get(chunk)
            total += self._chunk(chunk) if count is None else count
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one."""
        total = at = 0
        for found in self.special.finditer(text):
            total += self.plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self.plain(text[at:] if at else text)


def _counter(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(path)
        for batch in batches:
            tokens = [counter.count(text) if text else 0 for text in batch.column(2).to_pylist()]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(documents: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, repeated ids included.

    A null text is an empty one and has no tokens; a null id stays null.
    ``vocabulary`` is a path that every executor can open.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    texts = only(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string"),
    )
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return texts.mapInArrow(_counter(path, limit), schema)
