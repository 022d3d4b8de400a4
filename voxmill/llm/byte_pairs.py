"""Byte-level BPE of whole texts through their distinct words.

Encoding
1. A task cuts its texts into pre-tokens and numbers the distinct ones, block
   by block (about ``BLOCK_BYTES`` of text).  A text is then a list of numbers,
   its pre-tokens by position.  So a word has one row per block, however often
   it stands there: the most frequent word is no hot key.
2. The words of all blocks are shuffled by word, and each distinct word is
   encoded once.  Its ids go back to every block that has it.
3. Blocks meet their words' ids (join by block) and put them in the places of
   the words.

Decoding joins the ids with the table of token bytes.  That table is as long
as the vocabulary, so every task holds it and no id is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 32 << 20  # text of one block; a longer text is a block of its own
LONG_TEXT = 1 << 20  # characters from which a text's words are taken in slices
SLICE_WORDS = 200_000
REPLY_WORDS = 200_000  # words of one task that are sent back together
OUT_ROWS = 500

_FRAMES = "block long, doc_ids array<long>, word_counts array<int>, n_codes int, codes binary, n_words int"
_WORDS = "block long, words array<string>"
_REPLIES = "block long, nos binary, lengths binary, ids binary"
_ENCODED = "doc_id long, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class _Numbers(dict):
    """Word to its number by first appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _codes(text: str, words: regex.Pattern, numbers: _Numbers) -> np.ndarray:
    if len(text) < LONG_TEXT:
        return np.array(list(map(numbers.__getitem__, words.findall(text))), np.uint32)
    parts, some = [], []
    for found in words.finditer(text):
        some.append(numbers[found.group()])
        if len(some) == SLICE_WORDS:
            parts.append(np.array(some, np.uint32))
            some = []
    return np.concatenate([*parts, np.array(some, np.uint32)])


def _packed(codes: np.ndarray) -> bytes:
    """Codes by byte plane, compressed: the upper planes are nearly constant."""
    planes = np.ascontiguousarray(codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view(np.uint32).ravel()


def _splitter(pattern: str, block_bytes: int, frames: bool):
    """Blocks of texts as their numbered words (``frames``), or the words of each block."""

    def block_id(index: int, numbers: _Numbers) -> int:
        # The words belong to the id: two runs over rows in another order can never be mixed up.
        digest = xxhash.xxh64(f"{TaskContext.get().partitionId()} {index}")
        for word in numbers:
            digest.update(word)
            digest.update(b"\xff")
        return digest.intdigest() - (1 << 63)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = regex.compile(pattern)
        index, size = 0, 0
        numbers, ids, codes = _Numbers(), [], []

        def block() -> pa.RecordBatch:
            key = pa.array([block_id(index, numbers)], pa.int64())
            if not frames:
                listed = pa.array([list(numbers)], pa.list_(pa.string()))
                return pa.RecordBatch.from_arrays([key, listed], ["block", "words"])
            columns = [
                key,
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(c) for c in codes]], pa.list_(pa.int32())),
                pa.array([sum(map(len, codes))], pa.int32()),
                pa.array([_packed(np.concatenate(codes))], pa.binary()),
                pa.array([len(numbers)], pa.int32()),
            ]
            names = ["block", "doc_ids", "word_counts", "n_codes", "codes", "n_words"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                found = _codes(text, words, numbers)
                if frames:
                    ids.append(doc_id)
                    codes.append(found)
                size += len(text) + 64
                if size >= block_bytes:
                    yield block()
                    index, size = index + 1, 0
                    numbers, ids, codes = _Numbers(), [], []
        if size:
            yield block()

    return split


def _encoder(path: str, pattern: str):
    """Ids of each word of rows sorted by word; a word is encoded when it first comes."""

    def replies(words: list[bytes], blocks: list[np.ndarray], nos: list[np.ndarray], size: int) -> pa.RecordBatch:
        """One row per block: the numbers of its words, how many ids each has, and the ids."""
        block, no = np.concatenate(blocks), np.concatenate(nos)
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        rows = []
        for start, end in zip(starts, [*starts[1:], len(block)], strict=True):
            places = order[start:end]
            found = [words[k] for k in places]
            lengths = np.array([len(ids) // size for ids in found])
            lengths = lengths.astype(np.min_scalar_type(int(lengths.max())))
            rows.append((int(block[start]), no[places].tobytes(), lengths.tobytes(), b"".join(found)))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["block", "nos", "lengths", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        kind = np.min_scalar_type(max(ranks.values()))
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        last, packed = None, b""
        words, blocks, nos = [], [], []
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, packed = word, np.array(encoding._encode_single_piece(word), kind).tobytes()
                words.append(packed)
            blocks.append(batch.column(1).to_numpy())
            nos.append(batch.column(2).to_numpy())
            if len(words) >= REPLY_WORDS:
                yield replies(words, blocks, nos, kind.itemsize)
                words, blocks, nos = [], [], []
        if words:
            yield replies(words, blocks, nos, kind.itemsize)

    return encode


def _ids_by_number(replies: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each word number start, how many they are, and all ids."""
    nos, lengths, ids = [], [], []
    for no, long, found in zip(*(replies.column(name).to_pylist() for name in ("nos", "lengths", "ids")), strict=True):
        nos.append(np.frombuffer(no, np.int32))
        lengths.append(np.frombuffer(long, f"u{len(long) // len(nos[-1])}").astype(np.int64))
        ids.append(np.frombuffer(found, f"u{len(found) // int(lengths[-1].sum())}"))
    no = np.concatenate([np.empty(0, np.int32), *nos])
    if len(no) != count or len(np.unique(no)) != count:
        raise RuntimeError("a block came with the words of another run: the rows' order must not change between reads")
    long = np.concatenate([np.empty(0, np.int64), *lengths])
    starts, sizes = np.empty(count, np.int64), np.empty(count, np.int64)
    starts[no], sizes[no] = np.cumsum(long) - long, long
    return starts, sizes, np.concatenate([np.empty(0, np.uint8), *ids])


def _reassemble(frame: pa.Table, replies: pa.Table) -> pa.Table:
    """The ids of a block's texts: those of each word, in the places of the word."""
    if frame.num_rows != 1:
        raise RuntimeError(f"{frame.num_rows} frames for a block: the rows' order must not change between reads")
    told = frame.to_pylist()[0]
    starts, sizes, flat = _ids_by_number(replies, told["n_words"])
    codes = _unpacked(told["codes"], told["n_codes"])
    counts = np.array(told["word_counts"], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts)])]
    values = np.empty(ends[-1], np.int32)
    at = 0
    for row, count in enumerate(counts.tolist()):
        words = codes[at : at + count]
        at += count
        after = np.cumsum(sizes[words])
        places = np.repeat(starts[words] - (after - sizes[words]), sizes[words])
        values[ends[row] : ends[row + 1]] = flat[places + np.arange(len(places))]
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
    rows = pa.Table.from_arrays([pa.array(told["doc_ids"], pa.int64()), ids], ["doc_id", "ids"])
    return pa.Table.from_batches(rows.to_batches(max_chunksize=OUT_ROWS))


def encode(
    documents: DataFrame,
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, ids`` of every row: each match of ``pattern`` encoded by itself by the rank file.

    A null text counts as empty and has no ids; a null id stays null, rows that
    repeat an id stay rows of their own, other columns are left out.
    ``documents`` is read twice and must give its rows in the same order, as
    every scan does; rows that do not raise an error.  ``ranks`` is a path that
    every executor can open.  One text must fit in a task.
    """
    path = ranks or public_tokenizers.path(VOCABULARY)
    texts = only(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    words = (
        texts.mapInArrow(_splitter(pattern, block_bytes, frames=False), _WORDS)
        .select("block", F.posexplode("words").alias("no", "word"))
        .select("word", "block", "no")
    )
    replies = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoder(path, pattern), _REPLIES)
    frames = texts.mapInArrow(_splitter(pattern, block_bytes, frames=True), _FRAMES)
    return frames.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_reassemble, _ENCODED)


def token_bytes(path: str) -> pa.Array:
    """The table of token bytes, by id; an id without a token has null."""
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def _joined(ids: pa.ListArray, table: pa.Array) -> Iterator[memoryview]:
    """The tokens of each list, one after the other."""
    for row in range(len(ids)):
        values = ids[row].values
        if values is None or len(values) == 0:
            yield memoryview(b"")
            continue
        bounds = pc.min_max(values).as_py()
        if bounds["min"] < 0 or bounds["max"] >= len(table) or (found := table.take(values)).null_count:
            raise ValueError("an id has no token")
        offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1 + found.offset)
        yield memoryview(found.buffers()[2])[offsets[found.offset] : offsets[-1]]


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            decoded = pa.array([bytes(b) for b in _joined(batch.column(1), table)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded], ["doc_id", "decoded"])

    return decode


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id, decoded`` of rows ``doc_id, ids``: the bytes of the tokens, joined from the token table.

    Null or empty ids give no bytes.  An id that the table does not have is an error.
    """
    path = ranks or public_tokenizers.path(VOCABULARY)
    rows = only(encoded, doc_id="doc_id", ids="ids").select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(_decoder(path), "doc_id long, decoded binary")


def _digester(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        decimal = pa.array([f"{id_},".encode() for id_ in range(len(table))], pa.large_binary())
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids = batch.column(1)
            columns = [
                batch.column(0),
                ids.value_lengths().fill_null(0).cast(pa.int64()),
                pa.array([sha(text[:-1]) for text in _joined(ids, decimal)], pa.string()),
                pa.array([sha(data) for data in _joined(ids, table)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digests(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode``'s rows; the bytes as ``decode`` gives them."""
    path = ranks or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded.select("doc_id", "ids").mapInArrow(_digester(path), schema)
