"""Encoding through distinct words against the library, and the way back."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken

from voxmill.llm import byte_pairs
from voxmill.llm.queries import QUERIES
from voxmill.llm.shared import bounded_batches, read_table


@pytest.fixture(scope="module")
def library():
    ranks = byte_pairs.read_ranks(public_tokenizers.path(byte_pairs.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _expected(library, doc_id, text) -> tuple:
    ids = library.encode_ordinary(text or "")
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_query(spark, data_dir, library):
    rows = read_table(spark, data_dir, "documents").select("doc_id", "text").collect()
    found = QUERIES["op12_distinct_word_bpe"](spark, data_dir).collect()
    assert sorted(map(tuple, found)) == sorted(_expected(library, *row) for row in rows)


ODD = [
    (1, None), (2, ""), (3, " \n\t  "), (4, "the same words"), (4, "the same words"), (None, "no id, isn't it?"),
    (5, "a" * 300_000), (6, "wort " * 300_000), (7, "<|endoftext|> it's I'LL we'll     x\x1cy\x00"),
    (8, "1234567 ٣½ 你好 \U0001f469‍\U0001f680 é"), (9, "\r\n\r\n   end  "), (10, "   "),
]


@pytest.mark.parametrize("block_bytes", [byte_pairs.BLOCK_BYTES, 70])
def test_odd_rows(spark, library, block_bytes):
    schema = "doc_id long, text string, block long, word string, ids int"
    table = bounded_batches(spark).createDataFrame([(*row, 1, "x", 2) for row in ODD], schema).repartition(3, "doc_id")
    encoded = byte_pairs.encode(table, block_bytes=block_bytes)
    found = byte_pairs.digests(encoded).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((_expected(library, *row) for row in ODD), key=repr)
    back = [(r.doc_id, bytes(r.decoded).decode()) for r in byte_pairs.decode(encoded).collect()]
    assert sorted(back, key=repr) == sorted(((k, text or "") for k, text in ODD), key=repr)


def test_long_texts_in_slices(spark, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_pairs, "SLICE_WORDS", 3)
    words = byte_pairs.regex.compile(public_tokenizers.PATTERN)
    for _, text in ODD[5:]:
        numbers = byte_pairs._Numbers()
        codes = byte_pairs._codes(text, words, numbers)
        listed = list(numbers)
        assert [listed[c] for c in codes] == words.findall(text)


def test_empty_and_unknown(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.digests(byte_pairs.encode(table)).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.decoded) for r in byte_pairs.decode(rows).collect()} == {b""}
    strange = spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="an id has no token"):
        byte_pairs.decode(strange).collect()
