"""Near duplicates against all pairs."""

from __future__ import annotations

import random

import plain
import pytest

from voxmill.llm import neardup
from voxmill.llm.shared import bounded_batches, read_table


def _near_copies(groups: int, copies: int, seed: int) -> dict[int, str]:
    drawn = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts, number = {}, 0
    for _ in range(groups):
        base = drawn.choices(words, k=drawn.randint(3, 60))
        for _ in range(copies):
            copy = list(base)
            for _ in range(drawn.choice([0, 0, 1, 1, 2, 4])):
                copy[drawn.randrange(len(copy))] = drawn.choice(words)
            texts[number] = " ".join(copy)
            number += 1
    return texts


def _compare(spark, texts, size):
    table = bounded_batches(spark).createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table, size).collect()}
    sets = plain.sets_of(texts, size)
    named = plain.components(sets)
    assert found == {key: (len(sets[key]), named[key], named[key] == key) for key in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_small_groups(spark, size):
    _compare(spark, _near_copies(30, 6, size), size)


def test_one_large_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    texts = _near_copies(1, 150, 5)
    texts |= {1000 + key: text for key, text in _near_copies(20, 4, 6).items()}
    _compare(spark, texts, 2)


def test_table_against_all_pairs(spark, data_dir):
    documents = read_table(spark, data_dir, "documents")
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    _compare(spark, texts, 2)


def test_agreement_counts_equal_bytes(spark):
    rows = [([1, 2, 3, 256] * 8, [1, 2, 4, 512] * 8), ([-1] * 32, [-1] * 32), ([0] * 32, [128] * 32)]
    table = spark.createDataFrame(rows, "a array<int>, b array<int>")
    found = table.select(neardup._agreeing(neardup._packed(table.a), neardup._packed(table.b)).alias("n")).collect()
    assert [r.n for r in found] == [24, 32, 0]
