"""License scans: short notices with a few errors, seeds first, bounded-error patterns after.

A notice of m characters may differ in k edits.  Cut into k + 1 seeds, one of
them stands unchanged in every match, so an automaton over all seeds finds the
places; there the pattern library matches the notice with at most k errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

# Phrases that are found as they are, and the word pattern.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

# Short notices that are also found with errors.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "permission is hereby granted free of charge to any person": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license": "gpl",
    "mozilla public license version 2 0": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
ERROR_SHARE = 0.12


def budget(notice: str) -> int:
    return max(1, int(len(notice) * ERROR_SHARE))


def seeds(notice: str) -> list[tuple[int, str]]:
    parts = budget(notice) + 1
    cuts = [len(notice) * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_LOWER))


class NoticeSearch:
    def __init__(self, notices: dict[str, str] = NOTICES) -> None:
        self.base = ahocorasick.Automaton()
        for phrase, label in BASE.items():
            self.base.add_word(f" {phrase} ", (len(phrase) + 2, label))
        self.base.make_automaton()
        self.notices = list(notices.items())
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, _) in enumerate(self.notices):
            for place, seed in seeds(notice):
                found.setdefault(seed, []).append((number, place))
        self.seeds = ahocorasick.Automaton()
        for seed, places in found.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={budget(notice)}}}") for notice, _ in self.notices
        ]

    def exact(self, joined: str) -> list[tuple[int, str]]:
        """``(character, label)`` of the base phrases."""
        return [(last + 1 - length, label) for last, (length, label) in self.base.iter(joined)]

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """``(start, end, notice, errors)``: best match around each seed hit, none twice."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.seeds.iter(joined):
            for number, place in places:
                room = budget(self.notices[number][0])
                start = last + 1 - length - place
                low, high = start - room, start + len(self.notices[number][0]) + room
                known = windows.setdefault(number, [])
                # Hits come by their end; near ones of a notice join into one window.
                if known and low <= known[-1][0] + room:
                    known[-1][0], known[-1][1] = min(low, known[-1][0]), max(high, known[-1][1])
                else:
                    known.append([low, high])
        found = set()
        for number, spans in windows.items():
            for low, high in spans:
                match = self.patterns[number].search(joined, max(0, low), min(len(joined), high))
                if match:
                    found.add((match.start(), match.end(), number, sum(match.fuzzy_counts)))
        return sorted(found)

    def scan(self, text: str) -> dict:
        words = words_of(text)
        joined = f" {' '.join(words)} " if words else ""
        exact = self.exact(joined)
        fuzzy = self.fuzzy(joined)
        places, at, word = {}, 0, 0
        for place in sorted({p for p, _ in exact} | {start for start, _, _, _ in fuzzy}):
            # The word that holds the character: one space stands before each word.
            word += joined.count(" ", at, place)
            places[place], at = word, place
        # A base phrase starts at the space before its first word.
        starts = [places[p] for p, _ in exact]
        base = {label for _, label in exact}
        labels = base | {self.notices[number][1] for _, _, number, _ in fuzzy}
        close = [1 - errors / len(self.notices[number][0]) for _, _, number, errors in fuzzy]
        spans = [
            f"{self.notices[number][1]}:{max(0, places[start] - (joined[start] != ' '))}:{errors}"
            for start, _, number, errors in fuzzy
        ]
        return {
            "n_words": len(words),
            "n_base": len(exact),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": 1.0 if exact else max(close, default=0.0),
            "spans": ",".join(spans),
        }


_FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string(),
}


def _scanner(notices: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices)
        for batch in batches:
            rows = [search.scan(text or "") for text in batch.column(1).to_pylist()]
            columns = [pa.array([row[name] for row in rows], kind) for name, kind in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_FIELDS])

    return scan


def notice_spans(documents: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: base phrases, labels, best score and ``spans``.

    ``spans`` lists ``label:first word:errors`` of the matched notices.  A null
    text is an empty one; every row stands for itself, repeated and null ids
    included.
    """
    texts = only(documents, id="doc_id", text="text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(
        _scanner(notices),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans string",
    )
