"""Secret scans: multipart credentials, linked by an interval join of their parts.

Strong parts have a form of their own and are always reported.  Weak parts (an
account name, a random-looking string, an address) are everywhere in clean
text; they are reported only where the complementary parts of one credential
lie in the same scope: between two blank lines and at most ``REACH`` code
points apart.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 300
MIN_ENTROPY = 3.5  # bits a character of a random-looking string

# The forms of strong parts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(
    r"""(?<![A-Za-z0-9])(?:[A-Za-z][A-Za-z0-9+]{1,15}://[^\s"'<>]+"""
    r"""|(?:endpoint|host|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, int]  # start, kind, end


def strong_parts(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _random_looking(part: str) -> bool:
    if not (re.search("[0-9]", part) and re.search("[a-z]", part) and re.search("[A-Z]", part)):
        return False
    counts = [part.count(c) for c in set(part)]
    return -sum(n / len(part) * log2(n / len(part)) for n in counts) >= MIN_ENTROPY


def weak_parts(text: str) -> list[Span]:
    found = [(m.start(), 4, m.end()) for m in RANDOM.finditer(text) if _random_looking(m[0])]
    if ":" in text or "=" in text:
        found += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return found


class _Near:
    """Which scopes hold a part within reach of a place: parts sorted, two searches each."""

    def __init__(self, parts: list[Span], scopes: list[int]) -> None:
        self.parts = sorted(parts)
        self.starts = [part[0] for part in self.parts]
        self.longest = max((part[2] - part[0] for part in self.parts), default=0)
        self.scopes = scopes

    def to(self, part: Span) -> bool:
        """Is another part near that does not lie over this one?"""
        scope = bisect_right(self.scopes, part[0])
        first = bisect_left(self.starts, part[0] - REACH - self.longest)
        for other in self.parts[first : bisect_right(self.starts, part[2] + REACH)]:
            apart = other[2] <= part[0] or other[0] >= part[2]
            if apart and other[2] >= part[0] - REACH and bisect_right(self.scopes, other[0]) == scope:
                return True
        return False


def linked_parts(text: str, strong: list[Span]) -> list[Span]:
    """The weak parts that complementary parts near them support.

    An identifier needs a secret, a secret an identifier or an endpoint, an
    endpoint both.  A weak part that lies over a strong one says nothing new.
    """
    weak = weak_parts(text)
    if not weak:
        return []
    scopes = [m.start() for m in BLANK_LINE.finditer(text)]
    covered = _Cover(strong)
    weak = [part for part in weak if not covered.meets(part)]
    identifiers = _Near([p for p in strong if p[1] == 1] + [p for p in weak if p[1] == 3], scopes)
    secrets = _Near([p for p in strong if p[1] != 1] + [p for p in weak if p[1] == 4], scopes)
    endpoints = _Near([p for p in weak if p[1] == 5], scopes)
    needed = {
        3: lambda part: secrets.to(part),
        4: lambda part: identifiers.to(part) or endpoints.to(part),
        5: lambda part: secrets.to(part) and identifiers.to(part),
    }
    return [part for part in weak if needed[part[1]](part)]


class _Cover:
    """Spans joined into disjoint ones, to ask whether a span meets any."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2]) - 1
        return k >= 0 and self.ends[k] > span[0]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Strong parts and all parts, each by start, then kind."""
    strong = strong_parts(text)
    return sorted(strong), sorted(strong + linked_parts(text, strong))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of parts replaced by the kind of its first part."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(text) if text else ([], []) for text in batch.column(1).to_pylist()]
        counts = [[sum(part[1] == kind for part in strong) for strong, _ in rows] for kind in range(3)]
        digests = [hashlib.sha256(told(strong).encode()).hexdigest() for strong, _ in rows]
        columns = [
            batch.column(0),
            *(pa.array(column, pa.int64()) for column in counts),
            pa.array(digests, pa.string()),
            pa.array([told(every) for _, every in rows], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(
            columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        )


def secret_spans(documents: DataFrame) -> DataFrame:
    """One row per document: counts of strong parts, their digest, and all spans.

    A null text is an empty one; every row stands for itself, repeated and null
    ids included.
    """
    texts = only(documents, id="doc_id", text="text").select(F.col("id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(
        _scanner, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: redact(text, scan(text)[1]) if text else text)


def redact_secrets(documents: DataFrame) -> DataFrame:
    """All documents and columns; the secrets in ``text`` give way to the name of their kind.

    ``n_chars``, where there is such a column, follows the text.
    """
    out = documents.withColumn("text", _redacted(F.col("text").cast("string")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)
        )
    return out
