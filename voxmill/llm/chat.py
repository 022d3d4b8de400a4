"""Chat formatting: every assistant turn becomes an example of its own.

An example holds all turns before its target and the target; only the target's
text is trainable.  A conversation whose last turn is no assistant's has one
more example without a target, so no turn is lost.  Turns are marked with
control strings; where such a string stands in a text, a backslash is put into
it, and backslashes are doubled, so that the original can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

OPEN, CLOSE, TARGET = "<s>", "</s>", "assistant"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(r"((?:\\.|[^\\\n])*)\n", re.DOTALL)
BATCH_CHARS = 4_000_000

EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, last boolean"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The marked turn and where its text lies in it."""
    head = f"{OPEN}{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text or "")
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of every turn of a formatted example."""
    for part in formatted.split(CLOSE)[:-1]:
        head = _HEAD.match(part, len(OPEN))
        yield unescape(head[1]), unescape(part[head.end() :])


def _expander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples out of rows ``(conv_id, role, text)`` in order; conversations may cross batches."""
    names = [field.split()[0] for field in EXAMPLES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    rows: list[tuple] = []
    size = 0
    current: int | None = None
    turns: list[str] = []
    chars = examples = 0
    waiting: tuple[int, int] | None = None  # the target of the newest turn, if it is one
    begun = False

    def example(last: bool) -> None:
        nonlocal size, examples
        start, end = waiting or (None, None)
        rows.append((current, examples, len(turns), "".join(turns), start, end, last))
        examples += 1
        size += chars

    def batch() -> pa.RecordBatch:
        nonlocal rows, size
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        made = pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names
        )
        rows, size = [], 0
        return made

    for found in batches:
        for conv_id, role, text in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True):
            if not begun or conv_id != current:
                if begun:
                    example(last=True)
                current, turns, chars, examples, waiting, begun = conv_id, [], 0, 0, None, True
            elif waiting:
                example(last=False)
            marked, start, end = format_turn(role, text)
            waiting = (chars + start, chars + end) if role == TARGET else None
            turns.append(marked)
            chars += len(marked)
            if size >= BATCH_CHARS:
                yield batch()
    if begun:
        example(last=True)
    yield batch()


def expand(conversations: DataFrame) -> DataFrame:
    """The examples of all conversations, those of one conversation together and in order.

    Turns are ordered by ``turn``, then role and text, nulls first; null roles
    and texts count as empty.  Rows without ``conv_id`` are one conversation.
    ``loss_start`` and ``loss_end`` mark the trainable text in ``text`` (null:
    none); ``last`` marks the example that holds the whole conversation.
    A task streams its conversations and holds one of them, not more.
    """
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_expander, EXAMPLES)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    loss, loss_chars, formatted, examples = hashlib.sha256(), 0, 0, 0
    for found in batches:
        rows = []
        for conv_id, text, start, end, last in zip(*(found.column(k).to_pylist() for k in range(5)), strict=True):
            formatted += len(text)
            examples += 1
            if start is not None:
                target = unescape(text[start:end])
                loss.update(target.encode())
                loss_chars += len(target)
            if last:
                turns, count = hashlib.sha256(), 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    count += 1
                rows.append((conv_id, count, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted, examples))
                loss, loss_chars, formatted, examples = hashlib.sha256(), 0, 0, 0
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names
        )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``expand``'s examples in their order."""
    return examples.select("conv_id", "text", "loss_start", "loss_end", "last").mapInArrow(
        _reader,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_examples long",
    )
