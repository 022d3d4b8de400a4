"""Several streams side by side, each by itself: a failing one stops no other."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

Start = Callable[[], StreamingQuery]


@dataclass
class Fate:
    """How a stream ended: its error, if any, and how often it was started again."""

    source: str
    error: str | None
    restarts: int


def _short(error: BaseException) -> str:
    return str(error).strip().splitlines()[0] if str(error).strip() else type(error).__name__


def run_each(spark: SparkSession, starts: Mapping[str, Start], restarts: int = 0, poll_seconds: int = 10) -> list[Fate]:
    """Start every source's stream and watch them until all have ended.

    Each source has a query and a checkpoint of its own, so none waits for
    another and a failure is one source's alone.  A stream that fails is started
    again from its checkpoint up to ``restarts`` times; then its error is told
    and the others go on.  A stream that cannot even be started counts as failed.
    """
    fates = {source: Fate(source, None, 0) for source in starts}
    running: dict[str, StreamingQuery] = {}

    def start(source: str) -> None:
        while True:
            try:
                running[source] = starts[source]()
                return
            except (PySparkException, OSError, ValueError) as error:
                if not failed(source, error):
                    return

    def failed(source: str, error: BaseException) -> bool:
        """Whether the source is to be started again."""
        running.pop(source, None)
        fate = fates[source]
        if fate.restarts < restarts:
            fate.restarts += 1
            return True
        fate.error = _short(error)
        return False

    for source in starts:
        start(source)
    while running:
        for source, query in list(running.items()):
            if query.isActive:
                continue
            if (error := query.exception()) is None:
                del running[source]
            elif failed(source, error):
                start(source)
        if running:
            _wait(spark, poll_seconds)
    return list(fates.values())


def _wait(spark: SparkSession, seconds: int) -> None:
    """Until any stream ends, at most some seconds."""
    try:
        spark.streams.awaitAnyTermination(seconds)
    except PySparkException:
        pass  # told by the stream itself
    spark.streams.resetTerminated()
