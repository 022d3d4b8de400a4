"""Batch ingest: landed payloads to raw and clean reviews."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.operators import cleaning, selection, views
from voxmill.session import cut_lineage
from voxmill.sources import feeds, files


@dataclass
class Ingest:
    raw: DataFrame
    clean: DataFrame

    def summary(self) -> DataFrame:
        return views.ingest_summary(self.raw, self.clean)

    def segments(self) -> DataFrame:
        return views.segment_counts(self.clean)

    def write(self, raw_path: str, clean_path: str, run_ts: str) -> None:
        """Append both batches, one folder per run."""
        stamp = F.lit(run_ts)
        files.write_reviews(self.raw.withColumn("run_ts", stamp), raw_path, ["run_ts"])
        files.write_reviews(self.clean.withColumn("run_ts", stamp), clean_path, ["run_ts"])


def ingest(
    now: Column,
    label_pages: DataFrame | None = None,
    store_rows: DataFrame | None = None,
    forum_pages: DataFrame | None = None,
    limit: int | None = None,
    hours: int = 24,
    lexicon: Mapping[str, Sequence[str]] = lex.SEGMENT_TERMS,
    memory: DataFrame | None = None,
) -> Ingest:
    """Normalise, de-duplicate, limit, clean and window the feeds that are there."""
    sources = [
        None if label_pages is None else feeds.label_feed_reviews(label_pages, now),
        None if store_rows is None else feeds.store_reviews(store_rows, now),
        None if forum_pages is None else feeds.forum_listing_reviews(forum_pages, now),
    ]
    raw = selection.first_seen(
        feeds.union_sources(*sources), ["source", "review_id"], "feed_pos"
    )
    if limit is not None:
        raw = selection.per_source_limit(raw, limit)
    # Written once: the anchor, the summary and the clean batch all read it.
    raw = cut_lineage(raw)
    cleaned = cleaning.clean(raw, lexicon, memory)
    return Ingest(raw, cleaning.anchored_window(cleaned, now, hours, anchors_from=raw))


def land_each(sources: Mapping[str, Callable[[], DataFrame]], folder: str, batch: str) -> list[tuple[str, str | None]]:
    """Write every source's reviews below ``<folder>/source=<name>``; a failing one stops no other.

    Sources are named makers, so that reading, parsing and writing of one all
    happen inside its own attempt.  Returns each name with its error, or None.
    ``batch`` names the batch: landing it again replaces its rows.
    """
    told = []
    for name, make in sources.items():
        try:
            rows = make().withColumn("batch", F.lit(batch))
            files.write_batch(rows, f"{folder}/source={name}", "batch")
        except (PySparkException, OSError, ValueError) as error:
            told.append((name, str(error).splitlines()[0]))
        else:
            told.append((name, None))
    return told
