"""Batch analytics: clean reviews to clusters, themes and a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.operators import cleaning, density, themes, vectors
from voxmill.operators.joins import lookup_join
from voxmill.session import cut_lineage, scratch


@dataclass
class Analysis:
    members: DataFrame  # reviews with cluster_id and theme_name
    report: DataFrame  # one row per cluster


def analyse(
    reviews: DataFrame,
    min_size: int = 2,
    embedding: str | None = None,
    lexicon: Mapping[str, Sequence[str]] = lex.THEME_TERMS,
    noise_count: int = 2,
    noise_chars: int = 100,
    proposed: DataFrame | None = None,
) -> Analysis:
    """Vectorise, reduce, cluster and name the reviews.

    ``embedding`` names a column of given vectors; without it the contents are
    turned into TF-IDF vectors.  ``proposed`` may bring names and actions from
    outside (``themes.apply_synthesis``); the rules fill what it leaves open.
    """
    with scratch(reviews.sparkSession) as hand_over:
        kept = cleaning.clusterable(reviews).withColumn("position", F.monotonically_increasing_id())
        kept = cut_lineage(kept)  # fixes the positions
        if embedding:
            with_vectors = vectors.with_vector(kept, embedding)
        else:
            with_vectors = vectors.vectorize(kept, "position", "content")
        # Written once: the axes take several passes over the vectors, the projection one more.
        points = vectors.reduce_dimensions(cut_lineage(with_vectors.select("position", "vector")))
        labels = density.cluster(points.select("position", "point"), "position", min_size)
        assigned = hand_over(kept.join(labels, "position"))
    report = themes.cluster_report(
        assigned,
        "position",
        lexicon=lexicon,
        noise_count=noise_count,
        noise_chars=noise_chars,
    )
    if proposed is not None:
        report = themes.apply_synthesis(report, proposed)
    report = cut_lineage(report)
    names = report.select("cluster_id", "theme_name")
    members = lookup_join(assigned, names, ["cluster_id"])
    return Analysis(members, report)
