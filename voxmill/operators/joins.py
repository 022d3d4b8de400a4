"""Join helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``big`` to a lookup with one row per key.

    A plain join on purpose.  Spark broadcasts ``lookup`` by itself when its
    size is below ``spark.sql.autoBroadcastJoinThreshold``; above that, a key
    with a large share of the rows of ``big`` makes a partition that adaptive
    execution splits (``spark.sql.adaptive.skewJoin.enabled``), copying only
    that partition's few lookup rows.
    """
    return big.join(lookup, list(keys), how)


def lookup_values(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    """Look a key up in a fixed table of a few entries, as one literal map."""
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))
