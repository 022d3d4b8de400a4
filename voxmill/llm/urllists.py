"""Temporal list join: captures against the list entries that were active when they were fetched.

Dated list events (``add``, ``remove``) become validity intervals.  A capture
is looked up under its host and each parent domain; of the entries active at
its fetch time the one of the longest pattern decides.  Column functions and
joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.shared import only

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)"
ADDRESS = r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without final dots; null if there is none.  An IPv6 address keeps its brackets."""
    host = F.rtrim(F.regexp_extract(url, HOST, 1), F.lit("."))
    return F.when(host != "", F.lower(host))


def _is_address(host: Column) -> Column:
    return F.regexp_like(host, F.lit(ADDRESS))


def patterns_of(host: Column) -> Column:
    """The host and its parent domains of two labels and more (a one-label host or an address itself)."""
    labels = F.split(host, r"\.")
    sizes = F.sequence(F.least(F.lit(2), F.size(labels)), F.size(labels))
    domains = F.transform(sizes, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    return F.when(_is_address(host), F.array(host)).otherwise(domains)


def validity(events: DataFrame) -> DataFrame:
    """Rows ``(list, pattern, valid_from, valid_to)`` out of dated events.

    ``events`` has ``list, pattern, action, day``.  An entry is active from the
    day of an ``add`` to the day before the next ``remove``, without end if
    none follows.  Repeated adds of an active entry and removes of an inactive
    one change nothing; of several events of one day a ``remove`` counts.
    Events without pattern, day, list or a known action are left out.
    """
    rows = only(events, list="list", pattern="pattern", action="action", day="day").where(
        F.col("list").isNotNull()
        & F.col("pattern").isNotNull()
        & F.col("day").isNotNull()
        & F.col("action").isin("add", "remove")
    )
    daily = rows.groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("action").over(order)).where(
        F.coalesce(F.col("before"), F.lit("remove")) != F.col("action")
    )
    return (
        changes.withColumn("valid_to", F.lead("day").over(order))
        .where("action = 'add'")
        .select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")
    )


def evaluate(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row per distinct capture ``(page_id, url, fetched)`` with the entry that decides.

    A capture is looked up under every suffix of its host, however many labels
    that has, down to the top-level domain; an address only as a whole.
    Of the active entries the longest pattern wins, then the latest start,
    then the smallest list name.  A capture without an active entry, without a
    fetch day or without a host has nulls and is not ``blocked``.  The lookup
    side is broadcast only if Spark finds it small; beyond that a hot host is
    one key of a plain inner join, which adaptive execution splits.
    """
    rows = only(captures, page_id="page_id", url="url", fetched="fetched").withColumn("host", host_of(F.col("url")))
    spread = rows.select("page_id", "url", "fetched", F.explode(patterns_of(F.col("host"))).alias("pattern"))
    active = (F.col("fetched") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))
    )
    # Top-level domains apart: they are hot keys, but a list has few of them.
    labels = F.split("host", r"\.")
    tops = rows.where((F.size(labels) > 1) & ~_is_address(F.col("host"))).select("page_id", "url", "fetched", F.element_at(labels, -1).alias("pattern"))
    met = spread.join(intervals, "pattern").unionByName(
        tops.join(intervals.where(~F.contains("pattern", F.lit("."))), "pattern")
    ).where(active)
    rank = F.struct(
        F.length("pattern").alias("size"),
        F.col("valid_from"),
        # The smallest name is the largest of these: characters turned round, and an end above them all.
        F.concat(F.transform(F.split("list", ""), lambda c: -F.ascii(c)), F.array(F.lit(1))).alias("name"),
        F.col("list").alias("list"),
        F.col("pattern").alias("pattern"),
    )
    best = met.groupBy("page_id", "url", "fetched").agg(F.max(rank).alias("best"))
    keys = ["page_id", "url", "fetched"]
    distinct = rows.select(*keys, "host").distinct().alias("c")
    same = [F.col(f"c.{key}").eqNullSafe(F.col(f"b.{key}")) for key in keys]
    return distinct.join(best.alias("b"), same, "left").select(
        "c.page_id",
        "c.url",
        "c.host",
        "c.fetched",
        F.col("best.list").alias("list"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.valid_from").alias("active_since"),
        F.col("best").isNotNull().alias("blocked"),
    )
