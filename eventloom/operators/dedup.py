"""Duplicates and newest-per-key. A rank filter with a small constant bound plans a group
limit in every map task, so a key holding a third of all rows ships a few rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.columns import newest_first

RECENT_PER_TENANT = 1000
RECENT_PER_LINK = 20


def _first_copy(events: DataFrame, time: Column) -> DataFrame:
    """One row per event id by ``time``; copies of one time are told apart by a hash over
    all other columns, so that runs repeat."""
    rest = [
        F.map_entries(name) if kind.startswith("map") else F.col(name)
        for name, kind in events.dtypes
        if name not in ("event_id", "timestamp_ms")
    ]
    ties = [F.xxhash64(*rest)] if rest else []
    order = Window.partitionBy("event_id").orderBy(time, *ties)
    return events.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def dedup_latest(events: DataFrame) -> DataFrame:
    """One row per event id: the latest.

    Filter and select before calling: Spark cannot move a filter below the rank, and only
    the columns present are read, shuffled and used to break ties.
    """
    return _first_copy(events, F.desc("timestamp_ms"))


def dedup_earliest(events: DataFrame) -> DataFrame:
    """One row per event id: the first copy, as a table that ignores repeated ids keeps it."""
    return _first_copy(events, F.asc("timestamp_ms"))


def newest_per_key(events: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    order = Window.partitionBy(key).orderBy(*newest_first())
    return events.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def recent_per_tenant(events: DataFrame, n: int = RECENT_PER_TENANT) -> DataFrame:
    return newest_per_key(events, "tenant_id", n)


def recent_per_link(events: DataFrame, n: int = RECENT_PER_LINK) -> DataFrame:
    return newest_per_key(events.where("tu_id is not null"), "tu_id", n)
