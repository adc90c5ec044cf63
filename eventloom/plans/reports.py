"""Canned reports by name, over one tenant's events, each counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import newest_first
from eventloom.operators.dedup import dedup_latest


def _by_type(events: DataFrame, limit: int | None) -> DataFrame:
    unique = dedup_latest(events.select("event_id", "timestamp_ms", "event_type"))
    counted = unique.groupBy("event_type").count().orderBy(F.desc("count"), "event_type")
    return counted if limit is None else counted.limit(limit)


def _latest(events: DataFrame) -> DataFrame:
    return (
        dedup_latest(events.select("event_id", "event_type", "timestamp_ms", "ip", "user_agent"))
        .orderBy(*newest_first())
        .limit(20)
    )


REPORTS = {
    "count": lambda df: _by_type(df, None),
    "latest": _latest,
    "top": lambda df: _by_type(df, 10),
    "default": lambda df: _by_type(df, 100),
}


def report(events: DataFrame, name: str = "default") -> DataFrame:
    return REPORTS.get(name, REPORTS["default"])(events)
