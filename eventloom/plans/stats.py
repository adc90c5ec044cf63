"""Trailing-window statistics from rollups or, under a params filter, from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import param
from eventloom.operators.filters import cutoff_hour, select_events
from eventloom.operators.rollup import stats_hourly

BREAKDOWN_LIMIT = 100


def _recent_rollup(
    rollup: DataFrame, as_of_ms: int, hours: int, tenant: str | None,
    event_type: str | None, tu_id: str | None,
) -> DataFrame:
    rows = rollup.where(F.col("hour") >= cutoff_hour(as_of_ms, hours))
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    if tu_id is not None:
        rows = rows.where(F.col("tu_id") == tu_id)
    return rows


def stats_hourly_window(
    rollup: DataFrame, as_of_ms: int, hours: int = 24, tenant: str | None = None,
    event_type: str | None = None, tu_id: str | None = None,
) -> DataFrame:
    """Hourly series. Pass the per-link rollup together with ``tu_id``."""
    return (
        _recent_rollup(rollup, as_of_ms, hours, tenant, event_type, tu_id)
        .groupBy("event_type", "hour")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("hour"), "event_type")
    )


def stats_summary(
    rollup: DataFrame, as_of_ms: int, hours: int = 24, tenant: str | None = None,
    event_type: str | None = None, tu_id: str | None = None,
) -> DataFrame:
    return (
        _recent_rollup(rollup, as_of_ms, hours, tenant, event_type, tu_id)
        .groupBy("event_type")
        .agg(F.sum("count").alias("total"))
    )


def _recent_rows(events: DataFrame, as_of_ms: int, hours: int, **filters) -> DataFrame:
    since = cutoff_hour(as_of_ms, hours) * 1000
    return select_events(events, **filters).where(F.col("timestamp_ms") >= since)


def stats_by_param(
    events: DataFrame, as_of_ms: int, param_key: str, param_value: str | None = None,
    hours: int = 24, tenant: str | None = None, event_type: str | None = None,
    tu_id: str | None = None,
) -> DataFrame:
    """Hourly series of rows having the key, or the key with that value."""
    rows = _recent_rows(
        events, as_of_ms, hours, tenant=tenant, event_types=event_type, tu_id=tu_id,
        param_key=param_key, param_value=param_value,
    )
    return (
        stats_hourly(rows)
        .groupBy("event_type", "hour")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("hour"), "event_type")
    )


def param_breakdown(
    events: DataFrame, as_of_ms: int, key: str, hours: int = 24, limit: int = BREAKDOWN_LIMIT,
    **filters,
) -> DataFrame:
    """The commonest (params value, event type) pairs; rows without the key do not count."""
    return (
        _recent_rows(events, as_of_ms, hours, **filters)
        .withColumn("param_value", param(key))
        .where("param_value is not null")
        .groupBy("param_value", "event_type")
        .agg(F.count("*").alias("total"))
        .orderBy(F.desc("total"), "param_value", "event_type")
        .limit(limit)
    )
