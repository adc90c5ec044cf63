"""Column helpers shared by every operator. All of them are built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def hour_epoch(ts: str = "timestamp_ms") -> Column:
    """Start of the UTC hour in epoch seconds."""
    return F.expr(f"{ts} div {HOUR_MS} * 3600")


def date_path(ts: str = "timestamp_ms") -> Column:
    """UTC date as YYYY-MM-DD; integer arithmetic, so the session zone plays no part."""
    return F.expr(f"cast(date_from_unix_date(cast({ts} div {DAY_MS} as int)) as string)")


def event_hour(ts: str = "timestamp_ms") -> Column:
    """UTC hour of day as 00..23."""
    return F.expr(f"lpad(cast({ts} div {HOUR_MS} % 24 as string), 2, '0')")


def param(key: str) -> Column:
    """A params value, NULL when the key is missing; the link has a column of its own."""
    return F.col("tu_id") if key == "tu_id" else F.col("params").getItem(key)


def canonical_params(params: Column) -> Column:
    """Params as JSON text with sorted keys, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def newest_first(ts: str = "timestamp_ms", key: str = "event_id") -> list[Column]:
    return [F.desc(ts), F.desc(key)]


def first_rows(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset``; None for all of them."""
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)
