"""Row selection and pages."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import DAY_MS, HOUR_MS, first_rows, newest_first, param

PAGE_LIMIT = 50
HISTORY_LIMIT = 1000
FEED_BUFFER = 200


def type_list(event_types: str | list[str] | None) -> list[str]:
    """``"click, view,"`` to ``["click", "view"]``."""
    if event_types is None:
        return []
    parts = event_types.split(",") if isinstance(event_types, str) else event_types
    return [p.strip() for p in parts if p.strip()]


def day_start_ms(date: str) -> int:
    day = datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    return int(day.timestamp()) * 1000


def day_of(ms: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).strftime("%Y-%m-%d")


def hour_floor(as_of_ms: int) -> int:
    return as_of_ms // HOUR_MS * 3600


def cutoff_hour(as_of_ms: int, hours: int) -> int:
    """First hour bucket of a trailing window; both ends count, so N hours are N+1 buckets."""
    return hour_floor(as_of_ms) - hours * 3600


def condition(
    tenant: str | None = None,
    event_types: str | list[str] | None = None,
    tu_id: str | None = None,
    since_ms: int | None = None,
    param_key: str | None = None,
    param_value: str | None = None,
) -> Column | None:
    """The filters every event query shares, NULL-free where columns are; None for no filter.

    ``tenant=None`` means all tenants. A key without a value asks for rows that have the key.
    """
    types = type_list(event_types)
    parts = []
    if tenant is not None:
        parts.append(F.col("tenant_id") == tenant)
    if types:
        parts.append(F.col("event_type").isin(types))
    if tu_id is not None:
        parts.append(F.col("tu_id") == tu_id)
    if since_ms is not None:
        parts.append(F.col("timestamp_ms") > since_ms)
    if param_key is not None:
        value = param(param_key)
        parts.append(value.isNotNull() if param_value is None else value == param_value)
    return reduce(lambda a, b: a & b, parts) if parts else None


def select_events(events: DataFrame, **filters) -> DataFrame:
    wanted = condition(**filters)
    return events if wanted is None else events.where(wanted)


def between_dates(events: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    """Inclusive days, on the partition column (prunes folders) and on the milliseconds."""
    if date_from is not None:
        events = events.where(
            (F.col("date_path") >= date_from) & (F.col("timestamp_ms") >= day_start_ms(date_from))
        )
    if date_to is not None:
        events = events.where(
            (F.col("date_path") <= date_to)
            & (F.col("timestamp_ms") <= day_start_ms(date_to) + DAY_MS - 1)
        )
    return events


def page(events: DataFrame, limit: int | None = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """A newest-first page of ``limit`` rows; None for all of them."""
    return first_rows(events.orderBy(*newest_first()), limit, offset)


def list_events(events: DataFrame, limit: int | None = PAGE_LIMIT, offset: int = 0, **filters) -> DataFrame:
    """The event list: hot columns, newest first."""
    rows = select_events(events, **filters).select(
        "event_id", "event_type", F.col("timestamp_ms"), "ip", "user_agent", "referer",
        "request_path", "request_host", "params",
    )
    return page(rows, limit, offset).withColumnRenamed("timestamp_ms", "timestamp")


def event_by_id(events: DataFrame, event_id: str, tenant: str | None = None) -> DataFrame:
    """One event by id, deduplicated after the filter on the id."""
    from eventloom.operators.dedup import dedup_latest

    found = select_events(events, tenant=tenant).where(F.col("event_id") == event_id)
    return dedup_latest(found).limit(1)


def live_feed(
    raw: DataFrame,
    clean: DataFrame | None = None,
    tenant: str | None = None,
    event_types: str | list[str] | None = None,
    tu_id: str | None = None,
) -> DataFrame:
    """Raw and clean events as one feed; an event present in both is delivered once."""
    feeds = [
        select_events(f, tenant=tenant, event_types=event_types, tu_id=tu_id)
        for f in (raw, clean)
        if f is not None
    ]
    merged = feeds[0] if len(feeds) == 1 else feeds[0].unionByName(feeds[1])
    return merged.dropDuplicates(["event_id"]) if len(feeds) > 1 else merged


def page_plus_live(page_rows: DataFrame, live: DataFrame, buffer: int | None = FEED_BUFFER) -> DataFrame:
    """A fetched page with the ``buffer`` newest live rows it does not hold yet (None: all)."""
    held = first_rows(live.orderBy(*newest_first()), buffer).dropDuplicates(["event_id"])
    new = held.join(page_rows.select("event_id"), "event_id", "left_anti")
    return new.unionByName(page_rows).orderBy(*newest_first())
