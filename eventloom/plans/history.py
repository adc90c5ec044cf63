"""Full-history queries over the archive. Filters go in before the duplicates are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import date_path, event_hour, newest_first, param
from eventloom.operators.dedup import dedup_latest
from eventloom.operators.filters import HISTORY_LIMIT, between_dates, select_events
from eventloom.schema import NO_LINK

EVENT_COLUMNS = (
    "event_id", "tenant_id", "tu_id", "event_type", "timestamp_ms", "ip", "user_agent",
    "referer", "request_path", "request_host", "params",
)


def _matching(events: DataFrame, date_from, date_to, **filters) -> DataFrame:
    return select_events(between_dates(events, date_from, date_to), **filters)


def events_history(
    events: DataFrame, date_from: str | None = None, date_to: str | None = None,
    limit: int = HISTORY_LIMIT, **filters,
) -> DataFrame:
    """Newest events of a date range, each once, under the names the hot list uses."""
    return (
        dedup_latest(_matching(events, date_from, date_to, **filters).select(*EVENT_COLUMNS))
        .orderBy(*newest_first())
        .limit(limit)
        .withColumnRenamed("timestamp_ms", "timestamp")
    )


def _grouping(group_by: str | None) -> tuple[dict[str, Column], list[Column | str], bool]:
    """Group columns besides the type, result order, and whether the limit applies."""
    if group_by and group_by.startswith("param:"):
        return {"param_value": param(group_by[6:])}, [F.desc("count"), "param_value", "event_type"], True
    if group_by == "tu_id":
        return {"tu_id": F.coalesce("tu_id", F.lit(NO_LINK))}, [F.desc("count"), "tu_id", "event_type"], True
    if group_by == "date":
        return {"date": date_path()}, ["date", "event_type"], False
    if group_by == "hour":
        return {"date": date_path(), "hour": event_hour()}, ["date", "hour", "event_type"], False
    return {}, [F.desc("count"), "event_type"], False


def history_stats(
    events: DataFrame, group_by: str | None = None, date_from: str | None = None,
    date_to: str | None = None, limit: int = HISTORY_LIMIT, **filters,
) -> DataFrame:
    """Counts of distinct events per type and, by ``group_by``: tu_id, date, hour, param:<key>.

    Rows without the params key are left out of its breakdown.
    """
    extra, order, limited = _grouping(group_by)
    groups = [c.alias(n) for n, c in extra.items()]
    # Only what the counts need travels through the ranking shuffle.
    rows = dedup_latest(
        _matching(events, date_from, date_to, **filters).select(
            "event_id", "timestamp_ms", "event_type", *groups
        )
    )
    if "param_value" in extra:
        rows = rows.where("param_value is not null")
    counted = rows.groupBy(*extra, "event_type").count().orderBy(*order)
    return counted.limit(limit) if limited else counted
