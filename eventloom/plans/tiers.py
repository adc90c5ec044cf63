"""Rollup reports, tier choice, and statistics across recent and archived data."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import DAY_MS
from eventloom.operators.dedup import dedup_latest
from eventloom.operators.filters import cutoff_hour, day_of, day_start_ms

HOT_HOURS = 168
WARM_DAYS = 30
TOP_TYPES, SUMMARY_LIMIT = 50, 100


class RangeCut(UserWarning):
    """A requested range reaches beyond what a tier holds; the answer covers a part of it."""


def warm_range(as_of_ms: int, date_from: str | None, date_to: str | None) -> tuple[str, str]:
    """A requested range cut to the last 30 days, today included. A cut is warned about."""
    today, earliest = day_of(as_of_ms), day_of(as_of_ms - WARM_DAYS * DAY_MS)
    if date_from is not None and date_from < earliest or date_to is not None and date_to > today:
        warnings.warn(RangeCut(f"the warm tier answers for {earliest} to {today} only"), stacklevel=3)
    return max(date_from or earliest, earliest), min(date_to or today, today)


def warm_stats(
    rollup: DataFrame, as_of_ms: int, group_by: str | None = None, tenant: str | None = None,
    event_type: str | None = None, date_from: str | None = None, date_to: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Sums over the rollup per type and, by ``group_by``, date or hour.

    The whole series, oldest first; with ``limit`` its first rows only.
    """
    first, last = warm_range(as_of_ms, date_from, date_to)
    rows = rollup.where(F.col("date_path").between(first, last))
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    parts = {"date": ["date"], "hour": ["date", "hour"]}.get(group_by, [])
    summed = (
        rows.withColumnRenamed("date_path", "date")
        .groupBy(*parts, "event_type")
        .agg(F.sum("count").alias("count"))
    )
    if not parts:
        return summed.orderBy(F.desc("count"), "event_type")
    series = summed.orderBy(*parts, "event_type")
    return series if limit is None else series.limit(limit)


def timeseries(rollup: DataFrame, as_of_ms: int, granularity: str = "date", **filters) -> DataFrame:
    return warm_stats(rollup, as_of_ms, "hour" if granularity == "hour" else "date", **filters)


def top_types(rollup: DataFrame, as_of_ms: int, limit: int = TOP_TYPES, **filters) -> DataFrame:
    return warm_stats(rollup, as_of_ms, None, **filters).limit(limit)


def tier_of(plan: Column) -> Column:
    """Archive tier a plan is served from; a tenant without a plan counts as free."""
    return F.when(F.coalesce(plan, F.lit("free")) == "free", "warm").otherwise("cold")


def tier_route(totals: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants seen in the totals with plan, tier and event count; an unknown one counts as free."""
    plans = tenants.select(F.col("key_prefix").alias("tenant_id"), "plan")
    per_tenant = totals.groupBy("tenant_id").agg(F.sum("total").alias("events"))
    return per_tenant.join(plans, "tenant_id", "left").select(
        "tenant_id", F.coalesce("plan", F.lit("free")).alias("plan"), tier_of(F.col("plan")).alias("tier"),
        "events",
    )


def merged_stats(
    hot: DataFrame,
    as_of_ms: int,
    warm: DataFrame | None = None,
    cold: DataFrame | None = None,
    tenant: str | None = None,
    plan: str = "admin",
    tier: str | None = None,
    hours: int = 24,
    date_from: str | None = None,
    date_to: str | None = None,
    event_type: str | None = None,
    tu_id: str | None = None,
) -> DataFrame:
    """Totals per type over a range that may reach past the hot window.

    ``hot`` and ``warm`` are rollups, ``cold`` is event rows. The range is split at one hour
    boundary: archive strictly before it, hot from it on, so nothing counts twice. A link
    filter skips the warm tier, which has no link column. Warm reaches back 30 days at most.
    """
    boundary = cutoff_hour(as_of_ms, HOT_HOURS)
    if date_from is not None and date_to is not None:
        first, end = day_start_ms(date_from) // 1000, (day_start_ms(date_to) + DAY_MS) // 1000
    else:
        first, end = cutoff_hour(as_of_ms, hours), None

    def narrowed(df: DataFrame) -> DataFrame:
        if tenant is not None:
            df = df.where(F.col("tenant_id") == tenant)
        if event_type is not None:
            df = df.where(F.col("event_type") == event_type)
        return df if tu_id is None else df.where(F.col("tu_id") == tu_id)

    recent = narrowed(hot).where(F.col("hour") >= max(first, boundary))
    if end is not None:
        recent = recent.where(F.col("hour") < end)
    parts = [recent.select("event_type", F.col("count").alias("n"))]

    until = boundary if end is None else min(boundary, end)
    if first < until:
        use_warm = tu_id is None and (tier == "warm" or (tier != "cold" and plan == "free"))
        if use_warm and warm is not None:
            first_day, _ = warm_range(as_of_ms, day_of(first * 1000), None)
            start = max(first, day_start_ms(first_day) // 1000)
            hour_secs = F.unix_date(F.col("date_path").cast("date")).cast("long") * 86_400 + F.col(
                "hour"
            ).cast("long") * 3600
            archive = (
                narrowed(warm)
                .where(F.col("date_path").between(first_day, day_of(until * 1000)))
                .where((hour_secs >= start) & (hour_secs < until))
                .select("event_type", F.col("count").alias("n"))
            )
            parts.append(archive)
        elif cold is not None:
            rows = (
                narrowed(cold)
                .where(F.col("date_path").between(day_of(first * 1000), day_of(until * 1000)))
                .where((F.col("timestamp_ms") >= first * 1000) & (F.col("timestamp_ms") < until * 1000))
            )
            unique = dedup_latest(rows.select("event_id", "timestamp_ms", "event_type"))
            counted = unique.groupBy("event_type").agg(F.count("*").alias("n"))
            parts.append(counted)
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return merged.groupBy("event_type").agg(F.sum("n").alias("total"))


def rows_as_json(df: DataFrame) -> DataFrame:
    """Any result as one JSON object per row; the column types survive."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


