"""Event-pair matching: triggers joined to results on a shared params value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.columns import HOUR_MS, canonical_params, param
from eventloom.operators.filters import PAGE_LIMIT, condition, select_events

KEY = ["tenant_id", "on_value"]


def _recent(events: DataFrame, on: str, as_of_ms: int, hours: int, tenant: str | None) -> DataFrame:
    """Events of the window that carry the shared value, as ``on_value``."""
    since = as_of_ms - hours * HOUR_MS
    rows = select_events(events.where(F.col("timestamp_ms") >= since), tenant=tenant)
    return rows.withColumn("on_value", param(on)).where("on_value is not null")


def match_pairs(
    events: DataFrame,
    as_of_ms: int,
    trigger: str = "click",
    result: str = "postback",
    on: str = "click_id",
    hours: int = 24,
    limit: int | None = PAGE_LIMIT,
    offset: int = 0,
    tenant: str | None = None,
    require_after: bool = False,
    first_only: bool = False,
    **trigger_filters,
) -> DataFrame:
    """One page of (trigger, result) pairs, newest trigger first; unmatched triggers stay.

    With ``limit=None`` all pairs from ``offset`` on, joined as a whole.

    The join is never built in full. Every trigger gives at least one row, so the page lies
    within its newest ``offset + limit`` triggers; and no trigger needs more than that many
    of its results, which a group limit picks per key in the map tasks. What remains to be
    joined is bounded by the page, however often one value repeats.

    ``require_after`` pairs only results not older than their trigger; ``first_only`` keeps
    each trigger's earliest result.
    """
    reach = None if limit is None else offset + limit
    recent = _recent(events, on, as_of_ms, hours, tenant)
    triggers = select_events(recent.where(F.col("event_type") == trigger), **trigger_filters)
    results = recent.where(F.col("event_type") == result)
    newest = (
        triggers.select(
            *KEY,
            F.col("event_id").alias("trigger_event_id"),
            F.col("timestamp_ms").alias("trigger_timestamp"),
            F.col("ip").alias("trigger_ip"),
            F.col("user_agent").alias("trigger_user_agent"),
            canonical_params(F.col("params")).alias("trigger_params"),
        )
    )
    if reach is not None:
        newest = newest.orderBy(F.desc("trigger_timestamp"), F.desc("trigger_event_id")).limit(reach)
    keys = newest.select(*KEY).distinct()
    if require_after:
        # Trigger times cut a key's results into spans, each kept up to the page's reach.
        times = F.array_sort(F.collect_set("trigger_timestamp"))
        keys = newest.groupBy(*KEY).agg(times.alias("_times"))
    candidates = results.select(
        *KEY,
        F.col("event_id").alias("result_event_id"),
        F.col("timestamp_ms").alias("result_timestamp"),
        F.col("params").alias("_params"),
    ).join(keys, KEY)
    span = (
        F.size(F.filter("_times", lambda t: t <= F.col("result_timestamp")))
        if require_after
        else F.lit(1)
    )
    earliest = Window.partitionBy(*KEY, "_span").orderBy("result_timestamp", "result_event_id")
    kept = candidates.withColumn("_span", span).where("_span > 0")
    most = 1 if first_only else reach
    if most is not None:
        kept = kept.withColumn("_rn", F.row_number().over(earliest)).where(F.col("_rn") <= most)
    kept = kept.select(
        *KEY, "result_event_id", "result_timestamp", canonical_params(F.col("_params")).alias("result_params")
    )
    joined = newest.alias("t").join(kept.alias("r"), _pairing(require_after), "left").select(
        "t.*", "r.result_event_id", "r.result_timestamp", "r.result_params"
    )
    if first_only:
        per_trigger = Window.partitionBy("tenant_id", "trigger_event_id", "trigger_timestamp").orderBy(
            "result_timestamp", "result_event_id"
        )
        joined = joined.withColumn("_rn", F.row_number().over(per_trigger)).where("_rn = 1").drop("_rn")
    ordered = joined.orderBy(
        F.desc("trigger_timestamp"), F.desc("trigger_event_id"),
        F.asc_nulls_last("result_timestamp"), F.asc_nulls_last("result_event_id"),
    )
    paged = ordered.offset(offset) if offset else ordered
    paged = paged if limit is None else paged.limit(limit)
    return paged.withColumns(
        {
            "time_delta_ms": F.col("result_timestamp") - F.col("trigger_timestamp"),
            "matched": F.col("result_event_id").isNotNull(),
        }
    )


def _pairing(require_after: bool) -> Column:
    same = (F.col("t.tenant_id") == F.col("r.tenant_id")) & (
        F.col("t.on_value") == F.col("r.on_value")
    )
    return same & (F.col("r.result_timestamp") >= F.col("t.trigger_timestamp")) if require_after else same


def match_summary(
    events: DataFrame,
    as_of_ms: int,
    trigger: str = "click",
    result: str = "postback",
    on: str = "click_id",
    hours: int = 24,
    tenant: str | None = None,
    require_after: bool = False,
    **trigger_filters,
) -> DataFrame:
    """Distinct trigger values, how many have a result, how many have none, and the rate.

    One pass and one row per value: whether a value matches follows from the first and last
    times of its two sides, so popular values cost nothing and no pair is formed.
    """
    kind, ts = F.col("event_type"), F.col("timestamp_ms")
    wanted = condition(**trigger_filters)
    is_trigger = kind == trigger if wanted is None else (kind == trigger) & wanted
    values = (
        _recent(events, on, as_of_ms, hours, tenant)
        .where(kind.isin(trigger, result))
        .groupBy(*KEY)
        .agg(
            F.min(F.when(is_trigger, ts)).alias("t_first"),
            F.max(F.when(is_trigger, ts)).alias("t_last"),
            F.max(F.when(kind == result, ts)).alias("r_last"),
        )
        .where("t_first is not null")
    )
    if require_after:
        matched = F.coalesce(F.col("r_last") >= F.col("t_first"), F.lit(False))
        unmatched = F.coalesce(F.col("r_last") < F.col("t_last"), F.lit(True))
    else:
        matched, unmatched = F.col("r_last").isNotNull(), F.col("r_last").isNull()
    total, hits = F.count("*"), F.count_if(matched)
    return values.agg(
        total.alias("total_triggers"),
        hits.alias("matched"),
        F.count_if(unmatched).alias("unmatched"),
        F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("match_rate"),
    )
