"""Counts per hour and the jobs that keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.columns import event_hour, hour_epoch
from eventloom.operators.dedup import dedup_latest
from eventloom.sources import tiers

LEDGER_DAYS = 30
PIVOT_TYPES = ("click", "postback", "impression")


def stats_hourly(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "event_type", hour_epoch().alias("hour")).count()


def stats_hourly_by_link(events: DataFrame) -> DataFrame:
    return (
        events.where("tu_id is not null")
        .groupBy("tenant_id", "tu_id", "event_type", hour_epoch().alias("hour"))
        .count()
    )


def stats_total(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "event_type").agg(F.count("*").alias("total"))


def warm_rollup(events: DataFrame) -> DataFrame:
    """Hourly counts in the layout of the rollup files."""
    return events.groupBy(
        "tenant_id", "event_type", "date_path", event_hour().alias("hour")
    ).count()


def unique_rollup(events: DataFrame, value: str = "ip", log2_size: int = 12) -> DataFrame:
    """Hourly sketches of distinct values, in the layout of the rollup files.

    Sketches of hours, days or tiers merge without the events: see ``unique_counts``.
    """
    return events.groupBy("tenant_id", "event_type", "date_path", event_hour().alias("hour")).agg(
        F.hll_sketch_agg(value, F.lit(log2_size)).alias("sketch")
    )


def unique_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated distinct values per ``keys`` over any union of ``unique_rollup`` rows.

    With 2^12 slots one standard error is about 1.6 % of the count.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*keys).agg(merged.alias("uniques"))


def warm_reconcile(events: DataFrame, date: str) -> DataFrame:
    """One day's rollup recomputed from deduplicated history."""
    day = events.where(F.col("date_path") == date)
    return warm_rollup(
        dedup_latest(day.select("event_id", "timestamp_ms", "tenant_id", "event_type", "date_path"))
    )


def reconcile_day(spark: SparkSession, archive: str, base: str, date: str, upto: int | None = None) -> None:
    """Replace one day's rollup hours by recomputed ones. Running it again changes nothing.

    ``upto`` is the last batch that is in both tables; counts of later batches stay beside.
    """
    rows = tiers.cold_scan(spark, archive, upto)
    tiers.write_rollup(warm_reconcile(rows, date), base, date, date, upto)


def hour_pivot(hourly: DataFrame, types: tuple[str, ...] = PIVOT_TYPES) -> DataFrame:
    """One row per hour with a zero-filled column per type, oldest first."""
    return _pivot(hourly, "hour", types).orderBy("hour")


def link_pivot(hourly_by_link: DataFrame, types: tuple[str, ...] = PIVOT_TYPES) -> DataFrame:
    return _pivot(hourly_by_link, "tu_id", types)


def _pivot(counts: DataFrame, key: str, types: tuple[str, ...]) -> DataFrame:
    """A fixed type list makes this one conditional aggregation, with no extra pass."""
    return counts.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("count"))), F.lit(0)).alias(
                f"{t}s"
            )
            for t in types
        ]
    )


def live_counts(
    events: DataFrame, as_of_ms: int, slots: int = 60, slot_ms: int = 1000, kind: str = "click"
) -> DataFrame:
    """Clicks per link and slot over the trailing ``slots``, zero-filled; older rows ignored.

    Slot ``slots - 1`` is the current one.
    """
    span = slots * slot_ms
    age = F.lit(as_of_ms) - F.col("timestamp_ms")
    recent = events.where(
        (F.col("event_type") == kind) & (age <= span) & (age >= 0) & F.col("tu_id").isNotNull()
    )
    slot = F.greatest(F.lit(slots - 1) - F.expr(f"({as_of_ms} - timestamp_ms) div {slot_ms}"), F.lit(0))
    counts = recent.groupBy("tu_id", slot.cast("int").alias("slot")).count()
    empty = (
        counts.select("tu_id")
        .distinct()
        .select("tu_id", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        .withColumn("count", F.lit(0).cast("long"))
    )
    return counts.unionByName(empty).groupBy("tu_id", "slot").agg(F.sum("count").alias("count"))


# --- replay-safe ledger -----------------------------------------------------------------


def ledger_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "tenant_id", "event_id", "event_type", hour_epoch().alias("hour"), "timestamp_ms"
    )


def new_ledger_rows(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Events of a batch the ledger does not hold, once each (the earliest copy)."""
    first = (
        ledger_rows(events)
        .groupBy("tenant_id", "event_id")
        .agg(F.min(F.struct("timestamp_ms", "event_type", "hour")).alias("f"))
        .select("tenant_id", "event_id", "f.event_type", "f.hour")
    )
    return first.join(ledger.select("tenant_id", "event_id"), ["tenant_id", "event_id"], "left_anti")


def count_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tenant_id", "event_type", "hour").count()


def recount(ledger: DataFrame, added: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of the hours a batch touched, from the ledger with its new rows."""
    key = ["tenant_id", "event_type", "hour"]
    touched = ledger_rows(events).select(*key).distinct()
    rows = ledger.select("event_id", *key).unionByName(added.select("event_id", *key))
    return count_ledger(rows.join(touched, key, "left_semi"))


def apply_batch(ledger: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger rows a batch adds, and recomputed counts of the hours it touched."""
    added = new_ledger_rows(ledger, events)
    return added, recount(ledger, added, events)


def merge_stats(stats: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stats with the recomputed keys replaced."""
    both = stats.withColumn("_new", F.lit(0)).unionByName(recomputed.withColumn("_new", F.lit(1)))
    return both.groupBy("tenant_id", "event_type", "hour").agg(F.max_by("count", "_new").alias("count"))


def prune_ledger(ledger: DataFrame, as_of_ms: int, days: int = LEDGER_DAYS) -> DataFrame:
    """Ledger rows still inside the retention; counts already stored stay as they are."""
    cutoff = (as_of_ms // 1000 - days * 86_400) // 3600 * 3600
    return ledger.where(F.col("hour") >= cutoff)
