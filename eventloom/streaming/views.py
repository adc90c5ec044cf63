"""Aggregates kept up to date by a stream, and the live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.filters import live_feed
from eventloom.streaming.source import dedup

LIVE_SECS = 60


def live_counts(silver: DataFrame, lateness_secs: int = LIVE_SECS, slot: str = "1 second") -> DataFrame:
    """Clicks per link and second; rows later than a minute are dropped and counted as such
    in the query's progress (``numRowsDroppedByWatermark``)."""
    clicks = silver.where("event_type = 'click' and tu_id is not null")
    return (
        clicks.withWatermark("event_time", f"{lateness_secs} seconds")
        .groupBy("tu_id", F.window("event_time", slot).alias("w"))
        .count()
        .select("tu_id", F.unix_millis("w.start").alias("slot_ms"), "count")
    )


def feed(raw: DataFrame, clean: DataFrame | None = None, **filters) -> DataFrame:
    """Live events of a tenant, type list and link. With both feeds an event present in
    each is delivered once, within the watermark."""
    if clean is None:
        return live_feed(raw, **filters)
    both = [live_feed(f, **filters) for f in (raw, clean)]
    return dedup(both[0].unionByName(both[1]))
