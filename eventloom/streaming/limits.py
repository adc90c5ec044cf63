"""Limiters whose verdict depends on what came before.

The IP limiter carries counts from batch to batch in an append-only log. The token bucket keeps
state per tenant, forgotten when idle; its verdict depends on the order of a tenant's rows, so one
micro-batch's rows of a tenant are put in order together: the source's batch size
(``maxOffsetsPerTrigger``) bounds what a tenant needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators.quality import IP_RATE_LIMIT, IP_WINDOW_SECS, ip_rate_exact, ip_window_counts
from eventloom.operators.ratelimit import BURST, COST, DEFAULT_RATE
from eventloom.sources.deltas import CountLog
from eventloom.streaming.source import with_arrival

IDLE_BUCKET_SECS = 300


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch in order of time, however Arrow cut them."""
    rows = list(batches)
    if rows:
        yield pd.concat(rows, ignore_index=True).sort_values(["timestamp_ms", "event_id"])


def _forget_after(state: GroupState, arrival: pd.Timestamp, idle_ms: int) -> None:
    """Drop the state some time after nothing has arrived for the key for so long."""
    state.setTimeoutTimestamp(int(arrival.timestamp() * 1000) + idle_ms)


def _arriving(rows: DataFrame) -> DataFrame:
    return rows if "arrival" in rows.columns else with_arrival(rows)


def ip_log(path: str) -> CountLog:
    """Counts of each (ip, window) so far, in folders of an hour."""
    return CountLog(path, (("ip", "string"), ("wid", "bigint"), ("slot", "string")), ("slot",))


def ip_limit(
    judged: DataFrame, path: str, batch: int, limit: int = IP_RATE_LIMIT, window_secs: int = IP_WINDOW_SECS
) -> DataFrame:
    """IP verdicts of one batch: ``drop_reason`` filled in, ``cur_count``, ``prev_count``.

    Counts of earlier batches come from the log at ``path``, to which this batch adds its own. Rows
    that have a ``drop_reason`` already pass through uncounted. All of it is joins and windows over
    slices of time, so no IP's rows meet in one task. A row that comes late is counted in its own
    window. Batches in order of time give what the batch operator gives for the whole.
    """
    spark = judged.sparkSession
    hour = F.expr(f"(wid * {window_secs}) div 3600")
    passed = F.col("drop_reason").isNull()
    counts = ip_window_counts(judged.where(passed), window_secs).withColumn("slot", hour.cast("string"))
    first, last = counts.agg(F.min(hour), F.max(hour)).head()
    log = ip_log(path)
    carried = None
    if first is not None:
        back = -(-window_secs // 3600)
        carried = log.read(spark, F.col("slot").cast("bigint").between(first - back, last), but=batch)
        log.add(counts, batch)
    counted = ip_rate_exact(judged, limit, window_secs, carried, passed)
    reason = F.coalesce("drop_reason", F.when(F.col("limited"), F.concat(F.lit("ip_rate_limit:"), F.col("ip"))))
    return counted.withColumn("drop_reason", reason).select(*judged.columns, "cur_count", "prev_count")


def _bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
    """A tenant's bucket in thousandths of a token; an idle one is dropped and starts full."""
    if state.hasTimedOut:
        state.remove()
        return
    tokens, at = state.get if state.exists else (None, 0)
    for pdf in _in_order(batches):
        arrival = pdf["arrival"].iloc[-1]
        admitted = np.zeros(len(pdf), dtype=bool)
        for i, (ts, rate) in enumerate(zip(pdf["timestamp_ms"].tolist(), pdf["rate"].tolist())):
            full = BURST * COST * rate
            tokens = full if tokens is None else min(tokens + max(ts - at, 0) * rate, full)
            at = max(ts, at)
            if tokens >= COST:
                tokens -= COST
                admitted[i] = True
        yield pdf[["event_id", "tenant_id", "timestamp_ms"]].assign(admitted=admitted)
    state.update((tokens, at))
    _forget_after(state, arrival, IDLE_BUCKET_SECS * 1000)


def token_bucket(silver: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Verdict per event of a stream; ``rates`` holds (tenant_id, rate) and may be replaced
    between batches, a lower rate cutting the bucket at once."""
    rate = F.lit(DEFAULT_RATE).cast("long")
    rows = _arriving(silver).select("event_id", "tenant_id", "timestamp_ms", "arrival")
    if rates is not None:
        rows = rows.join(rates.select("tenant_id", F.col("rate").alias("_r")), "tenant_id", "left")
        rate = F.coalesce(F.col("_r").cast("long"), rate)
    return (
        rows.select("event_id", "tenant_id", "timestamp_ms", "arrival", rate.alias("rate"))
        .groupBy("tenant_id")
        .applyInPandasWithState(
            _bucket,
            "event_id string, tenant_id string, timestamp_ms long, admitted boolean",
            "tokens long, at long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
