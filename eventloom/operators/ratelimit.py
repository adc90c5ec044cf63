"""Per-tenant token bucket replayed over event time.

A bucket is a sequential thing, but not one task per tenant: the timeline is cut into
chunks, and a chunk is a function from the tokens it starts with to the tokens it leaves.
All chunks work out that function in parallel, a tenant's few chunk rows are chained, and
all chunks then replay in parallel from their known start.

Tokens are counted in thousandths, so that with millisecond timestamps every step is exact:
``rate`` of them arrive per millisecond, a request takes 1,000, the bucket holds 2,000 x rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_RATE = 100
BURST = 2
COST = 1000
CHUNK_MS = 600_000

_TICK = "tenant_id string, chunk long, timestamp_ms long, n long, rate long"
_EFFECT = "tenant_id string, chunk long, rate long, starts array<long>, ends array<long>"
_START = "tenant_id string, chunk long, start long"


def _advance(tokens, elapsed: int, n: int, rate: int):
    """Tokens after a pause and ``n`` requests, and how many of those were let through."""
    filled = np.minimum(tokens + elapsed * rate, BURST * COST * rate)
    admitted = np.minimum(filled // COST, n)
    return filled - admitted * COST, admitted


def _steps(pdf: pd.DataFrame, chunk_ms: int) -> Iterator[tuple[int, int]]:
    at = int(pdf["chunk"].iloc[0]) * chunk_ms
    for ts, n in zip(pdf["timestamp_ms"].tolist(), pdf["n"].tolist()):
        yield ts - at, n
        at = ts


def _chunk_effect(chunk_ms: int):
    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        """End tokens for every possible start, merged as soon as starts lead to one state."""
        pdf = pdf.sort_values("timestamp_ms")
        rate = int(pdf["rate"].iloc[0])
        starts = np.arange(0, BURST * COST * rate + 1, gcd(rate, COST), dtype=np.int64)
        state = starts
        for elapsed, n in _steps(pdf, chunk_ms):
            state, _ = _advance(state, elapsed, n, rate)
            if len(state) > 1:
                first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
                state, starts = state[first], starts[first]
        left = (int(pdf["chunk"].iloc[0]) + 1) * chunk_ms - int(pdf["timestamp_ms"].iloc[-1])
        state, _ = _advance(state, left, 0, rate)
        key = pdf.iloc[0]
        return pd.DataFrame(
            {
                "tenant_id": [key["tenant_id"]], "chunk": [key["chunk"]], "rate": [rate],
                "starts": [starts], "ends": [state],
            }
        )

    return effect


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start tokens of each chunk of a tenant; after an empty chunk the bucket is full."""
    pdf = pdf.sort_values("chunk")
    tokens, previous, out = 0, None, []
    for chunk, rate, starts, ends in zip(pdf["chunk"], pdf["rate"], pdf["starts"], pdf["ends"]):
        if previous is None or chunk != previous + 1:
            tokens = BURST * COST * rate
        out.append(tokens)
        tokens = int(ends[np.searchsorted(starts, tokens, side="right") - 1])
        previous = chunk
    return pd.DataFrame({"tenant_id": pdf["tenant_id"], "chunk": pdf["chunk"], "start": out})


def _replay(chunk_ms: int):
    def replay(ticks: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        ticks = ticks.sort_values("timestamp_ms")
        rate, tokens = int(ticks["rate"].iloc[0]), int(start["start"].iloc[0])
        admitted = []
        for elapsed, n in _steps(ticks, chunk_ms):
            tokens = min(tokens + elapsed * rate, BURST * COST * rate)
            let = min(tokens // COST, n)
            tokens -= let * COST
            admitted.append(let)
        return ticks[["tenant_id", "timestamp_ms"]].assign(let_through=admitted)

    return replay


def token_bucket_admit(
    events: DataFrame, rates: DataFrame | None = None, ts: str = "timestamp_ms",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Adds ``admitted``: whether the tenant's bucket let the event through.

    ``rates`` holds (tenant_id, rate) in whole requests per second; a tenant without one
    gets 100. Requests of one millisecond are taken in event id order. The groups handed to
    Python hold at most one row per millisecond of a chunk, whatever the traffic.
    """
    if chunk_ms < BURST * 1000:
        raise ValueError("a chunk must be long enough to refill the bucket")
    per_ms = events.groupBy("tenant_id", F.col(ts).alias("timestamp_ms")).agg(F.count("*").alias("n"))
    rate = F.lit(DEFAULT_RATE).cast("long")
    if rates is not None:
        per_ms = per_ms.join(rates.select("tenant_id", F.col("rate").alias("_r")), "tenant_id", "left")
        rate = F.coalesce(F.col("_r").cast("long"), rate)
    ticks = per_ms.select(
        "tenant_id",
        F.expr(f"timestamp_ms div {chunk_ms}").alias("chunk"),
        "timestamp_ms",
        "n",
        rate.alias("rate"),
    )
    by_chunk = ticks.groupBy("tenant_id", "chunk")
    effects = by_chunk.applyInPandas(_chunk_effect(chunk_ms), _EFFECT)
    starts = effects.groupBy("tenant_id").applyInPandas(_chain, _START)
    let = by_chunk.cogroup(starts.groupBy("tenant_id", "chunk")).applyInPandas(
        _replay(chunk_ms), "tenant_id string, timestamp_ms long, let_through long"
    )
    turn = F.row_number().over(Window.partitionBy("tenant_id", ts).orderBy("event_id"))
    return (
        events.withColumn("_turn", turn)
        .join(let.withColumnRenamed("timestamp_ms", ts), ["tenant_id", ts])
        .withColumn("admitted", F.col("_turn") <= F.col("let_through"))
        .drop("_turn", "let_through")
    )
