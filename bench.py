"""Time the queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) names the tables, ``BENCH_CPUS`` the cores, and
``BENCH_QUERIES`` limits the run to a comma list. A few queries run untimed at first to warm
the JVM and Python workers up; each is then timed ``BENCH_RUNS`` times (default 1), best counts.
``plain`` holds the same questions asked the obvious way, to compare with.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from eventloom.catalog.queries import AS_OF, QUERIES  # noqa: E402
from eventloom.session import local_session  # noqa: E402
from eventloom.sources import testdata as td  # noqa: E402

SINCE = AS_OF - 168 * 3_600_000
WARM_UP = ("dedup_latest", "attribution_journey", "event_embedding", "match_pairs")


def _sides(spark, sf):
    rows = td.silver(spark, sf).where(F.col("timestamp_ms") >= SINCE).withColumn(
        "on_value", F.col("params")["click_id"]
    )
    t = rows.where("event_type = 'click'").alias("t")
    r = rows.where("event_type = 'purchase'").alias("r")
    same = (F.col("t.tenant_id") == F.col("r.tenant_id")) & (F.col("t.on_value") == F.col("r.on_value"))
    return t.join(r, same, "left")


def plain_match_pairs(spark, sf):
    return (
        _sides(spark, sf)
        .orderBy(F.desc("t.timestamp_ms"), F.desc("t.event_id"), "r.timestamp_ms", "r.event_id")
        .offset(20)
        .limit(200)
        .select("t.event_id", "t.params", F.col("r.event_id").alias("result_id"), F.col("r.params").alias("rp"))
    )


def plain_match_summary(spark, sf):
    value = F.concat_ws(":", "t.tenant_id", "t.on_value")
    hit = F.col("r.event_id").isNotNull()
    return _sides(spark, sf).agg(
        F.count_distinct(value), F.count_distinct(F.when(hit, value)), F.count_distinct(F.when(~hit, value))
    )


def plain_dedup_latest(spark, sf):
    rows = td.replayed(spark, sf)
    newest = rows.groupBy("event_id").agg(F.max("timestamp_ms").alias("timestamp_ms"))
    return rows.join(newest, ["event_id", "timestamp_ms"]).select(
        "event_id", "tenant_id", "event_type", "timestamp_ms"
    )


def plain_similar_exact(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in td.query_vector(spark, sf)])
    gap = F.aggregate(
        F.zip_with("vector", q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    return td.vectors(spark, sf).where("tenant_id = 't1'").withColumn("d", F.sqrt(gap)).orderBy("d").limit(10)


def plain_param_breakdown(spark, sf):
    rows = td.silver(spark, sf).where(f"tenant_id = 't1' and timestamp_ms >= {SINCE}")
    return rows.groupBy(F.col("params")["sub1"], "event_type").count().orderBy(F.desc("count")).limit(100)


def plain_attribution_journey(spark, sf):
    rows = td.silver(spark, sf)
    w = Window.partitionBy(F.col("params")["click_id"]).orderBy("timestamp_ms", "event_id")
    own = F.when(F.col("event_type") == "click", F.col("event_id"))
    linked = rows.withColumn("ad", F.coalesce(own, F.last(own, ignorenulls=True).over(w))).where("ad is not null")
    step = F.row_number().over(Window.partitionBy("tenant_id", "ad").orderBy("timestamp_ms", "event_id"))
    return linked.select("tenant_id", "ad", "event_id", "event_type", "timestamp_ms", step.alias("step"))


PLAIN = {
    "match_pairs": plain_match_pairs,
    "match_summary": plain_match_summary,
    "dedup_latest": plain_dedup_latest,
    "similar_exact": plain_similar_exact,
    "param_breakdown": plain_param_breakdown,
    "attribution_journey": plain_attribution_journey,
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(spark, fn, sf: str, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        started = time.perf_counter()
        run(fn(spark, sf))
        best = min(best, time.perf_counter() - started)
    return round(best, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = local_session("bench", cpus)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    for n in WARM_UP:
        run(QUERIES[n](spark, sf))
    seconds = {n: timed(spark, QUERIES[n], sf, runs) for n in names}
    plain = {n: timed(spark, fn, sf, runs) for n, fn in PLAIN.items() if n in names}
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus, "events": events,
                "events_per_sec": {n: round(events / s) for n, s in seconds.items()}, "plain": plain,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
