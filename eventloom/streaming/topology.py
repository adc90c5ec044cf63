"""The jobs from raw log to tables: each its own query with its own checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from eventloom.functions.columns import DAY_MS
from eventloom.operators import quality, rollup
from eventloom.operators.filters import day_of
from eventloom.schema import SILVER_SCHEMA
from eventloom.sources import deltas, files, tiers
from eventloom.streaming import limits, sinks, source


@dataclass(frozen=True)
class Tables:
    """Where the jobs keep their tables and checkpoints, all under one shared folder."""

    base: str

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def checkpoint(self, job: str) -> str:
        return f"{self.base}/_checkpoints/{job}"


@dataclass(frozen=True)
class Pace:
    """How often a job runs a batch; without an interval it drains the input and ends."""

    interval: str | None = None

    def trigger(self) -> dict:
        return {"processingTime": self.interval} if self.interval else {"availableNow": True}


# Flush intervals of the filter, archive and statistics jobs.
FILTER_PACE, ARCHIVE_PACE, STATS_PACE = Pace("250 milliseconds"), Pace("30 seconds"), Pace("500 milliseconds")


def start(
    df: DataFrame, tables: Tables, job: str, sink: sinks.Sink, pace: Pace = Pace(), mode: str = "append"
) -> StreamingQuery:
    return (
        df.writeStream.queryName(job)
        .foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", tables.checkpoint(job))
        .trigger(**pace.trigger())
        .start()
    )


def counted(df: DataFrame, job: str) -> DataFrame:
    """Row counters of a job, delivered with its progress."""
    reason = F.col("drop_reason") if "drop_reason" in df.columns else F.lit(None)
    return df.observe(
        job,
        F.count(F.lit(1)).alias("read"),
        F.count(reason).alias("dropped"),
        F.min("timestamp_ms").alias("first_ms"),
        F.max("timestamp_ms").alias("last_ms"),
    )


class JobCounters(StreamingQueryListener):
    """Sums of the observed counters per job, and rows the watermark dropped."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        for job, row in progress.observedMetrics.items():
            totals = self.totals.setdefault(job, {"read": 0, "dropped": 0})
            totals["read"] += row["read"]
            totals["dropped"] += row["dropped"]
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        if progress.name:
            totals = self.totals.setdefault(progress.name, {"read": 0, "dropped": 0})
            totals["late"] = totals.get("late", 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def start_filter(
    log: DataFrame, tables: Tables, load_rules: Callable[[SparkSession], DataFrame] | None = None,
    pace: Pace = Pace(), ip_limit: int = quality.IP_RATE_LIMIT,
    window_secs: int = quality.IP_WINDOW_SECS,
) -> StreamingQuery:
    """Raw log to clean table: decode, drop replays, refuse bots and hot IPs, apply rules."""
    silver = source.dedup(source.silver_stream(log))
    judged = quality.with_builtin_reason(silver)
    sink = sinks.filter_sink(
        tables.path("clean"), tables.path("dropped"), load_rules, tables.path("ip_counts"), ip_limit, window_secs
    )
    return start(counted(judged, "filter"), tables, "filter", sink, pace)


def start_quarantine(log: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    poison = source.poison_of(source.decode(log))
    return start(poison, tables, "quarantine", sinks.rows_sink(tables.path("quarantine")), pace)


def clean_stream(spark: SparkSession, tables: Tables, files_per_batch: int | None = None) -> DataFrame:
    """The clean table as the input of the jobs after the filter."""
    files.make(spark, tables.path("clean"))
    reader = spark.readStream.schema(SILVER_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(tables.path("clean")).select(*SILVER_SCHEMA.names)


def start_archive(clean: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    sink = sinks.archive_sink(tables.path("archive"), tables.base)
    return start(source.dedup(clean), tables, "archive", sink, pace)


def start_hot(clean: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    return start(clean, tables, "hot", sinks.hot_sink(tables.path("hot")), pace)


def start_stats(clean: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    """Hourly counts of the clean table, whose replays the filter job has removed."""
    return start(clean, tables, "stats", sinks.stats_sink(tables.path("stats_hourly")), pace)


def start_ledger(events: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    sink = sinks.ledger_sink(tables.path("ledger"), tables.path("ledger_stats"))
    return start(events, tables, "ledger", sink, pace)


def start_webhooks(
    clean: DataFrame, tables: Tables, load_webhooks: Callable, load_tenants: Callable,
    load_deliveries: Callable | None = None, pace: Pace = Pace(),
) -> StreamingQuery:
    sink = sinks.webhook_sink(tables.path("pending"), load_webhooks, load_tenants, load_deliveries)
    return start(source.dedup(clean), tables, "webhooks", sink, pace)


def start_external(
    requests: DataFrame, tables: Tables, load_tokens: Callable, clock_ms: Callable[[], int], pace: Pace = Pace()
) -> StreamingQuery:
    """Posted external events, audited by token, straight to the clean table."""
    sink = sinks.external_sink(tables.path("clean"), tables.path("refused"), load_tokens, clock_ms)
    return start(requests, tables, "external", sink, pace)


def start_recent(clean: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    return start(clean, tables, "recent", sinks.recent_sink(tables.path("recent")), pace)


def start_vectors(clean: DataFrame, tables: Tables, pace: Pace = Pace()) -> StreamingQuery:
    return start(clean, tables, "vectors", sinks.vector_sink(tables.path("vectors")), pace)


# --- scheduled upkeep -------------------------------------------------------------------


def finished(spark: SparkSession, tables: Tables, job: str) -> int:
    """The last batch a job has committed, -1 before the first."""
    done = [int(n) for n in files.names(spark, f"{tables.checkpoint(job)}/commits") if n.isdigit()]
    return max(done, default=-1)


def prune_ledger(spark: SparkSession, ledger: str, as_of_ms: int, days: int = rollup.LEDGER_DAYS) -> str:
    """Close the ledger's days older than the retention and drop those closed by an earlier run.

    Whole day folders go; counts stay, as they are a log of their own. The day is closed one run
    before its ids are dropped, so that a batch under way cannot count an event again.
    """
    closed = sinks.ledger_horizon(spark, ledger)
    horizon = max(day_of(as_of_ms - days * DAY_MS), closed)
    files.make(spark, f"{ledger}.frozen/{horizon}")
    for folder in files.names(spark, ledger):
        if folder.startswith("date_path=") and folder.removeprefix("date_path=") < closed:
            files.remove(spark, f"{ledger}/{folder}")
    return horizon


def fold_counts(spark: SparkSession, log: deltas.CountLog, upto: int) -> None:
    """Merge finished batches; folders that an earlier fold replaced are removed."""
    if upto >= 0:
        log.fold(spark, upto)
        log.expire(spark, upto - 1)


def upkeep(spark: SparkSession, tables: Tables, as_of_ms: int, staging: str) -> None:
    """What runs once a day beside the jobs; running it again changes no result.

    Counts, keys and recent events of finished batches are merged, the ledger is pruned, the day
    before is compacted in the archive, and its warm counts are recomputed from the archive.
    """
    day = day_of(as_of_ms - DAY_MS)
    for job, log in (
        ("stats", sinks.stats_log(tables.path("stats_hourly"))), ("ledger", sinks.stats_log(tables.path("ledger_stats"))),
        ("filter", limits.ip_log(tables.path("ip_counts"))), ("archive", tiers.rollup_log(tables.base)),
    ):
        fold_counts(spark, log, finished(spark, tables, job))
    hot = finished(spark, tables, "hot")
    if hot >= 0:
        deltas.KeyLog(f"{tables.path('hot')}.keys", ("event_id",)).fold(spark, hot)
    sinks.trim_recent(spark, tables.path("recent"), finished(spark, tables, "recent"))
    if finished(spark, tables, "ledger") >= 0:
        prune_ledger(spark, tables.path("ledger"), as_of_ms)
    archive, upto = tables.path("archive"), finished(spark, tables, "archive")
    if upto < 0:
        return
    for tenant in files.names(spark, archive):
        held = files.names(spark, f"{archive}/{tenant}/date_path={day}")
        if tenant.startswith("tenant_id=") and any(h != f"batch={tiers.COMPACTED}" for h in held):
            name = files.unescaped(spark, tenant.removeprefix("tenant_id="))
            tiers.compact_day(spark, archive, f"{staging}/{tenant}-{day}", name, day, upto)
    rollup.reconcile_day(spark, archive, tables.base, day, upto)
