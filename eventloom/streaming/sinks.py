"""Batch sinks that may be called again with the same batch and leave the same tables.

Each returns a function for ``writeStream.foreachBatch``. A failure inside fails the batch,
so the checkpoint never moves past rows that were not stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.columns import date_path
from eventloom.operators import audit, quality, rollup, similar, webhooks
from eventloom.operators.dedup import RECENT_PER_TENANT, dedup_earliest, recent_per_tenant
from eventloom.schema import SILVER_COLUMNS, SILVER_SCHEMA, derive_silver
from eventloom.sources import deltas, files, ingest, tiers
from eventloom.streaming import limits

Sink = Callable[[DataFrame, int], None]

HOT_PARTITIONS = ("date_path", "batch")
SILVER_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SILVER_SCHEMA.fields)


def rows_sink(path: str, writer: str = "") -> Sink:
    """Append each batch as a folder of its own; ``writer`` tells apart jobs that share a table."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{path}/batch={writer}{batch_id}"
        )

    return write


def filter_sink(
    clean: str, dropped: str, load_rules: Callable[..., DataFrame] | None, ip_counts: str | None = None,
    ip_limit: int = quality.IP_RATE_LIMIT, window_secs: int = quality.IP_WINDOW_SECS,
) -> Sink:
    """IP rate and tenant rules, then passed events to ``clean`` and the others, with reason, to
    ``dropped``.

    ``load_rules(spark)`` runs for every batch, so a changed rule table takes effect with the
    next one. Rows come with ``drop_reason`` already set by the user-agent checks. ``ip_counts`` is
    where the counts of each IP are kept; without it, or with a limit of 0, IPs are not checked.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        judged, staged = df, f"{ip_counts}.staged"
        if ip_counts is not None and ip_limit:
            # The limiter reads the batch more than once; the stream's own plan runs once.
            rows_sink(staged)(df, batch_id)
            held = spark.read.schema(df.schema).parquet(f"{staged}/batch={batch_id}")
            judged = limits.ip_limit(held, ip_counts, batch_id, ip_limit, window_secs).drop("cur_count", "prev_count")
        if load_rules is not None:
            ruled = quality.apply_rules(
                judged.withColumnRenamed("drop_reason", "_first"), load_rules(spark)
            )
            judged = ruled.withColumn("drop_reason", F.coalesce("_first", "drop_reason")).drop("_first")
        judged.persist()
        try:
            marks = [c for c in ("flags",) if c in judged.columns]
            passed = judged.where("drop_reason is null").select(*SILVER_COLUMNS, *marks)
            rows_sink(clean)(passed, batch_id)
            refused = judged.where("drop_reason is not null").select(*SILVER_COLUMNS, *marks, "drop_reason")
            rows_sink(dropped)(refused, batch_id)
        finally:
            judged.unpersist()
            files.remove(spark, f"{staged}/batch={batch_id}")

    return write


def archive_sink(path: str, rollup_base: str | None = None) -> Sink:
    """Full-history rows and, where asked for, their hourly counts."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            tiers.write_archive(df, path, batch_id)
            if rollup_base is not None:
                tiers.add_to_rollup(rollup.warm_rollup(df), rollup_base, batch_id)
        finally:
            df.unpersist()

    return write


def hot_sink(path: str) -> Sink:
    """Insert events whose id was never stored; a stored event is left as it is.

    Ids are looked up in an index over the whole history, in buckets by hash, however old the copy
    says it is. A repeated batch finds the index as its first attempt did.
    """
    keys = deltas.KeyLog(f"{path}.keys", ("event_id",))

    def write(df: DataFrame, batch_id: int) -> None:
        new = keys.unseen(dedup_earliest(df), batch_id).persist()
        try:
            labelled = new.select(*SILVER_COLUMNS).withColumn("batch", F.lit(str(batch_id)))
            files.replace_partitions(labelled, path, HOT_PARTITIONS)
            keys.add(new, batch_id)
        finally:
            new.unpersist()

    return write


def stats_log(path: str) -> deltas.CountLog:
    """Hourly counts, in folders by day."""
    key = (("tenant_id", "string"), ("event_type", "string"), ("hour", "bigint"), ("date_path", "string"))
    return deltas.CountLog(path, key, ("date_path",))


def _day_of_hour(counts: DataFrame) -> DataFrame:
    return counts.withColumn("date_path", F.date_from_unix_date(F.expr("cast(hour div 86400 as int)")).cast("string"))


def stats_sink(path: str) -> Sink:
    """Add each batch's hourly counts. No state and no watermark: the order in which events come,
    and how late they are, makes no difference."""
    log = stats_log(path)

    def write(df: DataFrame, batch_id: int) -> None:
        log.add(_day_of_hour(rollup.stats_hourly(df)), batch_id)

    return write


def ledger_horizon(spark, ledger: str) -> str:
    """The day before which the ledger is closed, '' if it never was pruned."""
    return max(files.names(spark, f"{ledger}.frozen"), default="")


def ledger_sink(ledger: str, stats: str) -> Sink:
    """Count every event once: ids that the ledger does not hold extend it and add to the counts.

    Events of days that are closed go to ``<ledger>.late``: their ids are forgotten and their counts
    final. A repeated batch does not see its own rows.
    """
    row = ["tenant_id", "event_id", "event_type", "hour"]
    log = stats_log(stats)

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        horizon = ledger_horizon(spark, ledger)
        df.persist()
        try:
            rows_sink(f"{ledger}.late")(df.where(F.col("date_path") < horizon).select(*SILVER_COLUMNS), batch_id)
            open_rows = df.where(F.col("date_path") >= horizon)
            ids = open_rows.select("tenant_id", "event_id")
            held = ids.limit(0)
            if files.exists(spark, ledger):
                stored = spark.read.parquet(ledger).where(F.col("batch") != str(batch_id))
                held = stored.select("tenant_id", "event_id").join(ids, ["tenant_id", "event_id"], "left_semi")
            added = _day_of_hour(rollup.new_ledger_rows(held, open_rows).select(*row)).persist()
            files.replace_partitions(added.withColumn("batch", F.lit(str(batch_id))), ledger, HOT_PARTITIONS)
            log.add(_day_of_hour(rollup.count_ledger(added)), batch_id)
            added.unpersist()
        finally:
            df.unpersist()

    return write


def recent_sink(path: str, n: int = RECENT_PER_TENANT) -> Sink:
    """The newest events of each tenant: every batch adds its own newest, readers rank them."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows_sink(path)(recent_per_tenant(df.select(*SILVER_COLUMNS), n), batch_id)

    return write


def recent_events(spark, path: str, n: int = RECENT_PER_TENANT) -> DataFrame:
    rows = spark.read.schema(f"{SILVER_DDL}, batch string").parquet(path).drop("batch")
    return recent_per_tenant(rows.dropDuplicates(["tenant_id", "event_id"]), n)


def trim_recent(spark, path: str, upto: int, n: int = RECENT_PER_TENANT) -> None:
    """Merge finished batches into one folder that holds what is still among the newest."""
    folders = [b for b in files.names(spark, path) if b.startswith("batch=") and int(b[6:]) <= upto]
    label = -(upto + 2)
    if folders and folders != [f"batch={label}"]:
        rows = spark.read.schema(SILVER_DDL).parquet(*[f"{path}/{b}" for b in folders if b != f"batch={label}"])
        kept = recent_per_tenant(rows.dropDuplicates(["tenant_id", "event_id"]), n)
        rows_sink(path)(kept, label)
        for folder in folders:
            if folder != f"batch={label}":
                files.remove(spark, f"{path}/{folder}")


def vector_sink(path: str) -> Sink:
    """Rows of the vector table: each event's text and its embedding, by tenant and day."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = similar.vector_rows(df).withColumn("date_path", date_path("timestamp_ms"))
        files.replace_partitions(rows.withColumn("batch", F.lit(str(batch_id))), path, ("tenant_id", "date_path", "batch"))

    return write


def external_sink(clean: str, refused: str, load_tokens: Callable[..., DataFrame], clock_ms: Callable[[], int]) -> Sink:
    """Posted external events to the clean table, once their ingest token is found good; the others,
    with the audit's status, to ``refused``. Tokens are read afresh for every batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        audited = audit.token_audit(df, load_tokens(df.sparkSession), clock_ms()).persist()
        try:
            events = derive_silver(ingest.normalize_ingest(audited.where("status = 'valid'")))
            rows_sink(clean, "external-")(events, batch_id)
            rows_sink(refused)(audited.where("status <> 'valid'").drop("token"), batch_id)
        finally:
            audited.unpersist()

    return write


def webhook_sink(
    pending: str, load_webhooks: Callable[..., DataFrame], load_tenants: Callable[..., DataFrame],
    load_deliveries: Callable[..., DataFrame] | None = None,
) -> Sink:
    """Signed deliveries still to be made; subscriptions are read afresh for every batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        hooks = load_webhooks(spark)
        queue = webhooks.webhook_queue(df, hooks, load_tenants(spark))
        if load_deliveries is not None:
            queue = webhooks.webhook_pending(queue, load_deliveries(spark))
        rows_sink(pending)(webhooks.with_signature(queue, hooks), batch_id)

    return write
