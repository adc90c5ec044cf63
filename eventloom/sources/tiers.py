"""The stored tiers: full-history archive (cold) and hourly rollup files (warm).

Both are plain Parquet in Hive layout, written so that a repeated batch replaces or skips
what its first attempt left behind; no job keeps a log of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schema import ARCHIVE_COLUMNS, SILVER_COLUMNS, archive_rows, params_from_archive
from eventloom.sources import files
from eventloom.sources.deltas import CountLog
from eventloom.sources.files import replace_partitions

ARCHIVE_PARTITIONS = ("tenant_id", "date_path", "batch")
ROLLUP_PARTITIONS = ("tenant_id", "date_path", "hour")
ROLLUP_KEY = (*ROLLUP_PARTITIONS, "event_type")
AGGREGATES_PREFIX = "aggregates"
COMPACTED = "compacted"


def rollup_path(base: str, tenant: str, date: str, hour: str) -> str:
    """Folder of one rollup hour."""
    return f"{base}/{AGGREGATES_PREFIX}/tenant_id={tenant}/date_path={date}/hour={hour}"


# --- archive ----------------------------------------------------------------------------


def _column_types(spark: SparkSession, path: str) -> dict[str, str]:
    """Type of every column the archive has, the 14 fixed ones first, added ones by name.

    Added columns are listed in a small table beside the archive, so that no reader has to open
    all files to know them.
    """
    types = {c: "bigint" if c == "timestamp_ms" else "string" for c in ARCHIVE_COLUMNS}
    if files.exists(spark, f"{path}.columns"):
        listed = spark.read.schema("name string, type string").parquet(f"{path}.columns").distinct()
        types |= {r["name"]: r["type"] for r in listed.orderBy("name").collect()}
    return types


def write_archive(silver: DataFrame, path: str, batch: str | int) -> None:
    """Add a batch of events. Writing the same batch again replaces it.

    Columns that silver rows do not have by rule are added to the archive by name; a column
    whose type differs from what is stored is refused.
    """
    spark = silver.sparkSession
    extra = {n: t for n, t in silver.dtypes if n not in SILVER_COLUMNS and n != "batch"}
    known = _column_types(spark, path)
    for name, kind in extra.items():
        if known.get(name, kind) != kind:
            raise ValueError(f"column {name} is {known[name]} in the archive, not {kind}")
    new = sorted((n, t) for n, t in extra.items() if n not in known)
    if new:
        spark.createDataFrame(new, "name string, type string").coalesce(1).write.mode("append").parquet(f"{path}.columns")
    labelled = archive_rows(silver, tuple(extra)).withColumn("batch", F.lit(str(batch)))
    replace_partitions(labelled, path, ARCHIVE_PARTITIONS)


def _archive(spark: SparkSession, path: str) -> DataFrame:
    types = _column_types(spark, path)
    schema = ", ".join(f"`{n}` {t}" for n, t in {**types, "batch": "string"}.items())
    return spark.read.schema(schema).parquet(path).select(*types, "batch")


def cold_scan(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Archive rows. Files written before a column existed yield NULL for it.

    Filters on ``tenant_id`` and ``date_path`` prune folders. With ``upto``, only rows of batches up
    to that one and of compacted ones.
    """
    rows = _archive(spark, path)
    if upto is not None:
        rows = rows.where((F.col("batch") == COMPACTED) | (F.col("batch").try_cast("bigint") <= upto))
    return rows.drop("batch")


def cold_events(spark: SparkSession, path: str) -> DataFrame:
    """Archive rows with params as a map, ready for the query operators."""
    return params_from_archive(cold_scan(spark, path))


def compact_day(
    spark: SparkSession, path: str, staging: str, tenant: str, date: str, upto: int | None = None
) -> None:
    """Merge the small files of one archive day; its rows stay the same.

    ``upto`` is the last finished batch; later ones are left alone.

    The merged files are complete in ``staging`` before anything is replaced. File sizes
    follow from measured bytes: a small day becomes one file, a hot tenant's day several. A
    stop between the last two steps leaves rows twice, which every reader deduplicates, and
    running the job again removes them.
    """
    wanted = (F.col("tenant_id") == tenant) & (F.col("date_path") == date)
    day = _archive(spark, path).where(wanted)
    if upto is not None:
        day = day.where((F.col("batch") == COMPACTED) | (F.col("batch").try_cast("bigint") <= upto))
    old = [r["batch"] for r in day.select("batch").distinct().collect()]
    merged = day.drop("batch")
    merged.hint("rebalance").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(staging)
    (
        spark.read.schema(merged.schema)
        .parquet(staging)
        .withColumn("batch", F.lit(COMPACTED))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*ARCHIVE_PARTITIONS)
        .parquet(path)
    )
    for batch in old:
        if batch != COMPACTED:
            files.remove(spark, f"{path}/tenant_id={tenant}/date_path={date}/batch={batch}")


# --- rollup -----------------------------------------------------------------------------


def rollup_log(base: str) -> CountLog:
    """The warm tier: hourly counts, a folder per tenant, day and hour."""
    return CountLog(f"{base}/{AGGREGATES_PREFIX}", tuple((k, "string") for k in ROLLUP_KEY), ROLLUP_PARTITIONS)


def _days(tenant: str | None, date_from: str | None, date_to: str | None):
    wanted = F.lit(True)
    if tenant is not None:
        wanted &= F.col("tenant_id") == tenant
    if date_from is not None:
        wanted &= F.col("date_path") >= date_from
    if date_to is not None:
        wanted &= F.col("date_path") <= date_to
    return wanted


def warm_scan(
    spark: SparkSession,
    base: str,
    tenant: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    skip_unreadable: bool = True,
) -> DataFrame:
    """Rollup rows; the filters prune folders.

    An unreadable file is skipped, or fails the read where ``skip_unreadable`` is false.
    """
    return rollup_log(base).read(spark, _days(tenant, date_from, date_to), skip_unreadable)


def write_rollup(rollup: DataFrame, base: str, date_from: str | None = None, date_to: str | None = None, upto: int | None = None) -> None:
    """Store recomputed hours of some days in the place of what batches up to ``upto`` (all) counted."""
    log = rollup_log(base)
    log.replace(rollup, max(log.newest(rollup.sparkSession), 0) if upto is None else upto, _days(None, date_from, date_to))


def add_to_rollup(counts: DataFrame, base: str, batch: int) -> None:
    """Add one batch's hourly counts; a batch that is delivered again replaces its own."""
    rollup_log(base).add(counts, batch)
