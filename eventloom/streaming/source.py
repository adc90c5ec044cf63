"""The event log as a stream: decode, set aside what cannot be decoded, drop replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schema import EVENT_SCHEMA, REQUIRED_FIELDS, derive_silver

DEDUP_WINDOW = "1 hour"


def file_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of JSON-lines files as a log; ``value`` is one payload."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def kafka_log(
    spark: SparkSession, servers: str, topic: str, start: str = "earliest",
    offsets_per_batch: int | None = None,
) -> DataFrame:
    """A Kafka topic as a log. Resuming is the checkpoint's part; ``start`` is for the first run.

    Needs the Kafka connector on the classpath.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
    )
    if offsets_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_batch)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def decode(log: DataFrame) -> DataFrame:
    """Payloads as ``event`` with ``decoded``: whether all required fields are there."""
    parsed = log.select("value", F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("event"))
    present = [F.col(f"event.{name}").isNotNull() for name in REQUIRED_FIELDS]
    return parsed.withColumn("decoded", reduce(lambda a, b: a & b, present))


def silver_of(decoded: DataFrame) -> DataFrame:
    return derive_silver(decoded.where("decoded").select("event.*"))


def poison_of(decoded: DataFrame) -> DataFrame:
    """Payloads that are no events; they are stored and passed over."""
    return decoded.where("not decoded").select("value")


def silver_stream(log: DataFrame) -> DataFrame:
    return silver_of(decode(log))


def with_arrival(rows: DataFrame, within: str = DEDUP_WINDOW) -> DataFrame:
    """Adds ``arrival``, the time of the batch a row came in with, as the watermark.

    State expires by arrival, so an event is never dropped for being late.
    """
    return rows.withColumn("arrival", F.current_timestamp()).withWatermark("arrival", within)


def dedup(silver: DataFrame, within: str = DEDUP_WINDOW) -> DataFrame:
    """Each event once, as long as its copies arrive within the window of each other.

    The state holds the ids of that window: bounded by time, not by a number of ids.
    """
    return with_arrival(silver, within).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])
