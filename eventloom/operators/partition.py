"""Which log partition an event goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_PARTITIONS = 24


def log_partition(n: int = LOG_PARTITIONS, spread: int = 1) -> Column:
    """A tenant's events share a partition; keyless events spread evenly by id.

    ``spread`` > 1 gives every tenant that many partitions, chosen by event id, so that a
    tenant owning a third of the traffic does not fill one partition alone.
    """
    keyless = F.col("params")["key_prefix"].isNull()
    lane = F.when(keyless | F.lit(spread > 1), F.col("event_id")).otherwise(F.lit(""))
    lane_no = F.conv(F.substring(F.md5(lane), 1, 8), 16, 10).cast("long")
    home = F.conv(F.substring(F.md5("tenant_id"), 1, 8), 16, 10).cast("long")
    return F.when(keyless, lane_no % n).otherwise((home + lane_no % spread) % n).cast("int")


def to_log(events: DataFrame, n: int = LOG_PARTITIONS, spread: int = 1) -> DataFrame:
    """Events with their ``partition``; with a Kafka sink that column places the record."""
    return events.withColumn("partition", log_partition(n, spread))


def tenant_partition_counts(events: DataFrame, n: int = LOG_PARTITIONS) -> DataFrame:
    """Events per tenant and log partition, counted without moving the events."""
    return to_log(events, n).groupBy("tenant_id", "partition").agg(F.count("*").alias("events"))
