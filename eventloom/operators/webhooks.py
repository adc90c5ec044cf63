"""Which event goes to which subscription, and how deliveries went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import crypto
from eventloom.operators.dedup import dedup_latest
from eventloom.schema import GLOBAL_TENANT, as_event_json

MAX_ATTEMPTS = 3


def subscriptions(webhooks: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active webhooks under the prefix events carry, one row per type they take."""
    ids = tenants.select(F.col("id").alias("_id"), F.col("key_prefix").alias("tenant_id"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return (
        webhooks.where("active")
        .join(ids, webhooks["tenant_id"] == F.col("_id"))
        .select(
            ids["tenant_id"],
            F.col("id").alias("webhook_id"),
            "url",
            "event_types",
            blank("filter_param_key").alias("filter_param_key"),
            blank("filter_param_value").alias("filter_param_value"),
        )
    )


def webhook_queue(events: DataFrame, webhooks: DataFrame, tenants: DataFrame) -> DataFrame:
    """One row per event and subscription that wants it; replays of an event count once."""
    subs = subscriptions(webhooks, tenants)
    wants_type = F.array_contains("event_types", F.lit("*")) | F.array_contains(
        F.col("event_types"), F.col("event_type")
    )
    value = F.col("params")[F.col("filter_param_key")]
    wants_param = F.col("filter_param_key").isNull() | (
        value.isNotNull()
        & (F.col("filter_param_value").isNull() | (value == F.col("filter_param_value")))
    )
    # Tenants without a subscription leave before the duplicates are ranked. Subscriptions, a short
    # list, travel to the events: dealt by tenant, all events of one tenant would be one task's.
    wanted = events.where(F.col("tenant_id") != GLOBAL_TENANT).join(
        F.broadcast(subs.select("tenant_id")), "tenant_id", "left_semi"
    )
    return dedup_latest(wanted).join(F.broadcast(subs), "tenant_id").where(wants_type & wants_param)


def with_signature(queue: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Adds the payload and its HMAC under the webhook's secret; pads once per webhook."""
    ipad, opad = crypto.pad_columns(F.col("secret"))
    pads = webhooks.select(
        F.col("id").alias("webhook_id"), ipad.alias("_ipad"), opad.alias("_opad")
    )
    return (
        queue.withColumn("payload", as_event_json())
        .join(pads, "webhook_id")
        .withColumn("signature", crypto.hmac_hex(F.col("_ipad"), F.col("_opad"), F.col("payload")))
        .drop("_ipad", "_opad")
    )


def webhook_pending(queue: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Queue rows without a successful delivery."""
    done = deliveries.where("status_code >= 200 and status_code < 300").select(
        "webhook_id", "event_id"
    )
    return queue.join(done, ["webhook_id", "event_id"], "left_anti")


def delivery_health(deliveries: DataFrame) -> DataFrame:
    """Per webhook: events tried, delivered, given up on, and attempts spent."""
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    per_event = deliveries.groupBy("webhook_id", "event_id").agg(
        F.max("attempt").alias("attempts"),
        F.max_by("status_code", "attempt").alias("last_status"),
        F.coalesce(F.bool_or(ok), F.lit(False)).alias("delivered"),
    )
    exhausted = ~F.col("delivered") & (F.col("attempts") >= MAX_ATTEMPTS)
    return per_event.groupBy("webhook_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("delivered")).alias("delivered"),
        F.count_if(exhausted).alias("exhausted"),
        F.sum("attempts").cast("long").alias("attempts"),
        F.count_if(F.col("last_status").isNull()).alias("last_without_status"),
    )
