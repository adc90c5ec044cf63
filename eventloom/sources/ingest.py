"""Requests, beacons, external events and batches to one event shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import crypto, urls
from eventloom.operators.audit import signed_link_audit
from eventloom.schema import EVENT_SCHEMA

MAX_BATCH_EVENTS = 10_000

# Request-log columns: what an access log keeps of one tracking request.
REQUEST_COLUMNS = (
    "request_id", "timestamp_ms", "path", "query", "x_forwarded_for", "x_real_ip", "peer_ip",
    "user_agent", "referer", "accept_language", "host",
)

BEACON_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("key_prefix", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ad_click_id", T.StringType()),
        T.StructField("screen_width", T.LongType()),
    ]
)

INGEST_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw_payload", T.StringType()),
    ]
)


def client_ip() -> Column:
    """First forwarded-for entry if not blank, else the real-ip header, else the peer."""
    first = F.trim(F.element_at(F.split("x_forwarded_for", ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.col("x_real_ip"), F.col("peer_ip"))


def _envelope(event_type: Column, path: Column, params: Column, payload: Column | None = None):
    return [
        F.col("request_id").alias("event_id"),
        event_type.alias("event_type"),
        F.col("timestamp_ms").alias("timestamp"),
        client_ip().alias("ip"),
        F.coalesce("user_agent", F.lit("")).alias("user_agent"),
        "referer",
        "accept_language",
        path.alias("request_path"),
        F.coalesce("host", F.lit("unknown")).alias("request_host"),
        params.alias("params"),
        (F.lit(None).cast("string") if payload is None else payload).alias("raw_payload"),
    ]


def normalize_requests(
    requests: DataFrame, tenants: DataFrame, global_secret: str, links: DataFrame | None = None,
    encryption_key: str | None = None,
) -> DataFrame:
    """Click, postback and impression requests to events; other paths are not events.

    A click counts only if its destination is vouched for: ``sig`` over ``url`` by the tenant's
    secret (``tenants``: key_prefix, hmac_secret) or the global one or, with ``encryption_key``, a
    blob ``d`` that opens. A short-link click (``/t/<id>``) takes its tenant from the link registry
    (``tu_id``, ``key_prefix``); it is no event if the link is not registered, or if it has a
    signature that does not fit the link's id.
    """
    path = F.col("path")
    short = path.startswith("/t/")
    kind = (
        F.when((path == "/t") | short, "click")
        .when(path == "/p", "postback")
        .when(path == "/i", "impression")
    )
    params = F.col("_params")
    control = ["url", "sig"] if encryption_key is None else ["d"]
    asked = requests.withColumns({"kind": kind, "_params": urls.query_params(F.col("query"))}).where(
        "kind is not null"
    )
    link_id = F.substring(path, F.lit(4), F.length(path))
    audited = signed_link_audit(
        asked.withColumns(
            {"_signed": F.when(short, link_id).otherwise(params["url"]), "_sig": params["sig"]}
        ),
        tenants, global_secret, "_signed", "_sig",
    )
    valid = F.col("status") == "valid"
    vouched = valid if encryption_key is None else crypto.aes_open(params["d"], F.lit(encryption_key)).isNotNull()
    accepted = F.when(short, valid | F.col("_sig").isNull()).otherwise(vouched)
    rows = audited.where((F.col("kind") != "click") | F.coalesce(accepted, F.lit(False)))
    plain = rows.where(~short).select(
        *_envelope(
            F.col("kind"),
            path,
            F.when(F.col("kind") == "click", urls.without_keys(params, control)).otherwise(params),
        )
    )
    if links is None:
        return plain
    registry = links.select("tu_id", "key_prefix")
    tracked = (
        rows.where(short)
        .withColumn("tu_id", link_id)
        .join(registry, "tu_id")
        .select(
            *_envelope(
                F.lit("click"),
                F.lit("/t"),
                F.map_concat(
                    urls.without_keys(params, ["sig"]),
                    F.create_map(
                        F.lit("tu_id"), F.col("tu_id"), F.lit("key_prefix"), F.col("key_prefix")
                    ),
                ),
            )
        )
    )
    return plain.unionByName(tracked)


def normalize_beacon(requests: DataFrame, body: str = "body") -> DataFrame:
    """On-site beacon posts (a JSON body per request) to events; typeless or keyless ones go."""
    parsed = requests.withColumn("b", F.from_json(body, BEACON_SCHEMA)).where(
        "b.event_type <> '' and b.key_prefix <> ''"
    )
    names = [f for f in BEACON_SCHEMA.names if f != "event_type"]
    pairs = [x for n in names for x in (F.lit(n), F.col(f"b.{n}").cast("string"))]
    params = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return parsed.select(*_envelope(F.col("b.event_type"), F.lit("/t/auto"), params))


def normalize_ingest(requests: DataFrame, body: str = "body") -> DataFrame:
    """External events of audited callers to events.

    ``key_prefix`` is the tenant the caller's token belongs to (see
    ``operators.audit.token_audit``); it replaces whatever the caller put in params.
    These rows belong in the clean table directly: they skip the quality filter.
    """
    parsed = requests.withColumn("b", F.from_json(body, INGEST_SCHEMA)).where("b.event_type <> ''")
    own = F.create_map(F.lit("key_prefix"), F.col("key_prefix"))
    sent = F.coalesce(F.col("b.params"), F.create_map().cast("map<string,string>"))
    params = F.map_concat(urls.without_keys(sent, ["key_prefix"]), own)
    return parsed.select(
        *_envelope(F.col("b.event_type"), F.lit("/ingest"), params, F.col("b.raw_payload"))
    )


def read_batch(spark: SparkSession, path: str, max_events: int = MAX_BATCH_EVENTS) -> DataFrame:
    """One posted JSON array of events; empty and oversized batches are refused."""
    batch = spark.read.schema(EVENT_SCHEMA).json(path, multiLine=True)
    found = batch.limit(max_events + 1).count()
    if found == 0:
        raise ValueError("empty batch")
    if found > max_events:
        raise ValueError(f"batch too large, max {max_events}")
    return batch
