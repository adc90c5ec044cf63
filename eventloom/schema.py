"""The event shape: a fixed envelope and an open params map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.columns import canonical_params, date_path, event_hour

GLOBAL_TENANT = "_global"
NO_LINK = "_no_link"

# The JSON an event is posted and logged as.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("accept_language", T.StringType()),
        T.StructField("request_path", T.StringType()),
        T.StructField("request_host", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        # Any JSON value; kept as its text.
        T.StructField("raw_payload", T.StringType()),
    ]
)

# Fields without which a logged event cannot be decoded.
REQUIRED_FIELDS = (
    "event_id", "event_type", "timestamp", "ip", "user_agent",
    "request_path", "request_host", "params",
)

SILVER_COLUMNS = (
    "event_id", "tenant_id", "tu_id", "event_type", "timestamp_ms", "event_time",
    "ip", "user_agent", "referer", "accept_language", "request_path", "request_host",
    "params", "raw_payload", "date_path", "event_hour",
)

_SILVER_TYPES = {
    "timestamp_ms": T.LongType(),
    "event_time": T.TimestampType(),
    "params": T.MapType(T.StringType(), T.StringType()),
}
SILVER_SCHEMA = T.StructType(
    [T.StructField(c, _SILVER_TYPES.get(c, T.StringType())) for c in SILVER_COLUMNS]
)

ARCHIVE_COLUMNS = (
    "event_id", "tenant_id", "tu_id", "event_type", "timestamp_ms", "ip", "user_agent",
    "referer", "request_path", "request_host", "params", "raw_payload", "date_path",
    "event_hour",
)


def tenant_of(params: Column) -> Column:
    return F.coalesce(params["key_prefix"], F.lit(GLOBAL_TENANT))


def derive_silver(events: DataFrame) -> DataFrame:
    """Envelope rows to silver rows.

    ``tenant_id`` and ``tu_id`` are lifted out of the map into columns of their own, so
    that filters on them reach the Parquet scan and most queries never read the map.
    ``tu_id`` stays NULL for an event without a link.
    """
    return (
        events.withColumnRenamed("timestamp", "timestamp_ms")
        .withColumns(
            {
                "tenant_id": tenant_of(F.col("params")),
                "tu_id": F.col("params")["tu_id"],
                "event_time": F.timestamp_millis(F.col("timestamp_ms")),
                "date_path": date_path("timestamp_ms"),
                "event_hour": event_hour("timestamp_ms"),
            }
        )
        .select(*SILVER_COLUMNS)
    )


def archive_rows(silver: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The 14 columns of the full-history table: params as JSON text, no NULL link; then ``extra``."""
    return silver.withColumns(
        {
            "tu_id": F.coalesce("tu_id", F.lit(NO_LINK)),
            "params": canonical_params(F.col("params")),
        }
    ).select(*ARCHIVE_COLUMNS, *extra)


def params_from_archive(archive: DataFrame) -> DataFrame:
    """Archive rows with params parsed back to a map."""
    return archive.withColumn("params", F.from_json("params", "map<string,string>"))


def as_event_json() -> Column:
    """An event as the JSON object the log carries; absent optional fields are left out."""
    return F.to_json(
        F.struct(
            "event_id", "event_type", F.col("timestamp_ms").alias("timestamp"), "ip",
            "user_agent", "referer", "accept_language", "request_path", "request_host",
            "params", "raw_payload",
        )
    )
