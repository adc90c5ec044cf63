"""Ad-hoc SQL limited to one tenant's rows.

The statement runs in a session of its own holding only the views it may read; its parsed and its
resolved plan are checked (``sqlguard``), and anything but a query over those views is refused
before it runs. The row limit is applied to the result, not to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.functions.columns import HOUR_MS, first_rows
from eventloom.operators.dedup import dedup_latest
from eventloom.operators.filters import (
    between_dates, select_events,
)
from eventloom.plans.sqlguard import RefusedStatement, guarded
from eventloom.schema import archive_rows
from eventloom.session import configure

Loader = Callable[[SparkSession], DataFrame]

# SQL functions over JSON text, for archive rows whose params and payload are text.
JSON_FUNCTIONS = {
    "json_get_str": ("STRING", "get_json_object(j, concat(\"$['\", k, \"']\"))"),
    "json_get_int": ("BIGINT", "try_cast(get_json_object(j, concat(\"$['\", k, \"']\")) AS BIGINT)"),
    "json_get_float": ("DOUBLE", "try_cast(get_json_object(j, concat(\"$['\", k, \"']\")) AS DOUBLE)"),
    "json_get_bool": ("BOOLEAN", "try_cast(get_json_object(j, concat(\"$['\", k, \"']\")) AS BOOLEAN)"),
    "json_get_json": ("STRING", "get_json_object(j, concat(\"$['\", k, \"']\"))"),
    "json_contains": ("BOOLEAN", "get_json_object(j, concat(\"$['\", k, \"']\")) IS NOT NULL"),
}

def register_json_functions(spark: SparkSession) -> None:
    for name, (kind, body) in JSON_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(j STRING, k STRING) RETURNS {kind} RETURN {body}"
        )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION json_length(j STRING) RETURNS INT RETURN "
        "coalesce(json_array_length(j), size(json_object_keys(j)))"
    )


def scoped_session(spark: SparkSession, views: dict[str, Loader]) -> SparkSession:
    """A session that knows the given views and cannot read a file by path."""
    own = configure(spark.newSession())
    for name, load in views.items():
        load(own).createOrReplaceTempView(name)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    register_json_functions(own)
    return own


def run_scoped(
    spark: SparkSession, sql: str, views: dict[str, Loader], limit: int | None = None
) -> DataFrame:
    """The statement's rows, at most ``limit`` of them where one is given."""
    if not sql or not sql.strip():
        raise RefusedStatement("sql is required")
    own = scoped_session(spark, views)
    return first_rows(guarded(own, sql, views, {*JSON_FUNCTIONS, "json_length"}), limit)


def scoped_sql(
    spark: SparkSession, sql: str, load_events: Loader, as_of_ms: int,
    tenant: str | None = None, hours: int = 24, limit: int | None = None,
    extra: dict[str, Loader] | None = None,
) -> DataFrame:
    """SQL over ``scoped``: the tenant's events of the trailing hours, params as a map.

    ``extra`` adds the tenant's own tables (Parquet, JDBC) as further views.
    """
    since = as_of_ms - hours * HOUR_MS

    def scoped(own: SparkSession) -> DataFrame:
        rows = select_events(load_events(own), tenant=tenant)
        return rows.where(rows["timestamp_ms"] >= since)

    return run_scoped(spark, sql, {"scoped": scoped, **(extra or {})}, limit)


def deduped_sql(
    spark: SparkSession, sql: str, load_events: Loader, tenant: str | None = None,
    date_from: str | None = None, date_to: str | None = None, limit: int | None = None,
    extra: dict[str, Loader] | None = None,
) -> DataFrame:
    """SQL over ``deduped``: the tenant's archive rows of a date range, each event once."""

    def deduped(own: SparkSession) -> DataFrame:
        rows = select_events(load_events(own), tenant=tenant)
        kept = dedup_latest(between_dates(rows, date_from, date_to))
        return archive_rows(kept) if dict(kept.dtypes)["params"] != "string" else kept

    return run_scoped(spark, sql, {"deduped": deduped, **(extra or {})}, limit)


def describe_views(spark: SparkSession, views: dict[str, Loader]) -> dict[str, str]:
    """Column names and types of each view, for whoever writes the SQL."""
    return {name: load(spark).schema.simpleString() for name, load in views.items()}
