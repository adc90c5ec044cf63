"""Every batch operator as a query over the given tables: name -> (spark, sf_dir) -> rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.columns import canonical_params
from eventloom.operators import (
    attribution, audit, dedup, filters, links, match, partition, quality, ratelimit, rollup,
    similar, vector_index, webhooks,
)
from eventloom.plans import history, reports, sqlscope, stats, tiers
from eventloom.schema import archive_rows
from eventloom.session import shared_dir
from eventloom.sources import ingest
from eventloom.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = td.AS_OF_MS
QUERIES: dict[str, Query] = {}

MATCH = {"as_of_ms": AS_OF, "trigger": "click", "result": "purchase", "on": "click_id", "hours": 168}
TYPES = ("click", "purchase", "view")
IP_LIMIT, IP_WINDOW = 8, 21_600
HISTORY = {"date_from": "2024-01-05", "date_to": "2024-01-20"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _params_text(df: DataFrame) -> DataFrame:
    """Maps as sorted JSON text, so that any engine can compare them."""
    maps = [n for n, t in df.dtypes if t == "map<string,string>"]
    return df.withColumns({n: canonical_params(F.col(n)) for n in maps})


# --- sources and sinks ------------------------------------------------------------------


@query
def normalize_requests(spark, sf):
    registry = links.registry_map(td.links(spark, sf), td.tenants(spark, sf))
    return _params_text(
        ingest.normalize_requests(
            td.requests(spark, sf), td.tenants(spark, sf), td.GLOBAL_SECRET, registry
        )
    ).drop("raw_payload")


@query
def tenant_partition_counts(spark, sf):
    return partition.tenant_partition_counts(td.silver(spark, sf))


@query
def archive_table_rows(spark, sf):
    return archive_rows(td.replayed(spark, sf))


QUERIES["archive_rows"] = QUERIES.pop("archive_table_rows")


@query
def warm_rollup(spark, sf):
    return rollup.warm_rollup(td.replayed(spark, sf))


@query
def live_feed(spark, sf):
    raw = td.silver(spark, sf)
    clean = quality.with_builtin_reason(raw).where("drop_reason is null").drop("drop_reason")
    feed = filters.live_feed(raw, clean, tenant="t1", event_types="click, view,", tu_id="tu_4")
    return feed.select("event_id", "event_type", "timestamp_ms", "tu_id")


@query
def event_text(spark, sf):
    return td.silver(spark, sf).select("event_id", similar.event_text().alias("text"))


@query
def rows_as_json(spark, sf):
    return tiers.rows_as_json(rollup.stats_total(td.silver(spark, sf)))


# --- lists and windows ------------------------------------------------------------------


@query
def events_list(spark, sf):
    return _params_text(
        filters.list_events(
            td.silver(spark, sf), limit=500, offset=10, tenant="t1", event_types="click",
            param_key="geo",
        )
    )


@query
def events_since(spark, sf):
    rows = filters.list_events(td.silver(spark, sf), limit=200, since_ms=AS_OF - 259_200_000)
    return _params_text(rows)


@query
def events_history(spark, sf):
    return history.events_history(archive_rows(td.replayed(spark, sf)), **HISTORY)


@query
def event_by_id(spark, sf):
    found = filters.event_by_id(td.replayed(spark, sf), "420", "t0")
    any_tenant = filters.event_by_id(td.replayed(spark, sf), "430")
    both = found.unionByName(any_tenant)
    return both.select("event_id", "tenant_id", "event_type", "timestamp_ms")


@query
def stats_hourly_window(spark, sf):
    return stats.stats_hourly_window(
        rollup.stats_hourly(td.silver(spark, sf)), AS_OF, hours=72, tenant="t2"
    )


@query
def stats_summary(spark, sf):
    return stats.stats_summary(
        rollup.stats_hourly_by_link(td.silver(spark, sf)), AS_OF, hours=500, tu_id="tu_3"
    )


@query
def stats_param_eq(spark, sf):
    return stats.stats_by_param(td.silver(spark, sf), AS_OF, "geo", "US", hours=168)


@query
def stats_param_exists(spark, sf):
    return stats.stats_by_param(
        td.stitched(spark, sf), AS_OF, "ad_click_id", hours=100, tenant="t3"
    )


@query
def param_breakdown(spark, sf):
    return stats.param_breakdown(td.silver(spark, sf), AS_OF, "sub1", hours=168, tenant="t1")


# --- quality ----------------------------------------------------------------------------


@query
def filter_bots(spark, sf):
    return quality.with_builtin_reason(td.silver(spark, sf)).select(
        "event_id", "user_agent", "drop_reason"
    )


def _ruled(spark, sf):
    return quality.apply_rules(
        td.silver(spark, sf), quality.active_rules(td.rules(spark), td.tenants(spark, sf))
    )


@query
def filter_rules(spark, sf):
    return _ruled(spark, sf).select(
        "event_id", "tenant_id", "drop_reason", F.array_join("flags", ",").alias("flags")
    )


@query
def rules_valid(spark, sf):
    return quality.rules_valid(td.rule_requests(spark, sf))


def _judged(spark, sf):
    return quality.quality_filter(
        td.silver(spark, sf),
        quality.active_rules(td.rules(spark), td.tenants(spark, sf)),
        IP_LIMIT,
        IP_WINDOW,
    )


@query
def drop_reasons(spark, sf):
    return quality.drop_reasons(_judged(spark, sf))


@query
def drop_rate(spark, sf):
    return quality.drop_rate(_judged(spark, sf))


def _human(spark, sf):
    return quality.with_builtin_reason(td.silver(spark, sf)).where("drop_reason is null")


_RATE = ["event_id", "ip", "wid", "cur_count", "prev_count", "limited"]


@query
def ip_rate_exact(spark, sf):
    return quality.ip_rate_exact(_human(spark, sf), IP_LIMIT, IP_WINDOW).select(*_RATE)


@query
def ip_rate_cms(spark, sf):
    return quality.ip_rate_sketch(_human(spark, sf), IP_LIMIT, IP_WINDOW).select(*_RATE)


@query
def cms_ip_counts(spark, sf):
    """One address per event id, so that sketch cells are shared."""
    many = F.concat_ws(".", F.lit("10"), F.col("event_id").cast("long") % 256, F.expr(
        "cast(event_id as bigint) div 256 % 256"), F.expr("cast(event_id as bigint) div 65536"))
    return quality.cms_ip_counts(td.silver(spark, sf).withColumn("ip", many))


@query
def token_bucket_admit(spark, sf):
    """A month replayed a thousand times faster, against one or two requests per second."""
    rates = td.tenants(spark, sf).selectExpr(
        "key_prefix tenant_id", "cast(regexp_extract(key_prefix, '[0-9]+', 0) as int) % 2 + 1 rate"
    )
    rows = td.silver(spark, sf).withColumn("replay_ms", F.expr("timestamp_ms div 1000"))
    return ratelimit.token_bucket_admit(rows, rates, "replay_ms").select(
        "event_id", "tenant_id", "replay_ms", "admitted"
    )


# --- joins ------------------------------------------------------------------------------


@query
def match_pairs(spark, sf):
    return match.match_pairs(td.silver(spark, sf), limit=200, offset=20, **MATCH)


@query
def match_pairs_after(spark, sf):
    return match.match_pairs(
        td.silver(spark, sf), limit=200, require_after=True, tenant="t2", param_key="sub1", **MATCH
    )


@query
def match_pairs_first(spark, sf):
    return match.match_pairs(
        td.silver(spark, sf), limit=200, require_after=True, first_only=True, tu_id="tu_1", **MATCH
    )


@query
def match_summary(spark, sf):
    return match.match_summary(td.silver(spark, sf), **MATCH)


@query
def match_summary_after(spark, sf):
    return match.match_summary(td.silver(spark, sf), require_after=True, tu_id="tu_2", **MATCH)


@query
def attribution_journey(spark, sf):
    return attribution.attribution_journey(td.stitched(spark, sf))


@query
def attribution_funnel(spark, sf):
    return attribution.attribution_funnel(td.stitched(spark, sf))


@query
def link_registry(spark, sf):
    return links.link_registry(td.links(spark, sf), td.tenants(spark, sf), limit=200)


def _registry(spark, sf):
    current = links.current_links(td.links(spark, sf), td.link_changes(spark, sf))
    return links.registry_map(current, td.tenants(spark, sf))


@query
def resolve_links(spark, sf):
    clicks = td.link_clicks(spark, sf)
    return links.resolve_links(clicks, _registry(spark, sf)).select(
        "event_id", "tu_id", "key_prefix", "redirect"
    )


@query
def unknown_links(spark, sf):
    clicks = td.link_clicks(spark, sf)
    return links.unknown_links(clicks, _registry(spark, sf))


@query
def link_counts(spark, sf):
    hourly = rollup.stats_hourly_by_link(td.silver(spark, sf))
    return links.link_counts(td.links(spark, sf), hourly, TYPES).select(
        "id", "destination", "clicks", "purchases", "views"
    )


def _queue(spark, sf):
    return webhooks.webhook_queue(
        td.replayed(spark, sf), td.webhooks(spark), td.tenants(spark, sf)
    )


_QUEUE = ["webhook_id", "event_id", "tenant_id", "event_type", "timestamp_ms", "url"]


@query
def webhook_queue(spark, sf):
    return _queue(spark, sf).select(*_QUEUE)


@query
def webhook_pending(spark, sf):
    queue = _queue(spark, sf)
    log = td.deliveries(queue.select("webhook_id", "event_id"))
    return webhooks.webhook_pending(queue, log).select(*_QUEUE)


@query
def delivery_health(spark, sf):
    return webhooks.delivery_health(td.deliveries(_queue(spark, sf).select("webhook_id", "event_id")))


@query
def tier_route(spark, sf):
    return tiers.tier_route(rollup.stats_total(td.silver(spark, sf)), td.tenants(spark, sf))


@query
def token_audit(spark, sf):
    return audit.token_audit(
        td.token_requests(spark, sf), td.ingest_tokens(spark, sf), AS_OF
    ).select("event_id", "status", "key_prefix")


@query
def signed_link_audit(spark, sf):
    return audit.signed_link_audit(
        td.signed_requests(spark, sf), td.tenants(spark, sf), td.GLOBAL_SECRET
    ).select("page_id", "sig", "sig_prefix", "status")


@query
def page_plus_live(spark, sf):
    rows = td.silver(spark, sf).where("tu_id = 'tu_2'").select("event_id", "event_type", "timestamp_ms")
    fetched = filters.page(rows.where(F.col("timestamp_ms") < AS_OF - 7_200_000), 100)
    return filters.page_plus_live(fetched, rows)


# --- aggregations -----------------------------------------------------------------------


@query
def stats_hourly(spark, sf):
    return rollup.stats_hourly(td.silver(spark, sf))


@query
def stats_hourly_by_link(spark, sf):
    return rollup.stats_hourly_by_link(td.silver(spark, sf))


@query
def stats_total(spark, sf):
    return rollup.stats_total(td.silver(spark, sf))


def _history(name: str, group_by: str | None, **kwargs) -> None:
    def run(spark, sf):
        rows = td.replayed(spark, sf)
        return history.history_stats(rows, group_by, **HISTORY, **kwargs)

    QUERIES[name] = run


_history("history_by_type", "event_type")
_history("history_by_link", "tu_id", limit=30)
_history("history_by_date", "date", tenant="t0")
_history("history_by_hour", "hour", event_types="purchase")
_history("history_by_param", "param:geo", tu_id="tu_1")


def _warm(name: str, group_by: str | None, **kwargs) -> None:
    def run(spark, sf):
        return tiers.warm_stats(
            rollup.warm_rollup(td.replayed(spark, sf)), AS_OF, group_by, **kwargs
        )

    QUERIES[name] = run


_warm("warm_by_type", None, tenant="t1")
_warm("warm_by_date", "date", date_from="2023-12-01", date_to="2024-03-01")
_warm("warm_by_hour", "hour", date_from="2024-01-10", date_to="2024-01-12", event_type="click")


@query
def timeseries(spark, sf):
    return tiers.timeseries(
        rollup.warm_rollup(td.replayed(spark, sf)), AS_OF, "hour", tenant="t2"
    )


@query
def top_types(spark, sf):
    return tiers.top_types(rollup.warm_rollup(td.replayed(spark, sf)), AS_OF, limit=3)


@query
def merged_stats(spark, sf):
    rows = td.replayed(spark, sf)
    hot = rollup.stats_hourly(
        dedup.dedup_latest(rows.select("event_id", "timestamp_ms", "tenant_id", "event_type"))
    )
    return tiers.merged_stats(hot, AS_OF, cold=rows, hours=720)


@query
def merged_stats_warm(spark, sf):
    rows = td.replayed(spark, sf)
    hot = rollup.stats_hourly(
        dedup.dedup_latest(rows.select("event_id", "timestamp_ms", "tenant_id", "event_type"))
    )
    return tiers.merged_stats(
        hot, AS_OF, warm=rollup.warm_rollup(rows), tenant="t0", plan="free",
        date_from="2023-12-20", date_to="2024-01-28",
    )


@query
def merged_stats_link(spark, sf):
    rows = td.replayed(spark, sf)
    hot = rollup.stats_hourly_by_link(
        dedup.dedup_latest(rows.select("event_id", "timestamp_ms", "tenant_id", "tu_id", "event_type"))
    )
    return tiers.merged_stats(
        hot, AS_OF, warm=rollup.warm_rollup(rows), cold=rows, plan="free", tu_id="tu_1", hours=400
    )


_SPLIT = 1705276800000  # 2024-01-15: ledger before, batch from there on plus every replay


def _ledger_inputs(spark, sf):
    rows = td.replayed(spark, sf)
    original = td.silver(spark, sf).where(F.col("timestamp_ms") < _SPLIT)
    ledger = rollup.ledger_rows(original).drop("timestamp_ms")
    batch = rows.where((F.col("timestamp_ms") >= _SPLIT) | (F.expr("cast(event_id as bigint) % 10 = 0")))
    return ledger, batch


@query
def ledger_stats(spark, sf):
    ledger, batch = _ledger_inputs(spark, sf)
    _, recomputed = rollup.apply_batch(ledger, batch)
    return rollup.merge_stats(rollup.count_ledger(ledger), recomputed)


@query
def ledger_prune(spark, sf):
    return rollup.prune_ledger(
        rollup.ledger_rows(td.silver(spark, sf)).drop("timestamp_ms"), AS_OF + 10 * 86_400_000
    )


@query
def warm_reconcile(spark, sf):
    return rollup.warm_reconcile(td.replayed(spark, sf), "2024-01-15")


@query
def link_pivot(spark, sf):
    return rollup.link_pivot(rollup.stats_hourly_by_link(td.silver(spark, sf)), TYPES)


@query
def hour_pivot(spark, sf):
    return rollup.hour_pivot(rollup.stats_hourly(td.silver(spark, sf)), TYPES)


@query
def live_counts(spark, sf):
    return rollup.live_counts(td.silver(spark, sf), AS_OF, slots=60, slot_ms=3_600_000)


@query
def payload_sum(spark, sf):
    payload = F.try_parse_json("raw_payload")
    return (
        td.silver(spark, sf)
        .select(
            "event_type",
            F.try_variant_get(payload, "$.currency", "string").alias("currency"),
            F.try_variant_get(payload, "$.amount", "int").alias("amount"),
        )
        .groupBy("event_type", "currency")
        .agg(F.sum("amount").alias("total"))
    )


# --- windows ----------------------------------------------------------------------------


@query
def dedup_latest(spark, sf):
    return dedup.dedup_latest(
        td.replayed(spark, sf).select("event_id", "tenant_id", "event_type", "timestamp_ms")
    )


@query
def recent_per_tenant(spark, sf):
    return dedup.recent_per_tenant(td.silver(spark, sf)).select("tenant_id", "event_id", "timestamp_ms")


@query
def recent_per_link(spark, sf):
    return dedup.recent_per_link(td.silver(spark, sf)).select("tu_id", "event_id", "timestamp_ms")


# --- SQL and reports --------------------------------------------------------------------


@query
def scoped_sql(spark, sf):
    text = (
        "SELECT event_type, params['geo'] AS geo, count(*) AS n FROM scoped "
        "GROUP BY event_type, params['geo'] ORDER BY n DESC, event_type, geo"
    )
    return sqlscope.scoped_sql(
        spark, text, lambda s: td.silver(s, sf), AS_OF, tenant="t1", hours=168, limit=12
    )


@query
def scoped_sql_join(spark, sf):
    text = (
        "SELECT c.c_mktsegment AS segment, d.event_type, count(*) AS n FROM deduped d "
        "JOIN customers c ON c.c_custkey = json_get_int(d.params, 'click_id') "
        "GROUP BY c.c_mktsegment, d.event_type ORDER BY segment, event_type"
    )
    return sqlscope.deduped_sql(
        spark, text, lambda s: td.replayed(s, sf), tenant="t3", **HISTORY,
        extra={"customers": lambda s: s.read.parquet(f"{sf}/customer.parquet")},
    )


@query
def json_functions(spark, sf):
    text = (
        "SELECT json_get_str(params, 'geo') AS geo, "
        "json_contains(params, 'tu_id') AS linked, count(*) AS n, "
        "sum(json_get_int(raw_payload, 'amount')) AS amount, "
        "sum(json_get_float(raw_payload, 'currency')) AS not_a_number "
        "FROM deduped GROUP BY 1, 2"
    )
    return sqlscope.deduped_sql(spark, text, lambda s: td.silver(s, sf))


@query
def report_latest(spark, sf):
    return reports.report(filters.select_events(td.replayed(spark, sf), tenant="t0"), "latest")


# --- vectors and links ------------------------------------------------------------------


@query
def similar_exact(spark, sf):
    found = similar.similar_exact(
        td.vectors(spark, sf), td.query_vector(spark, sf), "t1", 10, "vec_id"
    )
    return found.withColumn("distance", F.round("distance", 6))


@query
def similar_lsh(spark, sf):
    found = similar.similar_lsh(
        td.vectors(spark, sf), td.query_vector(spark, sf), "t1", 10, "vec_id"
    )
    return found.withColumn("distance", F.round("distance", 6))


@query
def similar_index(spark, sf):
    """Ten nearest vectors of every hundredth one, through a stored index, none lost."""
    alone = spark.sparkContext.master.partition("[")[0] == "local"
    base = f"{shared_dir(spark, tempfile.mkdtemp(prefix='eventloom-') if alone else None)}/vectors-{uuid.uuid4().hex}"
    rows = td.vectors(spark, sf)
    index = vector_index.VectorIndex.create(rows, f"{base}/index", 16, "vec_id")
    index.add(rows, 0, "vec_id")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    found = index.search(asked, 10, nprobe=4, exact=True, scratch=f"{base}/first")
    return found.withColumn("distance", F.round("distance", 6))


@query
def event_embedding(spark, sf):
    return similar.vector_rows(td.silver(spark, sf))


@query
def build_links(spark, sf):
    registry = links.registry_map(td.links(spark, sf), td.tenants(spark, sf))
    rows = registry.withColumn(
        "params",
        F.create_map(
            F.lit("key_prefix"), F.col("key_prefix"), F.lit("aff id"), F.lit("a&b"),
        ),
    )
    built = links.build_links(rows, td.tenants(spark, sf), "https://track.example.com//")
    # A sealed link differs on every run; what it opens to does not.
    keys = td.tenants(spark, sf).select("key_prefix", "encryption_key")
    blob = F.regexp_extract("encrypted_url", "[?]d=([^&]*)", 1)
    opened = links.decrypt_links(
        built.withColumn("d", blob).withColumnRenamed("destination", "wanted").join(keys, "key_prefix"),
        F.col("encryption_key"),
    )
    return _params_text(opened).drop("encrypted_url", "d", "encryption_key", "wanted")
