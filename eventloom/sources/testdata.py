"""The given test tables in the shape of this package: events, dimensions, requests.

Everything here is derived by Spark from the tables in ``sf_dir``, so it grows with them;
only rules and webhooks, a handful by nature, are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import crypto
from eventloom.functions.columns import date_path, event_hour
from eventloom.operators.skew import latest_before
from eventloom.schema import SILVER_COLUMNS
from eventloom.session import configure

AS_OF_MS = 1706659200000  # 2024-01-31T00:00:00Z
GLOBAL_SECRET = "super-secret-key-change-me"

_EVENTS = """
select cast(event_id as string) event_id, tenant_id, tu_id, event_type, timestamp_ms,
  timestamp_millis(timestamp_ms) event_time,
  concat('10.0.0.', user_id % 16) ip,
  case event_id % 10 when 0 then 'Googlebot/2.1' when 1 then '' else 'Mozilla/5.0' end user_agent,
  case when event_id % 3 = 0 then null else concat('https://ref', k % 4, '.example.com/') end referer,
  'en-US' accept_language,
  case event_type when 'click' then '/t' when 'purchase' then '/p' when 'view' then '/i'
    else '/ingest' end request_path,
  'track.example.com' request_host,
  if(tu_id is null,
    map('key_prefix', tenant_id, 'click_id', click_id, 'sub1', sub1, 'geo', geo),
    map('key_prefix', tenant_id, 'tu_id', tu_id, 'click_id', click_id, 'sub1', sub1, 'geo', geo)
  ) params,
  to_json(named_struct('amount', event_id % 100,
    'currency', element_at(array('usd','eur','gbp'), cast(user_id % 3 + 1 as int)))) raw_payload,
  ad_click
from (
  select *, concat('t', user_id % 4) tenant_id, cast(user_id as string) click_id,
    case when k % 5 = 0 then null else concat('tu_', k % 8) end tu_id,
    element_at(array('google_search','facebook_ads','tiktok','email_blast','organic'),
      cast(k % 5 + 1 as int)) sub1,
    element_at(array('US','UK','DE','FR','JP','BR','AU'), cast(user_id % 7 + 1 as int)) geo
  from (select *, cast(get_json_object(props, '$.k') as int) k,
    unix_millis(cast(ts as timestamp)) timestamp_ms from {events}))
"""

_RULES = """
select * from values
  (1, 'tenant_0', 'ip', 'equals', '10.0.0.4', 'drop', true),
  (2, '*', 'user_agent', 'contains', 'GOOGLEBOT', 'drop', true),
  (3, 'tenant_1', 'param:geo', 'equals', 'UK', 'drop', true),
  (4, 'tenant_1', 'param:tu_id', 'is_empty', '', 'drop', true),
  (5, 'tenant_2', 'referer', 'not_empty', '', 'flag', true),
  (6, 'tenant_2', 'request_path', 'starts_with', '/INGEST', 'drop', true),
  (7, '*', 'event_type', 'equals', 'error', 'flag', true),
  (8, 'tenant_3', 'request_host', 'contains', 'track', 'drop', false),
  (9, 'tenant_3', 'param:nosuch', 'is_empty', '', 'flag', true),
  (10, 'tenant_3', 'param:sub1', 'starts_with', 'Goo', 'drop', true),
  (11, '*', 'user_agent', 'is_empty', '', 'drop', true),
  (12, 'tenant_0', 'color', 'equals', 'x', 'drop', true),
  (13, 'tenant_0', 'ip', 'matches', '.*', 'drop', true),
  (14, 'no_such_tenant', 'ip', 'not_empty', '', 'drop', true)
as r(rule_order, tenant_id, field, operator, value, action, active)
"""

_WEBHOOKS = """
select id, tenant_id, url, from_json(event_types, 'array<string>') event_types, secret,
  active = 1 active, filter_param_key, filter_param_value
from values
  ('wh_1', 'tenant_0', 'https://h.example.com/1', '["*"]', 's1', 1, null, null),
  ('wh_2', 'tenant_0', 'https://h.example.com/2', '["click"]', 's2', 1, 'geo', 'US'),
  ('wh_3', 'tenant_1', 'https://h.example.com/3', '["click","purchase"]', 's3', 1, 'tu_id', null),
  ('wh_4', 'tenant_2', 'https://h.example.com/4', '["*"]', 's4', 0, null, null),
  ('wh_5', 'tenant_3', 'https://h.example.com/5', '["error"]', 's5', 1, 'sub1', 'email_blast'),
  ('wh_6', 'tenant_1', 'https://h.example.com/6', '["signup"]', 's6', 1, '', '')
as w(id, tenant_id, url, event_types, secret, active, filter_param_key, filter_param_value)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    if events is None:
        events = _table(spark, sf_dir, "events").withColumn("ad_click", F.lit(None).cast("string"))
    return spark.sql(_EVENTS, events=events)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "event_time": F.timestamp_millis("timestamp_ms"),
            "date_path": date_path("timestamp_ms"),
            "event_hour": event_hour("timestamp_ms"),
        }
    ).select(*SILVER_COLUMNS)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a silver table would hold it: tenant and link in columns of their
    own, so that a query which needs no other parameter never builds the map."""
    return _dated(_rows(spark, sf_dir))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows as a replaying log leaves them: every tenth event again, 5 s later."""
    rows = _rows(spark, sf_dir)
    again = rows.where("cast(event_id as bigint) % 10 = 0").withColumn(
        "timestamp_ms", F.col("timestamp_ms") + 5000
    )
    return _dated(rows.unionByName(again))


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows whose hits carry the id of the user's latest earlier click."""
    rows = _table(spark, sf_dir, "events").selectExpr(
        "*", "unix_millis(cast(ts as timestamp)) at_ms", "cast(event_id as string) id"
    )
    own = F.when(F.col("event_type") == "click", F.col("id"))
    linked = latest_before(rows, ["user_id"], "at_ms", ["id"], own, "ad_click", 86_400_000)
    extra = F.create_map(
        F.lit("ad_click_id"), F.col("ad_click"), F.lit("page"), F.col("request_path")
    )
    hit = (F.col("event_type") != "click") & F.col("ad_click").isNotNull()
    return _dated(
        _rows(spark, sf_dir, linked).withColumn(
            "params", F.when(hit, F.map_concat("params", extra)).otherwise(F.col("params"))
        )
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr(
        "concat('tenant_', s_suppkey) id",
        "concat('t', s_suppkey) key_prefix",
        "element_at(array('free','pro','enterprise', null), cast(s_suppkey % 4 + 1 as int)) plan",
        "concat('secret-', s_suppkey) hmac_secret",
        "sha2(concat('key-', s_suppkey), 256) encryption_key",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered links: every page."""
    return _table(spark, sf_dir, "pages").selectExpr(
        "concat('tu_', page_id) id",
        "concat('tenant_', page_id % 4) tenant_id",
        "url destination",
        "1704067200 + page_id div 2 created_at",
    )


def link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination rotations: every English page was moved twice."""
    return _table(spark, sf_dir, "pages").where("contains(url, '/en/')").selectExpr(
        "concat('tu_', page_id) id",
        "explode(array(named_struct('v', 2, 'at', 1704100000), named_struct('v', 3, 'at', 1704200000))) m",
        "url",
    ).selectExpr("id", "concat(url, '/v', m.v) destination", "m.at updated_at")


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql(_RULES)


def rule_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows as callers send them, many of them wrong."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey id",
        "element_at(array('user_agent','referer','ip','event_type','request_path','request_host',"
        "'param:geo','color','param'), cast(p_partkey % 9 + 1 as int)) field",
        "element_at(array('contains','equals','is_empty','not_empty','starts_with','matches'),"
        "cast(p_size % 6 + 1 as int)) operator",
        "p_name value",
        "element_at(array('drop','flag','hide'), cast(p_partkey % 3 + 1 as int)) action",
        "p_partkey % 5 <> 0 active",
    )


def link_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, every tenth of those with a link on one that was never registered."""
    lost = F.col("tu_id").isNotNull() & (F.col("event_id").cast("long") % 10 == 3)
    return silver(spark, sf_dir).where("event_type = 'click'").withColumn(
        "tu_id", F.when(lost, F.concat(F.lit("tu_lost_"), "event_id")).otherwise(F.col("tu_id"))
    )


def webhooks(spark: SparkSession) -> DataFrame:
    return spark.sql(_WEBHOOKS)


def deliveries(queue: DataFrame) -> DataFrame:
    """A delivery log: ids divisible by 7 arrive at once, by 11 fail three times."""
    n = "cast(event_id as bigint)"
    return queue.selectExpr(
        "webhook_id",
        "event_id",
        f"explode(case when {n} % 11 = 0 then array(1, 2, 3) when {n} % 7 = 0 then array(1) "
        f"else cast(array() as array<int>) end) attempt",
    ).selectExpr(
        "concat_ws('_', event_id, webhook_id, attempt) id",
        "webhook_id",
        "event_id",
        f"case when {n} % 11 <> 0 then 200 when attempt = 3 and {n} % 2 = 0 then null else 500 end status_code",
        "attempt",
    )


def token_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "case event_id % 6 when 0 then 'Bearer' when 1 then concat('pt_lost_', user_id) "
        "else concat('pt_t', user_id % 4, '_', user_id) end token",
    )


def ingest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(
        "sha2(concat('pt_t', c_custkey % 4, '_', c_custkey), 256) token_hash",
        "concat('t', c_custkey % 4) key_prefix",
        "c_custkey % 5 = 0 revoked",
        f"case c_custkey % 7 when 0 then {AS_OF_MS // 1000 - 60} when 1 then {AS_OF_MS // 1000} "
        f"when 2 then 0 end expires_at",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access log made of page visits. Clicks by turns of five: signed well, badly, for no
    known tenant, with the global secret, not at all; some lack their destination."""
    qs = "substring_index(substring_index(url, '#', 1), '?', -1)"
    ipad, opad = crypto.pad_columns(F.col("hmac_secret"))
    pads = tenants(spark, sf_dir).select("key_prefix", ipad.alias("i"), opad.alias("o"))
    message = F.expr("case when page_id % 5 = 0 then url else concat('tu_', page_id) end")
    own = crypto.hmac_hex(F.col("i"), F.col("o"), message)
    wrong = crypto.hmac_hex(F.col("i"), F.col("o"), F.concat(message, F.lit("x")))
    shared = crypto.hmac_hex(*crypto.literal_pads(GLOBAL_SECRET), message)
    turn, under = F.expr("page_id div 5 % 5"), F.concat("key_prefix", F.lit("_"))
    sig = (
        F.when(turn == 0, F.concat(under, own))
        .when(turn == 1, F.concat(under, wrong))
        .when(turn == 2, F.concat(F.lit("zzzz_"), own))
        .when(turn == 3, shared)
    )
    return (
        _table(spark, sf_dir, "pages")
        .withColumn("qs", F.expr(f"case when contains(url, '?') then {qs} end"))
        .withColumn("key_prefix", F.expr("concat('t', page_id % 4)"))
        .join(pads, "key_prefix", "left")
        .withColumn("signature", sig)
        .selectExpr(
            "cast(page_id as string) request_id",
            "1704067200000 + page_id * 1000 timestamp_ms",
            "element_at(array('/t', concat('/t/tu_', page_id), '/p', '/i', '/health'),"
            " cast(page_id % 5 + 1 as int)) path",
            "concat_ws('&', qs, case when page_id % 5 = 0 and page_id % 11 <> 7 then concat('url=', url_encode(url)) end,"
            " case when page_id % 5 < 2 then concat('sig=', signature) end,"
            " concat('key_prefix=t', page_id % 4), 'sub1=first', 'sub1=a%20b+c') query",
            "case page_id % 3 when 0 then concat(' 10.1.0.', page_id % 7, ' , 10.9.9.9') when 1 then '' end"
            " x_forwarded_for",
            "case when page_id % 2 = 0 then concat('172.16.0.', page_id % 5) end x_real_ip",
            "concat('192.0.2.', page_id % 9) peer_ip",
            "case when page_id % 4 <> 0 then 'Mozilla/5.0' end user_agent",
            "cast(null as string) referer",
            "'en' accept_language",
            "case when page_id % 6 <> 0 then 'track.example.com' end host",
        )
    )


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click requests signed well, badly, for no known tenant, or with the global secret."""
    ipad, opad = crypto.pad_columns(F.col("hmac_secret"))
    pads = tenants(spark, sf_dir).select("key_prefix", ipad.alias("i"), opad.alias("o"))
    rows = _table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "concat('t', page_id % 4) key_prefix", "page_id % 6 kind"
    )
    own = crypto.hmac_hex(F.col("i"), F.col("o"), F.col("url"))
    wrong = crypto.hmac_hex(F.col("i"), F.col("o"), F.concat("url", F.lit("x")))
    shared = crypto.hmac_hex(*crypto.literal_pads(GLOBAL_SECRET), F.col("url"))
    kind, under = F.col("kind"), F.concat("key_prefix", F.lit("_"))
    sig = (
        F.when(kind == 0, F.concat(under, own))
        .when(kind == 1, F.concat(under, wrong))
        .when(kind == 2, F.concat(F.lit("zzzz_"), own))
        .when(kind == 3, shared)
        .when(kind == 4, F.concat(under, F.upper(own)))
        .otherwise(F.lit("deadbeef"))
    )
    return rows.join(pads, "key_prefix").select("page_id", "url", sig.alias("sig"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "concat('t', label % 4) tenant_id", "embedding vector"
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    return _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head()["embedding"]
