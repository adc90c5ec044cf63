"""Independent SQL for the batch queries, runnable by DuckDB over the same tables.

The SQL works on plain columns where the Spark side works on the params map, and uses
different constructions where it can, so that an error is not made twice.
"""

from __future__ import annotations

AS_OF = 1706659200000
HOUR = 3_600_000

_PARAMS = (
    "'{\"click_id\":\"' || click_id || '\",\"geo\":\"' || geo || '\",\"key_prefix\":\"' || tenant_id"
    " || '\",\"sub1\":\"' || sub1 || '\"' || coalesce(',\"tu_id\":\"' || tu_id || '\"', '') || '}'"
)

_EV = f"""
ev0 AS (
  SELECT cast(event_id AS varchar) event_id, event_id n, 't' || (user_id % 4) tenant_id, event_type,
    epoch_us(ts) // 1000 timestamp_ms, '10.0.0.' || (user_id % 16) ip,
    CASE event_id % 10 WHEN 0 THEN 'Googlebot/2.1' WHEN 1 THEN '' ELSE 'Mozilla/5.0' END user_agent,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://ref' || (k % 4) || '.example.com/' END referer,
    CASE event_type WHEN 'click' THEN '/t' WHEN 'purchase' THEN '/p' WHEN 'view' THEN '/i'
      ELSE '/ingest' END request_path,
    'track.example.com' request_host,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'tu_' || (k % 8) END tu_id,
    cast(user_id AS varchar) click_id,
    (['google_search','facebook_ads','tiktok','email_blast','organic'])[k % 5 + 1] sub1,
    (['US','UK','DE','FR','JP','BR','AU'])[user_id % 7 + 1] geo,
    event_id % 100 amount, (['usd','eur','gbp'])[user_id % 3 + 1] currency
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) k FROM events)),
ev AS (SELECT *, {_PARAMS} params,
    strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') date_path,
    strftime(make_timestamp(timestamp_ms * 1000), '%H') AS "hour_of_day",
    timestamp_ms // {HOUR} * 3600 hour_epoch
  FROM ev0)"""

_RAW = (
    _EV.replace("ev0 AS", "first AS", 1).replace(
        "ev AS (SELECT",
        "ev0 AS (SELECT * FROM first UNION ALL SELECT * REPLACE (timestamp_ms + 5000 AS timestamp_ms)"
        " FROM first WHERE n % 10 = 0),\nev AS (SELECT",
        1,
    )
)

_LATEST = "QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY timestamp_ms DESC) = 1"

_TENANTS = """
tenants AS (SELECT 'tenant_' || s_suppkey id, 't' || s_suppkey key_prefix,
  (['free','pro','enterprise',NULL])[s_suppkey % 4 + 1] plan, 'secret-' || s_suppkey secret
  FROM supplier)"""

_LINKS = """
links AS (SELECT 'tu_' || page_id id, 't' || (page_id % 4) key_prefix, url destination,
  1704067200 + page_id // 2 created_at, contains(url, '/en/') moved FROM pages)"""

_CLICKS = """
clicks AS (SELECT * REPLACE (CASE WHEN tu_id IS NOT NULL AND n % 10 = 3 THEN 'tu_lost_' || n ELSE tu_id END AS tu_id)
  FROM ev WHERE event_type = 'click' AND tu_id IS NOT NULL)"""


def _sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{body}"


ORACLE: dict[str, str] = {}

# --- sources and sinks ------------------------------------------------------------------

ORACLE["normalize_requests"] = """
WITH r AS (SELECT *, page_id % 5 kind,
    CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END qs FROM pages)
SELECT cast(page_id AS varchar) event_id,
  CASE kind WHEN 2 THEN 'postback' WHEN 3 THEN 'impression' ELSE 'click' END event_type,
  1704067200000 + page_id * 1000 AS "timestamp",
  CASE WHEN page_id % 3 = 0 THEN '10.1.0.' || (page_id % 7)
    WHEN page_id % 2 = 0 THEN '172.16.0.' || (page_id % 5) ELSE '192.0.2.' || (page_id % 9) END ip,
  CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Mozilla/5.0' END user_agent,
  cast(NULL AS varchar) referer, 'en' accept_language,
  CASE kind WHEN 2 THEN '/p' WHEN 3 THEN '/i' ELSE '/t' END request_path,
  CASE WHEN page_id % 6 = 0 THEN 'unknown' ELSE 'track.example.com' END request_host,
  '{"key_prefix":"t' || (page_id % 4) || '"'
    || CASE WHEN qs LIKE 'page=%' THEN ',"page":"2","ref":"x"' ELSE '' END
    || ',"sub1":"a b c"' || CASE WHEN kind = 1 THEN ',"tu_id":"tu_' || page_id || '"' ELSE '' END
    || CASE WHEN qs LIKE 'utm%' THEN ',"utm_source":"feed"' ELSE '' END || '}' params
FROM r LEFT JOIN (SELECT DISTINCT 't' || s_suppkey tenant FROM supplier) ON tenant = 't' || (page_id % 4)
WHERE kind IN (2, 3)
  OR (kind = 0 AND page_id % 11 <> 7 AND (page_id // 5 % 5 = 3 OR (page_id // 5 % 5 = 0 AND tenant IS NOT NULL)))
  OR (kind = 1 AND tenant IS NOT NULL AND page_id // 5 % 5 IN (0, 3, 4))
"""

ORACLE["tenant_partition_counts"] = _sql(
    "SELECT tenant_id, cast(('0x' || substr(md5(tenant_id), 1, 8))::BIGINT % 24 AS int) AS \"partition\","
    " count(*) events FROM ev GROUP BY ALL", _EV)

ORACLE["archive_rows"] = _sql(
    """SELECT event_id, tenant_id, coalesce(tu_id, '_no_link') tu_id, event_type, timestamp_ms, ip,
  user_agent, referer, request_path, request_host, params,
  '{"amount":' || amount || ',"currency":"' || currency || '"}' raw_payload, date_path,
  hour_of_day event_hour FROM ev""", _RAW)

ORACLE["warm_rollup"] = _sql(
    'SELECT tenant_id, event_type, date_path, hour_of_day AS "hour", count(*) AS "count"'
    " FROM ev GROUP BY ALL", _RAW)

ORACLE["live_feed"] = _sql(
    "SELECT event_id, event_type, timestamp_ms, tu_id FROM ev"
    " WHERE tenant_id = 't1' AND event_type IN ('click', 'view') AND tu_id = 'tu_4'", _EV)

ORACLE["event_text"] = _sql(
    "SELECT event_id, 'event_type:' || event_type || ' ip:' || ip || ' user_agent:' || user_agent"
    " || ' params:' || params AS text FROM ev", _EV)

ORACLE["rows_as_json"] = _sql(
    """SELECT '{"tenant_id":"' || tenant_id || '","event_type":"' || event_type || '","total":'
  || count(*) || '}' AS json FROM ev GROUP BY tenant_id, event_type""", _EV)

# --- lists and windows ------------------------------------------------------------------

_HOT = "event_id, event_type, timestamp_ms AS \"timestamp\", ip, user_agent, referer, request_path, request_host, params"

ORACLE["events_list"] = _sql(
    f"SELECT {_HOT} FROM ev WHERE tenant_id = 't1' AND event_type = 'click' AND geo IS NOT NULL"
    " ORDER BY timestamp_ms DESC, event_id DESC LIMIT 500 OFFSET 10", _EV)

ORACLE["events_since"] = _sql(
    f"SELECT {_HOT} FROM ev WHERE timestamp_ms > {AS_OF - 259_200_000}"
    " ORDER BY timestamp_ms DESC, event_id DESC LIMIT 200", _EV)

_RANGE = "date_path BETWEEN '2024-01-05' AND '2024-01-20'"


def _ranged(where: str = "true") -> str:
    return f"kept AS (SELECT * FROM ev WHERE {_RANGE} AND {where} {_LATEST})"


ORACLE["events_history"] = _sql(
    """SELECT event_id, tenant_id, coalesce(tu_id, '_no_link') tu_id, event_type,
  timestamp_ms AS "timestamp", ip, user_agent, referer, request_path, request_host, params FROM kept
ORDER BY timestamp_ms DESC, event_id DESC LIMIT 1000""", _RAW, _ranged())

ORACLE["event_by_id"] = _sql(
    "SELECT event_id, tenant_id, event_type, max(timestamp_ms) timestamp_ms FROM ev"
    " WHERE (event_id = '420' AND tenant_id = 't0') OR event_id = '430' GROUP BY 1, 2, 3", _RAW)


def _cutoff(hours: int) -> int:
    return AS_OF // HOUR * 3600 - hours * 3600


def _series(where: str, hours: int) -> str:
    return (
        'SELECT event_type, hour_epoch AS "hour", count(*) AS "count" FROM ev'
        f" WHERE hour_epoch >= {_cutoff(hours)} AND {where} GROUP BY 1, 2"
    )


ORACLE["stats_hourly_window"] = _sql(_series("tenant_id = 't2'", 72), _EV)
ORACLE["stats_summary"] = _sql(
    f"SELECT event_type, count(*) total FROM ev WHERE tu_id = 'tu_3' AND hour_epoch >= {_cutoff(500)}"
    " GROUP BY 1", _EV)
ORACLE["stats_param_eq"] = _sql(_series("geo = 'US'", 168), _EV)

_STITCHED = """
st AS (SELECT *, CASE WHEN event_type <> 'click' THEN last_value(CASE WHEN event_type = 'click'
    THEN event_id END IGNORE NULLS) OVER (PARTITION BY click_id ORDER BY timestamp_ms, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END ad_click_id FROM ev)"""

ORACLE["stats_param_exists"] = _sql(
    _series("tenant_id = 't3' AND ad_click_id IS NOT NULL", 100).replace("FROM ev", "FROM st"),
    _EV, _STITCHED)

ORACLE["param_breakdown"] = _sql(
    "SELECT sub1 param_value, event_type, count(*) total FROM ev WHERE tenant_id = 't1'"
    f" AND hour_epoch >= {_cutoff(168)} GROUP BY 1, 2 ORDER BY total DESC, 1, 2 LIMIT 100", _EV)

# --- quality ----------------------------------------------------------------------------

_UA = "CASE user_agent WHEN '' THEN 'empty_user_agent' WHEN 'Googlebot/2.1' THEN 'bot_ua:bot' END"

ORACLE["filter_bots"] = _sql(f"SELECT event_id, user_agent, {_UA} drop_reason FROM ev", _EV)

_RULE = f"""
CASE WHEN tenant_id = 't0' AND ip = '10.0.0.4' THEN 'rule:ip:equals:10.0.0.4'
  WHEN lower(user_agent) LIKE '%googlebot%' THEN 'rule:user_agent:contains:GOOGLEBOT'
  WHEN tenant_id = 't1' AND geo = 'UK' THEN 'rule:param:geo:equals:UK'
  WHEN tenant_id = 't1' AND tu_id IS NULL THEN 'rule:param:tu_id:is_empty:'
  WHEN tenant_id = 't2' AND request_path LIKE '/ingest%' THEN 'rule:request_path:starts_with:/INGEST'
  WHEN tenant_id = 't3' AND sub1 LIKE 'goo%' THEN 'rule:param:sub1:starts_with:Goo'
  WHEN user_agent = '' THEN 'rule:user_agent:is_empty:' END"""

ORACLE["filter_rules"] = _sql(
    f"""SELECT event_id, tenant_id, {_RULE} drop_reason, concat_ws(',',
  CASE WHEN tenant_id = 't2' AND referer IS NOT NULL THEN 'rule:referer:not_empty:' END,
  CASE WHEN event_type = 'error' THEN 'rule:event_type:equals:error' END,
  CASE WHEN tenant_id = 't3' THEN 'rule:param:nosuch:is_empty:' END) flags FROM ev""", _EV)

ORACLE["rules_valid"] = """
WITH r AS (SELECT p_partkey id, (['user_agent','referer','ip','event_type','request_path',
    'request_host','param:geo','color','param'])[p_partkey % 9 + 1] field,
  (['contains','equals','is_empty','not_empty','starts_with','matches'])[p_size % 6 + 1] AS "operator",
  p_name AS "value", (['drop','flag','hide'])[p_partkey % 3 + 1] AS "action",
  p_partkey % 5 <> 0 active FROM part)
SELECT *, CASE WHEN field IN ('color', 'param') THEN 'field' WHEN "operator" = 'matches' THEN 'operator'
  WHEN "action" = 'hide' THEN 'action' END problem FROM r"""

_LIMIT, _WINDOW = 8, 21_600

_RATED = f"""
human AS (SELECT *, timestamp_ms // {_WINDOW * 1000} wid FROM ev
  WHERE user_agent NOT IN ('', 'Googlebot/2.1')),
totals AS (SELECT ip, wid, count(*) c FROM human GROUP BY 1, 2),
rated AS (SELECT h.*, count(*) OVER (PARTITION BY h.ip, h.wid ORDER BY h.timestamp_ms, h.event_id
    ROWS UNBOUNDED PRECEDING) cur_count, coalesce(t.c, 0) prev_count
  FROM human h LEFT JOIN totals t ON t.ip = h.ip AND t.wid = h.wid - 1)"""

ORACLE["ip_rate_exact"] = _sql(
    "SELECT event_id, ip, wid, cur_count, prev_count,"
    f" cur_count + prev_count > {_LIMIT} \"limited\" FROM rated", _EV, _RATED)


def _fnv(text: str, row: int) -> str:
    """The full 64-bit hash in HUGEINT arithmetic, then the slot."""
    seed = (14695981039346656037 + row * 2654435761) % 2**64
    return (
        f"cast(list_reduce(list_prepend({seed}::HUGEINT, list_transform(string_split({text}, ''),"
        " lambda c: ascii(c)::HUGEINT)),"
        " lambda h, b: ((h - h % 256 + xor((h % 256)::INT, b::INT)) * 435"
        " + ((h - h % 256 + xor((h % 256)::INT, b::INT)) % 16777216) * 1099511627776)"
        " % 18446744073709551616) % 65536 AS BIGINT)"
    )


_SKETCHED = f"""
human AS (SELECT *, timestamp_ms // {_WINDOW * 1000} wid FROM ev
  WHERE user_agent NOT IN ('', 'Googlebot/2.1')),
slots AS (SELECT ip, {', '.join(f"{_fnv('ip', i)} s{i}" for i in range(4))}
  FROM (SELECT DISTINCT ip FROM human)),
cells AS (SELECT h.event_id, h.ip, h.wid, h.timestamp_ms, u.i, u.s FROM human h
  JOIN (SELECT ip, unnest([0,1,2,3]) i, unnest([s0,s1,s2,s3]) s FROM slots) u USING (ip)),
totals AS (SELECT i, s, wid, count(*) c FROM cells GROUP BY ALL),
runs AS (SELECT c.*, count(*) OVER (PARTITION BY c.i, c.s, c.wid ORDER BY c.timestamp_ms, c.event_id
    ROWS UNBOUNDED PRECEDING) cur, coalesce(t.c, 0) prev
  FROM cells c LEFT JOIN totals t ON t.i = c.i AND t.s = c.s AND t.wid = c.wid - 1)"""

ORACLE["ip_rate_cms"] = _sql(
    "SELECT event_id, ip, wid, min(cur) cur_count, min(prev) prev_count,"
    f" min(cur) + min(prev) > {_LIMIT} \"limited\" FROM runs GROUP BY event_id, ip, wid", _EV, _SKETCHED)

ORACLE["cms_ip_counts"] = f"""
WITH ips AS (SELECT '10.' || (event_id % 256) || '.' || (event_id // 256 % 256) || '.' || (event_id // 65536) ip,
    count(*) c FROM events GROUP BY 1),
cells AS (SELECT ip, c, unnest([0,1,2,3]) i,
  unnest([{', '.join(_fnv('ip', i) for i in range(4))}]) s FROM ips),
sums AS (SELECT i, s, sum(c) t FROM cells GROUP BY 1, 2)
SELECT ip, max(c) exact, cast(min(t) AS BIGINT) estimate FROM cells JOIN sums USING (i, s) GROUP BY ip"""

_JUDGED = f"""
judged AS (SELECT event_id, {_UA} drop_reason FROM ev WHERE user_agent IN ('', 'Googlebot/2.1')
  UNION ALL SELECT event_id, CASE WHEN cur_count + prev_count > {_LIMIT} THEN 'ip_rate_limit:' || ip
    ELSE {_RULE} END FROM rated)"""

ORACLE["drop_reasons"] = _sql(
    'SELECT drop_reason, count(*) AS "count" FROM judged WHERE drop_reason IS NOT NULL GROUP BY 1'
    ' ORDER BY "count" DESC, 1 LIMIT 5', _EV, _RATED, _JUDGED)
ORACLE["drop_rate"] = _sql(
    "SELECT count(*) total, count(drop_reason) dropped, count(drop_reason) / count(*) drop_rate"
    " FROM judged", _EV, _RATED, _JUDGED)

ORACLE["token_bucket_admit"] = _sql(
    """SELECT event_id, tenant_id, replay_ms, admitted FROM walk""",
    _EV,
    """o AS (SELECT event_id, tenant_id, timestamp_ms // 1000 replay_ms,
    cast(substr(tenant_id, 2) AS int) % 2 + 1 rate, row_number() OVER (PARTITION BY tenant_id
      ORDER BY timestamp_ms // 1000, event_id) rn FROM ev)""",
    """walk AS (SELECT event_id, tenant_id, replay_ms, rate, rn, 2000 * rate - 1000 tokens, true admitted
  FROM o WHERE rn = 1
  UNION ALL SELECT event_id, tenant_id, replay_ms, rate, rn,
    CASE WHEN filled >= 1000 THEN filled - 1000 ELSE filled END, filled >= 1000 FROM (
    SELECT o.*, least(w.tokens + (o.replay_ms - w.replay_ms) * o.rate, 2000 * o.rate) filled
    FROM walk w JOIN o ON o.tenant_id = w.tenant_id AND o.rn = w.rn + 1))""",
    recursive=True)

# --- joins ------------------------------------------------------------------------------

_SINCE = AS_OF - 168 * HOUR


def _pairs(where: str, after: bool = False, first: bool = False, page: str = "LIMIT 200") -> str:
    rank = (
        "QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY r.timestamp_ms, r.event_id) = 1"
        if first else ""
    )
    return f"""
SELECT t.tenant_id, t.click_id on_value, t.event_id trigger_event_id, t.timestamp_ms trigger_timestamp,
  t.ip trigger_ip, t.user_agent trigger_user_agent, t.params trigger_params, r.event_id result_event_id,
  r.timestamp_ms result_timestamp, r.params result_params, r.timestamp_ms - t.timestamp_ms time_delta_ms,
  r.event_id IS NOT NULL matched
FROM ev t LEFT JOIN ev r ON r.event_type = 'purchase' AND r.click_id = t.click_id
  AND r.tenant_id = t.tenant_id AND r.timestamp_ms >= {_SINCE}
  {'AND r.timestamp_ms >= t.timestamp_ms' if after else ''}
WHERE t.event_type = 'click' AND t.timestamp_ms >= {_SINCE} AND {where} {rank}
ORDER BY t.timestamp_ms DESC, t.event_id DESC, r.timestamp_ms ASC NULLS LAST, r.event_id ASC {page}"""


def _summary(where: str, after: bool = False) -> str:
    return f"""
SELECT count(DISTINCT v) total_triggers, count(DISTINCT CASE WHEN hit THEN v END) matched,
  count(DISTINCT CASE WHEN NOT hit THEN v END) unmatched,
  count(DISTINCT CASE WHEN hit THEN v END) / count(DISTINCT v) match_rate
FROM (SELECT t.tenant_id || ':' || t.click_id v, r.event_id IS NOT NULL hit
  FROM ev t LEFT JOIN ev r ON r.event_type = 'purchase' AND r.click_id = t.click_id
    AND r.tenant_id = t.tenant_id AND r.timestamp_ms >= {_SINCE}
    {'AND r.timestamp_ms >= t.timestamp_ms' if after else ''}
  WHERE t.event_type = 'click' AND t.timestamp_ms >= {_SINCE} AND {where})"""


ORACLE["match_pairs"] = _sql(_pairs("true", page="LIMIT 200 OFFSET 20"), _EV)
ORACLE["match_pairs_after"] = _sql(_pairs("t.tenant_id = 't2'", after=True), _EV)
ORACLE["match_pairs_first"] = _sql(_pairs("t.tu_id = 'tu_1'", after=True, first=True), _EV)
ORACLE["match_summary"] = _sql(_summary("true"), _EV)
ORACLE["match_summary_after"] = _sql(_summary("t.tu_id = 'tu_2'", after=True), _EV)

_STEPS = """
steps AS (SELECT tenant_id, event_id ad_click_id, 0 late, event_id, event_type, timestamp_ms,
    cast(NULL AS varchar) page FROM st WHERE event_type = 'click'
  UNION ALL SELECT tenant_id, ad_click_id, 1, event_id, event_type, timestamp_ms, request_path
    FROM st WHERE ad_click_id IS NOT NULL)"""

ORACLE["attribution_journey"] = _sql(
    """SELECT tenant_id, ad_click_id, event_id, event_type, timestamp_ms, page,
  cast(NULL AS varchar) href, row_number() OVER (PARTITION BY tenant_id, ad_click_id
    ORDER BY timestamp_ms, late, event_id) step FROM steps""", _EV, _STITCHED, _STEPS)

ORACLE["attribution_funnel"] = _sql(
    """SELECT h.tenant_id, h.event_type, count(*) hits, count(DISTINCT h.ad_click_id) clicks_with,
  any_value(c.clicks) clicks, count(DISTINCT h.ad_click_id) / any_value(c.clicks) rate
FROM st h JOIN (SELECT tenant_id, count(*) clicks FROM ev WHERE event_type = 'click' GROUP BY 1) c
  USING (tenant_id) WHERE h.ad_click_id IS NOT NULL GROUP BY 1, 2""", _EV, _STITCHED)

ORACLE["link_registry"] = _sql(
    "SELECT id, destination, created_at, key_prefix FROM links ORDER BY created_at DESC, id DESC LIMIT 200",
    _LINKS)

ORACLE["resolve_links"] = _sql(
    """SELECT event_id, e.tu_id, l.key_prefix, CASE WHEN moved THEN destination || '/v3' ELSE destination END
  || CASE WHEN contains(destination, '?') THEN '&' ELSE '?' END || 'ad_click_id=' || event_id redirect
FROM clicks e LEFT JOIN links l ON l.id = e.tu_id""",
    _EV, _LINKS, _CLICKS)

ORACLE["unknown_links"] = _sql(
    """SELECT tu_id, count(*) clicks, max(timestamp_ms) last_seen_ms FROM clicks
  WHERE tu_id NOT IN (SELECT id FROM links) GROUP BY 1""", _EV, _LINKS, _CLICKS)

ORACLE["link_counts"] = _sql(
    """SELECT id, destination, count(*) FILTER (e.event_type = 'click') clicks,
  count(*) FILTER (e.event_type = 'purchase') purchases, count(*) FILTER (e.event_type = 'view') views
FROM links LEFT JOIN ev e ON e.tu_id = id GROUP BY 1, 2""", _EV, _LINKS)

_QUEUE = f"""
queue AS (SELECT w.*, d.event_id, d.tenant_id, d.event_type, d.timestamp_ms, d.n FROM
  (SELECT * FROM ev {_LATEST}) d JOIN (VALUES ('wh_1', 't0', '1'), ('wh_2', 't0', '2'), ('wh_3', 't1', '3'),
    ('wh_5', 't3', '5'), ('wh_6', 't1', '6')) w(webhook_id, t, u) ON w.t = d.tenant_id
  WHERE CASE webhook_id WHEN 'wh_1' THEN true WHEN 'wh_2' THEN event_type = 'click' AND geo = 'US'
    WHEN 'wh_3' THEN event_type IN ('click', 'purchase') AND tu_id IS NOT NULL
    WHEN 'wh_5' THEN event_type = 'error' AND sub1 = 'email_blast' ELSE event_type = 'signup' END)"""

_QUEUED = (
    "SELECT webhook_id, event_id, tenant_id, event_type, timestamp_ms,"
    " 'https://h.example.com/' || u url FROM queue"
)

ORACLE["webhook_queue"] = _sql(_QUEUED, _RAW, _QUEUE)
ORACLE["webhook_pending"] = _sql(
    f"{_QUEUED} WHERE NOT (n % 7 = 0 AND n % 11 <> 0)", _RAW, _QUEUE)
ORACLE["delivery_health"] = _sql(
    """SELECT webhook_id, count(*) events, count(*) FILTER (n % 11 <> 0) delivered,
  count(*) FILTER (n % 11 = 0) exhausted,
  cast(sum(CASE WHEN n % 11 = 0 THEN 3 ELSE 1 END) AS BIGINT) attempts,
  count(*) FILTER (n % 22 = 0) last_without_status
FROM queue WHERE n % 7 = 0 OR n % 11 = 0 GROUP BY 1""", _RAW, _QUEUE)

ORACLE["tier_route"] = _sql(
    """SELECT tenant_id, coalesce(plan, 'free') plan,
  CASE WHEN coalesce(plan, 'free') = 'free' THEN 'warm' ELSE 'cold' END tier, count(*) events
FROM ev LEFT JOIN tenants ON key_prefix = tenant_id GROUP BY 1, 2, 3""", _EV, _TENANTS)

ORACLE["token_audit"] = f"""
WITH a AS (SELECT cast(event_id AS varchar) id, event_id, user_id,
    CASE WHEN event_id % 6 = 0 THEN 'malformed' WHEN event_id % 6 = 1 OR c_custkey IS NULL THEN 'unknown'
      WHEN user_id % 5 = 0 THEN 'revoked' WHEN user_id % 7 = 0 THEN 'expired' ELSE 'valid' END status
  FROM events LEFT JOIN customer ON c_custkey = user_id)
SELECT event_id, status, CASE WHEN status = 'valid' THEN 't' || (user_id % 4) END key_prefix FROM a"""


def _hmac(secret: str, message: str) -> str:
    def pad(mask: int) -> str:
        return (
            f"unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor("
            f"('0x' || substr(rpad(hex(encode({secret})), 128, '0'), 2 * i + 1, 2))::INT, {mask}))), ''))"
        )

    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


ORACLE["signed_link_audit"] = f"""
WITH p AS (SELECT page_id, page_id % 6 kind, 't' || (page_id % 4) || '_' pre, url,
  'secret-' || (page_id % 4) secret FROM pages)
SELECT page_id, CASE kind WHEN 0 THEN pre || {_hmac('secret', 'url')}
    WHEN 1 THEN pre || {_hmac('secret', "(url || 'x')")} WHEN 2 THEN 'zzzz_' || {_hmac('secret', 'url')}
    WHEN 3 THEN {_hmac("'super-secret-key-change-me'", 'url')}
    WHEN 4 THEN pre || upper({_hmac('secret', 'url')}) ELSE 'deadbeef' END sig,
  CASE WHEN kind IN (0, 1, 4) THEN pre[:-2] WHEN kind = 2 THEN 'zzzz' END sig_prefix,
  (['valid','invalid','unknown_tenant','valid','valid','invalid'])[kind + 1] status FROM p"""

ORACLE["page_plus_live"] = _sql(
    "SELECT event_id, event_type, timestamp_ms FROM f UNION SELECT * FROM l", _EV,
    "v AS (SELECT event_id, event_type, timestamp_ms FROM ev WHERE tu_id = 'tu_2')",
    f"f AS (SELECT * FROM v WHERE timestamp_ms < {AS_OF - 7_200_000} ORDER BY 3 DESC, 1 DESC LIMIT 100)",
    "l AS (SELECT * FROM v ORDER BY timestamp_ms DESC, event_id DESC LIMIT 200)")

# --- aggregations -----------------------------------------------------------------------

ORACLE["stats_hourly"] = _sql(
    'SELECT tenant_id, event_type, hour_epoch AS "hour", count(*) AS "count" FROM ev GROUP BY ALL', _EV)
ORACLE["stats_hourly_by_link"] = _sql(
    'SELECT tenant_id, tu_id, event_type, hour_epoch AS "hour", count(*) AS "count" FROM ev'
    " WHERE tu_id IS NOT NULL GROUP BY ALL", _EV)
ORACLE["stats_total"] = _sql("SELECT tenant_id, event_type, count(*) total FROM ev GROUP BY ALL", _EV)

ORACLE["history_by_type"] = _sql(
    'SELECT event_type, count(*) AS "count" FROM kept GROUP BY 1', _RAW, _ranged())
ORACLE["history_by_link"] = _sql(
    "SELECT coalesce(tu_id, '_no_link') tu_id, event_type, count(*) AS \"count\" FROM kept GROUP BY 1, 2"
    ' ORDER BY "count" DESC, 1, 2 LIMIT 30', _RAW, _ranged())
ORACLE["history_by_date"] = _sql(
    'SELECT date_path AS "date", event_type, count(*) AS "count" FROM kept GROUP BY ALL', _RAW,
    _ranged("tenant_id = 't0'"))
ORACLE["history_by_hour"] = _sql(
    'SELECT date_path AS "date", hour_of_day AS "hour", event_type, count(*) AS "count" FROM kept GROUP BY ALL',
    _RAW, _ranged("event_type = 'purchase'"))
ORACLE["history_by_param"] = _sql(
    'SELECT geo param_value, event_type, count(*) AS "count" FROM kept GROUP BY ALL', _RAW,
    _ranged("tu_id = 'tu_1'"))

ORACLE["warm_by_type"] = _sql(
    "SELECT event_type, count(*) AS \"count\" FROM ev WHERE tenant_id = 't1' GROUP BY 1", _RAW)
ORACLE["warm_by_date"] = _sql(
    'SELECT date_path AS "date", event_type, count(*) AS "count" FROM ev GROUP BY ALL'
    ' ORDER BY "date", event_type LIMIT 1000', _RAW)
ORACLE["warm_by_hour"] = _sql(
    'SELECT date_path AS "date", hour_of_day AS "hour", event_type, count(*) AS "count" FROM ev'
    " WHERE date_path BETWEEN '2024-01-10' AND '2024-01-12' AND event_type = 'click' GROUP BY ALL"
    ' ORDER BY "date", "hour" LIMIT 1000', _RAW)
ORACLE["timeseries"] = _sql(
    'SELECT date_path AS "date", hour_of_day AS "hour", event_type, count(*) AS "count" FROM ev'
    " WHERE tenant_id = 't2' GROUP BY ALL", _RAW)
ORACLE["top_types"] = _sql(
    'SELECT event_type, count(*) AS "count" FROM ev GROUP BY 1 ORDER BY "count" DESC, 1 LIMIT 3', _RAW)

_BOUNDARY = _cutoff(168)


def _merged(archive: str, where: str, first: int, end: int) -> str:
    return f"""
SELECT event_type, cast(sum(n) AS BIGINT) total FROM (
  SELECT event_type, count(*) n FROM (SELECT * FROM ev {_LATEST})
    WHERE hour_epoch >= {max(first, _BOUNDARY)} AND hour_epoch < {end} AND {where} GROUP BY 1
  UNION ALL {archive}) GROUP BY 1"""


def _cold(where: str, first: int) -> str:
    return f"""SELECT event_type, count(*) FROM (SELECT * FROM ev WHERE hour_epoch >= {first}
    AND hour_epoch < {_BOUNDARY} AND {where} {_LATEST}) GROUP BY 1"""


_JAN29 = 1706486400  # midnight after the requested last day
ORACLE["merged_stats"] = _sql(
    _merged(_cold("true", _cutoff(720)), "true", _cutoff(720), 2**40), _RAW)
ORACLE["merged_stats_warm"] = _sql(
    _merged(
        f"SELECT event_type, count(*) FROM ev WHERE hour_epoch < {_BOUNDARY} AND tenant_id = 't0'"
        " AND date_path >= '2024-01-01' GROUP BY 1", "tenant_id = 't0'", 0, _JAN29), _RAW)
ORACLE["merged_stats_link"] = _sql(
    _merged(_cold("tu_id = 'tu_1'", _cutoff(400)), "tu_id = 'tu_1'", _cutoff(400), 2**40), _RAW)

ORACLE["ledger_stats"] = _sql(
    'SELECT tenant_id, event_type, hour_epoch AS "hour", count(*) AS "count" FROM ev GROUP BY ALL', _EV)
ORACLE["ledger_prune"] = _sql(
    f'SELECT tenant_id, event_id, event_type, hour_epoch AS "hour" FROM ev'
    f" WHERE hour_epoch >= {AS_OF // 1000 - 20 * 86_400}", _EV)
ORACLE["warm_reconcile"] = _sql(
    'SELECT tenant_id, event_type, date_path, hour_of_day AS "hour", count(*) AS "count" FROM'
    f" (SELECT * FROM ev WHERE date_path = '2024-01-15' {_LATEST}) GROUP BY ALL", _RAW)

_BY_TYPE = ", ".join(f"count(*) FILTER (event_type = '{t}') {t}s" for t in ("click", "purchase", "view"))
ORACLE["link_pivot"] = _sql(f"SELECT tu_id, {_BY_TYPE} FROM ev WHERE tu_id IS NOT NULL GROUP BY 1", _EV)
ORACLE["hour_pivot"] = _sql(f'SELECT hour_epoch AS "hour", {_BY_TYPE} FROM ev GROUP BY 1', _EV)

ORACLE["live_counts"] = _sql(
    f"""SELECT g.tu_id, g.slot, count(r.tu_id) AS "count" FROM
  (SELECT DISTINCT tu_id, cast(unnest(range(60)) AS int) slot FROM r) g LEFT JOIN r
  ON r.tu_id = g.tu_id AND r.slot = g.slot GROUP BY 1, 2""", _EV,
    f"""r AS (SELECT tu_id, greatest(59 - ({AS_OF} - timestamp_ms) // {HOUR}, 0) slot FROM ev
  WHERE event_type = 'click' AND tu_id IS NOT NULL AND timestamp_ms BETWEEN {AS_OF - 60 * HOUR} AND {AS_OF})""")

ORACLE["payload_sum"] = _sql(
    "SELECT event_type, currency, cast(sum(amount) AS BIGINT) total FROM ev GROUP BY 1, 2", _EV)

# --- windows ----------------------------------------------------------------------------

ORACLE["dedup_latest"] = _sql(
    "SELECT event_id, tenant_id, event_type, max(timestamp_ms) timestamp_ms FROM ev GROUP BY 1, 2, 3", _RAW)
ORACLE["recent_per_tenant"] = _sql(
    "SELECT tenant_id, event_id, timestamp_ms FROM ev QUALIFY row_number() OVER (PARTITION BY tenant_id"
    " ORDER BY timestamp_ms DESC, event_id DESC) <= 1000", _EV)
ORACLE["recent_per_link"] = _sql(
    "SELECT tu_id, event_id, timestamp_ms FROM ev WHERE tu_id IS NOT NULL QUALIFY row_number() OVER"
    " (PARTITION BY tu_id ORDER BY timestamp_ms DESC, event_id DESC) <= 20", _EV)

# --- SQL, reports, vectors --------------------------------------------------------------

ORACLE["scoped_sql"] = _sql(
    f"SELECT event_type, geo, count(*) n FROM ev WHERE tenant_id = 't1' AND timestamp_ms >= {_SINCE}"
    " GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 12", _EV)
ORACLE["scoped_sql_join"] = _sql(
    "SELECT c_mktsegment segment, event_type, count(*) n FROM kept JOIN customer ON"
    " cast(c_custkey AS varchar) = click_id GROUP BY 1, 2", _RAW, _ranged("tenant_id = 't3'"))
ORACLE["json_functions"] = _sql(
    "SELECT geo, tu_id IS NOT NULL linked, count(*) n, cast(sum(amount) AS BIGINT) amount,"
    " cast(NULL AS DOUBLE) not_a_number FROM ev GROUP BY 1, 2", _EV)
ORACLE["report_latest"] = _sql(
    f"""SELECT event_id, event_type, timestamp_ms, ip, user_agent FROM
  (SELECT * FROM ev WHERE tenant_id = 't0' {_LATEST}) ORDER BY timestamp_ms DESC, event_id DESC LIMIT 20""",
    _RAW)

ORACLE["similar_exact"] = """
WITH q AS (SELECT embedding::DOUBLE[] q FROM embeddings WHERE vec_id = 7)
SELECT vec_id, 't' || (label % 4) tenant_id,
  round(list_distance(embedding::DOUBLE[], (SELECT q FROM q)), 6) distance
FROM embeddings WHERE label % 4 = 1 ORDER BY list_distance(embedding::DOUBLE[], (SELECT q FROM q)), vec_id
LIMIT 10"""

ORACLE["similar_lsh"] = ORACLE["similar_exact"]

ORACLE["similar_index"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), d AS (
  SELECT q.vec_id query_id, v.vec_id id, list_distance(q.e, v.e) d
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) n FROM d)
SELECT query_id, id, round(d, 6) distance, n::INT "rank" FROM r WHERE n <= 10"""

# The texts are ASCII here: a character is a byte.
ORACLE["event_embedding"] = _sql(
    """SELECT event_id, tenant_id, event_type, timestamp_ms, text, list_transform(v, lambda x: (x / size)::FLOAT) vector
FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) size
  FROM (SELECT *, list_transform(range(384), lambda i: sin(ord(text[i % length(text) + 1]) * 0.00784 + i * 0.001)) v
    FROM (SELECT *, 'event_type:' || event_type || ' ip:' || ip || ' user_agent:' || user_agent
      || ' params:' || params AS text FROM ev)))""", _EV)

ORACLE["build_links"] = f"""
WITH l AS (SELECT 't' || (page_id % 4) key_prefix, 'secret-' || (page_id % 4) secret, 'tu_' || page_id tu_id,
  url destination, 'aff+id=a%26b&key_prefix=t' || (page_id % 4) tail FROM pages)
SELECT key_prefix, tu_id, destination, '{{"aff id":"a&b","key_prefix":"' || key_prefix || '"}}' params,
  'https://track.example.com/t?url=' || url_encode(destination) || '&sig=' || key_prefix || '_'
    || {_hmac('secret', 'destination')} || '&' || tail signed_url,
  'https://track.example.com/t/' || tu_id || '?sig=' || key_prefix || '_' || {_hmac('secret', 'tu_id')}
    || '&' || tail tracked_url,
  'https://track.example.com/p?' || tail postback_url, 'https://track.example.com/i?' || tail impression_url,
  true ok
FROM l"""
