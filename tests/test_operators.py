"""Operators against brute force on small, skewed input."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.operators import attribution, links, match, quality, ratelimit, rollup, skew
from eventloom.plans import tiers
from eventloom.sources import ingest
from eventloom.sources import testdata as td

HOUR = 3_600_000
NOW = 1000 * HOUR


def skewed(n, seed):
    """Clicks and postbacks; a third of them share one click id."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(12)}"
        rows.append(
            {
                "event_id": f"e{i:04d}", "event_type": rng.choice(["click", "postback"]),
                "ts": NOW - rng.randrange(20 * HOUR), "tenant": rng.choice(["t0", "t1"]),
                "params": {"click_id": key} if rng.random() < 0.95 else {},
            }
        )
    return rows


def brute_pairs(rows, after, first):
    out = []
    for t in rows:
        if t["event_type"] != "click" or "click_id" not in t["params"]:
            continue
        found = sorted(
            (r["ts"], r["event_id"])
            for r in rows
            if r["event_type"] == "postback" and r["tenant"] == t["tenant"]
            and r["params"].get("click_id") == t["params"]["click_id"]
            and (not after or r["ts"] >= t["ts"])
        )
        for ts, rid in (found[:1] if first else found) or [(None, None)]:
            out.append((t["ts"], t["event_id"], ts, rid))
    far = 2**62
    return sorted(out, key=lambda p: p[2:] if p[2] is not None else (far, ""))


@pytest.mark.parametrize("after,first", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("limit,offset", [(25, 0), (40, 60)])
def test_match_pairs_equal_brute_force(event, after, first, limit, offset):
    rows = skewed(240, 5)
    got = match.match_pairs(
        event(rows), NOW, limit=limit, offset=offset, require_after=after, first_only=first
    ).select("trigger_timestamp", "trigger_event_id", "result_timestamp", "result_event_id").collect()
    want = brute_pairs(rows, after, first)
    # Newest trigger first; sorting is stable, so results stay in their order.
    want = sorted(want, key=lambda p: (p[0], p[1]), reverse=True)
    by_trigger = defaultdict(list)
    for p in brute_pairs(rows, after, first):
        by_trigger[(p[0], p[1])].append(p)
    want = [p for t in sorted(by_trigger, reverse=True) for p in by_trigger[t]][offset : offset + limit]
    assert [tuple(r) for r in got] == want


def test_match_twelve_of_twenty(event):
    rows = [{"event_id": f"c{i}", "ts": NOW - 1000 + i, "params": {"click_id": f"clk_{i}"}} for i in range(20)]
    rows += [
        {"event_id": f"p{i}", "event_type": "postback", "ts": NOW - 500 + i, "params": {"click_id": f"clk_{i}"}}
        for i in range(12)
    ]
    got = match.match_summary(event(rows), NOW).head()
    assert tuple(got) == (20, 12, 8, 0.6)
    empty = match.match_summary(event(rows), NOW, trigger="nothing").head()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_skew_helpers_equal_plain_order(spark):
    rng = random.Random(9)
    rows = [
        (rng.choice(["hot", "hot", "a", "b"]), rng.randrange(5000), i, rng.choice([None, f"v{i}"]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v string")
    numbered = skew.ordinal(df, ["k"], "ts", ["id"], "pos", slice_ms=700).collect()
    before = skew.latest_before(df, ["k"], "ts", ["id"], F.col("v"), "prev", slice_ms=700).collect()
    for key in ("hot", "a", "b"):
        ordered = sorted(r for r in rows if r[0] == key)
        ordered.sort(key=lambda r: (r[1], r[2]))
        assert [r.id for r in sorted((x for x in numbered if x.k == key), key=lambda x: x.pos)] == [
            r[2] for r in ordered
        ]
        assert sorted(x.pos for x in numbered if x.k == key) == list(range(1, len(ordered) + 1))
        last, want = None, {}
        for r in ordered:
            want[r[2]] = last
            last = r[3] or last
        assert {x.id: x.prev for x in before if x.k == key} == want


def test_token_bucket_equals_sequential_replay(spark, event):
    rng = random.Random(2)
    rates = {"t0": 3, "t1": 7, "t2": 1}
    rows, at = [], defaultdict(lambda: 1_000_000)
    for i in range(1500):
        tenant = rng.choice(["t0", "t0", "t1", "t2", "t9"])
        at[tenant] += rng.choice([0, 1, 40, 90, 150, 150, 900, 5000 if i % 50 == 0 else 10])
        rows.append({"event_id": f"e{i:05d}", "ts": at[tenant], "tenant": tenant})
    want = {}
    for tenant in {r["tenant"] for r in rows}:
        rate, last = rates.get(tenant, 100), None
        for r in sorted((r for r in rows if r["tenant"] == tenant), key=lambda r: (r["ts"], r["event_id"])):
            tokens = 2000 * rate if last is None else min(tokens + (r["ts"] - last) * rate, 2000 * rate)
            last = r["ts"]
            want[r["event_id"]] = tokens >= 1000
            tokens -= 1000 * want[r["event_id"]]
    table = spark.createDataFrame(list(rates.items()), "tenant_id string, rate int")
    for chunk in (2000, 7000, 600_000):
        got = ratelimit.token_bucket_admit(event(rows), table, chunk_ms=chunk)
        assert {r.event_id: r.admitted for r in got.select("event_id", "admitted").collect()} == want
    assert 0.1 < sum(want.values()) / len(want) < 0.9


def test_first_matching_bot_pattern_names_the_reason(spark):
    agents = [p + "/1.0 x" for p in quality.BOT_UA_PATTERNS] + ["My Curl and Spider", "Mozilla/5.0", ""]
    rows = spark.createDataFrame([(a,) for a in agents], "user_agent string")
    for r in quality.with_builtin_reason(rows).collect():
        hits = [p for p in quality.BOT_UA_PATTERNS if p in r.user_agent.lower()]
        want = "empty_user_agent" if not r.user_agent else f"bot_ua:{hits[0]}" if hits else None
        assert r.drop_reason == want


def test_rules_equal_a_plain_loop(spark, sf):
    rows = td.silver(spark, sf)
    rules = quality.active_rules(td.rules(spark), td.tenants(spark, sf)).withColumn(
        "value", F.expr("case when operator not in ('is_empty', 'not_empty') then value end")
    )
    tests = {
        "contains": lambda v, w: v is not None and w.lower() in v.lower(), "equals": lambda v, w: v is not None and v == w,
        "starts_with": lambda v, w: v is not None and v.lower().startswith(w.lower()),
        "is_empty": lambda v, w: not v, "not_empty": lambda v, w: bool(v),
    }
    ordered = rules.orderBy("rule_order").collect()
    for r in quality.apply_rules(rows, rules).collect():
        hits = {"drop": [], "flag": []}
        for rule in ordered:
            name = rule.field.removeprefix("param:")
            value = r.params.get(name) if name != rule.field else r[name]
            if rule.tenant_id in ("*", r.tenant_id) and tests[rule.operator](value, rule.value):
                hits[rule.action].append(":".join(x for x in ("rule", rule.field, rule.operator, rule.value) if x is not None))
        assert (r.drop_reason, list(r.flags)) == (next(iter(hits["drop"]), None), hits["flag"])


def test_many_rules_take_the_join(spark, sf):
    rows = td.silver(spark, sf)
    many = spark.range(1000).selectExpr(
        "cast(id as int) rule_order", "concat('t', id % 5) tenant_id", "'param:click_id' field",
        "'equals' operator", "cast(id % 40 as string) value", "if(id % 3 = 0, 'flag', 'drop') action",
    )
    got = {r.event_id: r.drop_reason for r in quality.apply_rules(rows, many).collect()}
    for r in rows.collect():
        hits = [
            i for i in range(1000)
            if f"t{i % 5}" == r.tenant_id and str(i % 40) == r.params["click_id"] and i % 3
        ]
        assert got[r.event_id] == (f"rule:param:click_id:equals:{hits[0] % 40}" if hits else None)


def test_ip_limit_zero_is_off(event):
    rows = event([{"event_id": f"e{i}", "ts": 1000 + i} for i in range(50)])
    assert quality.ip_rate_exact(rows, 0).where("limited").count() == 0
    assert quality.ip_rate_exact(rows, 20).where("limited").count() == 30
    assert quality.ip_rate_sketch(rows, 20).where("limited").count() == 30


def test_unknown_clicks_start_no_journey(event):
    rows = event(
        [
            {"event_id": "c1", "ts": 10},
            {"event_id": "v1", "event_type": "pageview", "ts": 20, "params": {"ad_click_id": "c1"}},
            {"event_id": "v2", "event_type": "pageview", "ts": 30, "params": {"ad_click_id": "gone"}},
            {"event_id": "v3", "event_type": "pageview", "ts": 40, "tenant": "t1", "params": {"ad_click_id": "c1"}},
        ]
    )
    got = attribution.attribution_journey(rows).orderBy("step").collect()
    assert [(r.event_id, r.step) for r in got] == [("c1", 1), ("v1", 2)]


def test_ledger_twice_changes_nothing(event):
    ledger = rollup.ledger_rows(event([{"event_id": "a", "ts": HOUR}])).drop("timestamp_ms")
    batch = event([{"event_id": "a", "ts": 3 * HOUR}, {"event_id": "b", "ts": HOUR}, {"event_id": "b", "ts": HOUR + 9}])
    added, counts = rollup.apply_batch(ledger, batch)
    assert [r.event_id for r in added.collect()] == ["b"]
    assert [tuple(r) for r in counts.collect()] == [("t0", "click", 3600, 2)]
    again, recount = rollup.apply_batch(ledger.unionByName(added), batch)
    assert again.count() == 0 and [tuple(r) for r in recount.collect()] == [("t0", "click", 3600, 2)]


REQUEST = "request_id string, timestamp_ms long, x_forwarded_for string, x_real_ip string, peer_ip string, user_agent string, referer string, accept_language string, host string, body string, key_prefix string"


def posted(spark, *bodies):
    rows = [(f"r{i}", 5, None, None, "9.9.9.9", None, None, None, None, b, "mine") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, REQUEST)


def test_normalize_beacon(spark):
    got = ingest.normalize_beacon(
        posted(
            spark,
            '{"event_type":"pageview","key_prefix":"6vct","page":"/a","screen_width":1280,"session_id":"s"}',
            '{"event_type":"","key_prefix":"6vct"}',
            '{"event_type":"pageview"}',
            "not json",
        )
    ).collect()
    assert len(got) == 1
    assert got[0].params == {"key_prefix": "6vct", "page": "/a", "screen_width": "1280", "session_id": "s"}
    assert (got[0].request_path, got[0].ip, got[0].user_agent, got[0].request_host) == ("/t/auto", "9.9.9.9", "", "unknown")


def test_normalize_ingest_sets_the_tenant(spark):
    got = ingest.normalize_ingest(
        posted(
            spark,
            '{"event_type":"order.created","params":{"key_prefix":"theirs","o":"1"},"raw_payload":{"a":{"b":[1]}}}',
            '{"event_type":"plain"}',
            '{"event_type":""}',
        )
    ).orderBy("event_id").collect()
    assert [r.event_type for r in got] == ["order.created", "plain"]
    assert got[0].params == {"key_prefix": "mine", "o": "1"}
    assert got[0].raw_payload == '{"a":{"b":[1]}}'
    assert got[1].params == {"key_prefix": "mine"} and got[1].raw_payload is None


def test_ingest_batch_limits(spark, tmp_path):
    one = '{"event_id":"a","event_type":"click","timestamp":1,"params":{"k":"v"},"raw_payload":{"x":1}}'

    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    got = ingest.read_batch(spark, write("two.json", f"[{one},\n{one}]")).collect()
    assert len(got) == 2 and got[0].params == {"k": "v"} and got[0].raw_payload == '{"x":1}'
    with pytest.raises(ValueError, match="empty batch"):
        ingest.read_batch(spark, write("none.json", "[]"))
    with pytest.raises(ValueError, match="max 1"):
        ingest.read_batch(spark, str(tmp_path / "two.json"), max_events=1)


def test_rotation_keeps_the_latest_destination(spark):
    registry = spark.createDataFrame([("a", "t", "d0"), ("b", "t", "d0")], "id string, tenant_id string, destination string")
    changes = spark.createDataFrame([("a", "d2", 20), ("a", "d1", 10), ("zz", "d9", 5)], "id string, destination string, updated_at long")
    got = {r.id: r.destination for r in links.current_links(registry, changes).collect()}
    assert got == {"a": "d2", "b": "d0"}


def test_unique_sketches_merge_across_hours_and_tables(spark, sf):
    rows = td.silver(spark, sf).withColumn("ip", F.concat_ws(".", "ip", "event_id"))
    older, newer = rows.where("event_hour < '12'"), rows.where("event_hour >= '06'")
    both = rollup.unique_rollup(older).unionByName(rollup.unique_rollup(newer))
    got = {r.tenant_id: r.uniques for r in rollup.unique_counts(both, "tenant_id").collect()}
    want = {r.tenant_id: r.n for r in rows.groupBy("tenant_id").agg(F.countDistinct("ip").alias("n")).collect()}
    assert set(got) == set(want) and all(abs(got[t] - n) <= 0.05 * n for t, n in want.items())
    assert rollup.unique_counts(both).head()[0] == pytest.approx(sum(want.values()), rel=0.05)


def test_all_pairs_equal_a_deep_page(spark, sf):
    rows = td.silver(spark, sf)
    ask = {"as_of_ms": td.AS_OF_MS, "trigger": "click", "result": "purchase", "on": "click_id", "hours": 168}
    for more in ({}, {"require_after": True}, {"first_only": True}):
        whole = match.match_pairs(rows, limit=None, **ask, **more)
        page = match.match_pairs(rows, limit=100_000, **ask, **more)
        assert [tuple(r) for r in whole.collect()] == [tuple(r) for r in page.collect()]
        assert whole.count() > 0


def test_a_cut_range_is_warned_about(spark, sf):
    warm = rollup.warm_rollup(td.silver(spark, sf))
    with pytest.warns(tiers.RangeCut):
        tiers.warm_stats(warm, td.AS_OF_MS, date_from="2020-01-01")
