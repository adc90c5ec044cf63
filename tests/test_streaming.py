"""Streams replayed with availableNow, held against the batch operators on the same rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import dedup, quality, ratelimit, rollup, webhooks
from eventloom.schema import as_event_json
from eventloom.sources import testdata as td
from eventloom.sources import tiers
from eventloom.streaming import limits, sinks, source, topology, views


def keys(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def log_dir(spark, sf, tmp_path_factory):
    """Events with replays as JSON lines in time order, over several files, plus poison."""
    path = tmp_path_factory.mktemp("log")
    rows = td.replayed(spark, sf).orderBy("timestamp_ms", "event_id").select(as_event_json().alias("j"))
    lines = [r.j for r in rows.collect()]
    step = len(lines) // 4 + 1
    for i in range(4):
        part = lines[i * step : (i + 1) * step]
        if i == 1:
            part = [*part, "{not json", '{"event_id":"x1"}']
        (path / f"{i}.json").write_text("\n".join(part) + "\n")
    return str(path)


def drain(df, path, checkpoint, mode="append", sink=None):
    q = (
        df.writeStream.foreachBatch(sink or sinks.rows_sink(path))
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def test_stream_source_decodes_and_quarantines(spark, sf, log_dir, tmp_path):
    log = source.file_log(spark, log_dir, files_per_batch=1)
    drain(source.silver_stream(log), str(tmp_path / "s"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "s"))
    want = td.replayed(spark, sf)
    cols = [c for c in want.columns if c != "params"]
    assert keys(got, *cols, F.to_json("params")) == keys(want, *cols, F.to_json("params"))
    drain(source.poison_of(source.decode(log)), str(tmp_path / "q"), str(tmp_path / "c2"))
    bad = [r.value for r in spark.read.parquet(str(tmp_path / "q")).collect()]
    assert sorted(bad) == ['{"event_id":"x1"}', "{not json"]


def test_stream_dedup_keeps_each_event_once(spark, sf, log_dir, tmp_path):
    silver = source.dedup(source.silver_stream(source.file_log(spark, log_dir, 1)))
    drain(silver, str(tmp_path / "d"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "d"))
    assert keys(got, "event_id") == keys(td.silver(spark, sf), "event_id")


def test_stream_ip_limit_equals_batch(spark, sf, tmp_path):
    rows = quality.with_builtin_reason(td.silver(spark, sf))
    path = str(tmp_path / "in")
    # One file per third of the month, in time order.
    bounds = [0, 1704900000000, 1705800000000, 2**60]
    for i in range(3):
        part = rows.where((F.col("timestamp_ms") >= bounds[i]) & (F.col("timestamp_ms") < bounds[i + 1]))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    write = sinks.rows_sink(str(tmp_path / "out"))

    def limited(df, batch_id):
        for _ in range(2):  # a repeated batch does not see its own counts
            write(limits.ip_limit(df, str(tmp_path / "ips"), batch_id, 4, 43_200), batch_id)

    drain(stream, None, str(tmp_path / "c"), sink=limited)
    got = spark.read.parquet(str(tmp_path / "out")).where("cur_count > 0")
    want = quality.ip_rate_exact(rows.where("drop_reason is null"), 4, 43_200)
    assert keys(got, "event_id", "cur_count", "prev_count", F.col("drop_reason").isNotNull()) == keys(
        want, "event_id", "cur_count", "prev_count", "limited"
    )
    assert want.where("limited").count() > 0


def test_stream_token_bucket_equals_batch(spark, sf, tmp_path):
    rows = td.silver(spark, sf).withColumn("timestamp_ms", F.expr("timestamp_ms div 20000"))
    rates = spark.sql("select * from values ('t0', 1), ('t1', 2), ('t2', 1) as r(tenant_id, rate)")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    drain(limits.token_bucket(stream, rates), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ratelimit.token_bucket_admit(rows, rates, chunk_ms=5_000)
    assert keys(got, "event_id", "admitted") == keys(want, "event_id", "admitted")
    assert 0 < want.where("not admitted").count() < want.count()


HOURLY = ["tenant_id", "event_type", "hour", "count"]


def test_stream_stats_hourly_equals_batch(spark, sf, log_dir, tmp_path):
    silver = source.silver_stream(source.file_log(spark, log_dir, 1))
    path = str(tmp_path / "stats")
    drain(silver, None, str(tmp_path / "c"), sink=sinks.stats_sink(path))
    assert keys(sinks.stats_log(path).read(spark), *HOURLY) == keys(rollup.stats_hourly(td.replayed(spark, sf)), *HOURLY)


@pytest.mark.parametrize("order", [(1, 3, 0, 2), (3, 2, 1, 0), (0, 1, 1, 2, 3, 3)])
def test_counts_do_not_hang_on_order_or_repeats(spark, sf, log_dir, tmp_path, order):
    path = str(tmp_path / "stats")
    sink, log = sinks.stats_sink(path), sinks.stats_log(path)
    near = "event_hour >= '20'"
    for i in order:
        sink(source.silver_of(source.decode(spark.read.text(f"{log_dir}/{i}.json"))).where(near), i)
    want = keys(rollup.stats_hourly(td.replayed(spark, sf).where(near)), *HOURLY)
    assert keys(log.read(spark), *HOURLY) == want
    for upto in (1, 3, 3):
        topology.fold_counts(spark, log, upto)
        assert keys(log.read(spark), *HOURLY) == want
    # A batch that comes after the fold adds to it; one that is repeated does not.
    late = source.silver_of(source.decode(spark.read.text(f"{log_dir}/0.json"))).limit(5)
    for _ in range(2):
        sink(late, 4)
    assert log.read(spark).agg(F.sum("count")).head()[0] == sum(w[-1] for w in want) + late.count()


def test_folding_leaves_what_readers_hold(spark, tmp_path):
    log = sinks.stats_log(str(tmp_path / "log"))
    rows = lambda n: spark.createDataFrame([("t", None, 3600, "1970-01-01", n)], "tenant_id string, event_type string, hour long, date_path string, count long")
    for batch in range(3):
        log.add(rows(batch + 1), batch)
    held = log.read(spark)
    log.fold(spark, 1)
    assert log.expire(spark, 0) == 0
    assert [r["count"] for r in held.collect()] == [r["count"] for r in log.read(spark).collect()] == [6]
    assert log.expire(spark, 1) == 2
    assert [r["count"] for r in log.read(spark).collect()] == [6] and log.newest(spark) == 2
    log.replace(rows(0).limit(0), 2, F.col("date_path") == "1970-01-01")
    assert log.read(spark).count() == 0


def test_hot_table_knows_ids_of_any_age(spark, event, tmp_path):
    hot = str(tmp_path / "hot")
    day = 86_400_000
    first = event([{"event_id": f"e{i}", "ts": 100 * day + i} for i in range(20)])
    again = event([{"event_id": "e3", "ts": 40 * day}, {"event_id": "e4", "ts": 400 * day}, {"event_id": "new", "ts": 40 * day}])
    for batch, rows in enumerate((first, again)):
        for _ in range(2):
            sinks.hot_sink(hot)(rows, batch)
    want = [*(f"e{i}" for i in range(20)), "new"]
    assert sorted(r.event_id for r in spark.read.parquet(hot).collect()) == sorted(want)
    from eventloom.sources.deltas import KeyLog

    index = KeyLog(f"{hot}.keys", ("event_id",))
    plan = index.unseen(again.limit(1), 9)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket" in plan.split("PartitionFilters:")[1][:200]
    for _ in range(2):
        index.fold(spark, 0)
        assert sorted(r.event_id for r in spark.read.parquet(f"{hot}.keys").collect()) == sorted(want)
    assert index.unseen(again, 9).count() == 0


def test_ledger_is_pruned_by_day_and_counts_stay(spark, event, tmp_path):
    ledger, stats = str(tmp_path / "ledger"), str(tmp_path / "stats")
    day = 86_400_000
    sink = sinks.ledger_sink(ledger, stats)
    sink(event([{"event_id": f"e{i}", "ts": (1 + i) * day} for i in range(4)]), 0)
    counts = lambda: sorted((r.hour, r["count"]) for r in sinks.stats_log(stats).read(spark).collect())
    before = counts()
    days = []
    for _ in range(2):
        assert topology.prune_ledger(spark, ledger, 33 * day) == "1970-01-04"
        days.append(sorted(p.name for p in (tmp_path / "ledger").iterdir() if p.name.startswith("date")))
    assert days == [[f"date_path=1970-01-0{k}" for k in (2, 3, 4, 5)], ["date_path=1970-01-04", "date_path=1970-01-05"]]
    # A replay of a closed day is set aside, one of an open day is known, a new event counts.
    replay = [{"event_id": "e0", "ts": day}, {"event_id": "e3", "ts": 4 * day}, {"event_id": "x", "ts": 4 * day}]
    for _ in range(2):
        sink(event(replay), 1)
    assert [r.event_id for r in spark.read.parquet(f"{ledger}.late").collect()] == ["e0"]
    assert counts() == [*before[:3], (before[3][0], 2)]


def test_live_counts_drop_late_rows(spark, event, tmp_path):
    path = str(tmp_path / "in")
    link = {"tu_id": "tu_1"}
    batches = [
        [{"event_id": "a", "ts": 1_000_000, "params": link}, {"event_id": "b", "ts": 1_000_500, "params": link}],
        [{"event_id": "c", "ts": 1_200_000, "params": link}],
        [{"event_id": "late", "ts": 1_000_100, "params": link}, {"event_id": "d", "ts": 1_200_100, "params": link}],
    ]
    schema = event(batches[0]).schema
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    dropped = 0
    for rows in batches:
        event(rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = drain(views.live_counts(stream), out, checkpoint)
        dropped += sum(
            s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators
        )
    rows = [tuple(r) for r in spark.read.parquet(out).select("tu_id", "slot_ms", "count").collect()]
    assert rows == [("tu_1", 1_000_000, 2)]
    assert dropped == 1


def test_live_feed_delivers_once(spark, sf, tmp_path):
    raw_dir = str(tmp_path / "raw")
    td.silver(spark, sf).write.parquet(raw_dir)
    read = lambda: spark.readStream.schema(td.silver(spark, sf).schema).parquet(raw_dir)
    feed = views.feed(read(), read().where("user_agent <> ''"), tenant="t1", event_types="click, view")
    drain(feed, str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = td.silver(spark, sf).where("tenant_id = 't1' and event_type in ('click', 'view')")
    assert keys(got, "event_id") == keys(want, "event_id")


def test_stream_restart_resumes_without_loss_or_repeat(spark, sf, log_dir, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    write = sinks.rows_sink(out)

    def failing(df, batch_id):
        write(df, batch_id)
        if batch_id == 2:
            raise RuntimeError("lost after the write")

    def stream():
        return source.silver_stream(source.file_log(spark, log_dir, 1))

    with pytest.raises(Exception, match="lost after the write"):
        drain(stream(), out, checkpoint, sink=failing)
    drain(stream(), out, checkpoint, sink=write)
    assert keys(spark.read.parquet(out), "event_id", "timestamp_ms") == keys(
        td.replayed(spark, sf), "event_id", "timestamp_ms"
    )


def test_stream_rules_reload(spark, event, tmp_path):
    rules_path, inbox = str(tmp_path / "rules"), str(tmp_path / "in")
    columns = "rule_order int, tenant_id string, field string, operator string, value string, action string"

    def set_rules(value):
        spark.createDataFrame([(1, "t0", "ip", "equals", value, "drop")], columns).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "static").parquet(rules_path)

    sink = sinks.filter_sink(
        str(tmp_path / "clean"), str(tmp_path / "dropped"), lambda s: s.read.parquet(rules_path)
    )
    schema = event([{"event_id": "a", "ts": 1}]).schema
    for i, blocked in enumerate(["1.1.1.1", "2.2.2.2"]):
        set_rules(blocked)
        event(
            [{"event_id": f"{i}-{ip}", "ts": 1000 + i, "ip": ip} for ip in ("1.1.1.1", "2.2.2.2")]
        ).coalesce(1).write.mode("append").parquet(inbox)
        stream = quality.with_builtin_reason(spark.readStream.schema(schema).parquet(inbox))
        drain(stream, None, str(tmp_path / "c"), sink=sink)
    assert keys(spark.read.parquet(str(tmp_path / "dropped")), "event_id") == [("0-1.1.1.1",), ("1-2.2.2.2",)]


@pytest.mark.parametrize("twice", [False, True])
def test_sinks_survive_a_repeated_batch(spark, sf, tmp_path, twice):
    rows = td.replayed(spark, sf).where("date_path between '2024-01-13' and '2024-01-16'")
    halves = [rows.where("timestamp_ms < 1705276800000"), rows.where("timestamp_ms >= 1705276800000")]
    # The second half repeats a few ids of the first.
    halves[1] = halves[1].unionByName(halves[0].where("cast(event_id as int) % 50 = 0"))
    hot, ledger, stats, archive = (str(tmp_path / n) for n in ("hot", "ledger", "stats", "archive"))
    base = str(tmp_path / "warm")
    for batch_id, half in enumerate(halves):
        for _ in range(2 if twice else 1):
            sinks.hot_sink(hot)(half, batch_id)
            sinks.ledger_sink(ledger, stats)(half, batch_id)
            sinks.archive_sink(archive, base)(half, batch_id)
    unique = dedup.dedup_earliest(rows)
    assert keys(spark.read.parquet(hot), "event_id") == keys(unique, "event_id")
    assert keys(spark.read.parquet(ledger), "event_id") == keys(unique, "event_id")
    cols = ["tenant_id", "event_type", "hour", "count"]
    assert keys(sinks.stats_log(stats).read(spark), *cols) == keys(rollup.stats_hourly(unique), *cols)
    both = halves[0].unionByName(halves[1])
    assert tiers.cold_scan(spark, archive).count() == both.count()
    warm = ["tenant_id", "event_type", "date_path", "hour", "count"]
    assert keys(tiers.warm_scan(spark, base), *warm) == keys(rollup.warm_rollup(both), *warm)


def test_job_counters_and_whole_topology(spark, sf, log_dir, tmp_path):
    tables = topology.Tables(str(tmp_path))
    counters = topology.JobCounters()
    spark.streams.addListener(counters)
    try:
        log = source.file_log(spark, log_dir, 2)
        for q in (
            topology.start_filter(log, tables, lambda s: quality.active_rules(td.rules(s), td.tenants(s, sf))),
            topology.start_quarantine(log, tables),
        ):
            q.awaitTermination()
        jobs = [
            topology.start_archive(topology.clean_stream(spark, tables), tables),
            topology.start_hot(topology.clean_stream(spark, tables), tables),
            topology.start_stats(topology.clean_stream(spark, tables), tables),
            topology.start_recent(topology.clean_stream(spark, tables), tables),
            topology.start_vectors(topology.clean_stream(spark, tables), tables),
            topology.start_ledger(topology.clean_stream(spark, tables), tables),
            topology.start_webhooks(
                topology.clean_stream(spark, tables), tables, td.webhooks, lambda s: td.tenants(s, sf)
            ),
        ]
        for q in jobs:
            q.awaitTermination()
    finally:
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(counters)
    judged = quality.quality_filter(
        td.silver(spark, sf), quality.active_rules(td.rules(spark), td.tenants(spark, sf))
    )
    passed = judged.where("drop_reason is null")
    clean = spark.read.parquet(tables.path("clean"))
    assert keys(clean, "event_id") == keys(passed, "event_id")
    reasons = spark.read.parquet(tables.path("dropped"))
    assert keys(reasons, "event_id", "drop_reason") == keys(
        judged.where("drop_reason is not null"), "event_id", "drop_reason"
    )
    assert spark.read.parquet(tables.path("quarantine")).count() == 2
    assert keys(spark.read.parquet(tables.path("hot")), "event_id") == keys(clean, "event_id")
    hourly = ["tenant_id", "event_type", "hour", "count"]
    def stored():
        for name in ("stats_hourly", "ledger_stats"):
            got = sinks.stats_log(tables.path(name)).read(spark)
            assert keys(got, *hourly) == keys(rollup.stats_hourly(clean), *hourly)
        assert keys(tiers.cold_scan(spark, tables.path("archive")), "event_id") == keys(clean, "event_id")
        warm = [*tiers.ROLLUP_KEY, "count"]
        assert keys(tiers.warm_scan(spark, tables.base), *warm) == keys(rollup.warm_rollup(clean), *warm)
        recent = sinks.recent_events(spark, tables.path("recent"), 7)
        assert keys(recent, "event_id") == keys(dedup.recent_per_tenant(clean, 7), "event_id")

    stored()
    for run in range(2):
        topology.upkeep(spark, tables, td.AS_OF_MS - 10 * 86_400_000, str(tmp_path / f"staging{run}"))
    stored()
    vectors = spark.read.parquet(tables.path("vectors"))
    assert keys(vectors, "event_id") == keys(clean, "event_id") and len(vectors.head().vector) == 384
    pending = spark.read.parquet(tables.path("pending"))
    queue = webhooks.webhook_queue(clean, td.webhooks(spark), td.tenants(spark, sf))
    assert keys(pending, "webhook_id", "event_id") == keys(queue, "webhook_id", "event_id")
    # User agent reasons are counted before IP and tenant rules run.
    assert counters.totals["filter"]["read"] == dedup.dedup_latest(td.silver(spark, sf)).count()
    assert counters.totals["filter"]["dropped"] == judged.where(
        "drop_reason = 'empty_user_agent' or drop_reason like 'bot_ua%'"
    ).count()


def test_external_events_need_a_good_token(spark, tmp_path):
    tables = topology.Tables(str(tmp_path))
    inbox = str(tmp_path / "in")
    now = 1_700_000_000_000
    tokens = [("pt_good", "t1", False, 0), ("pt_old", "t1", False, 1_600_000_000), ("pt_gone", "t2", True, 0)]
    registry = spark.createDataFrame(tokens, "token string, key_prefix string, revoked boolean, expires_at long").select(
        F.sha2("token", 256).alias("token_hash"), "key_prefix", "revoked", "expires_at"
    )
    bodies = [(t, json.dumps({"event_type": "order", "params": {"key_prefix": "t9", "n": t}})) for t in ("pt_good", "pt_old", "pt_gone", "pt_no", "x")]
    rows = spark.createDataFrame(bodies, "token string, body string").selectExpr(
        "concat('e-', token) request_id", f"{now}L timestamp_ms", "'1.1.1.1' peer_ip", "cast(null as string) x_real_ip",
        "cast(null as string) x_forwarded_for", "'' user_agent", "cast(null as string) referer",
        "cast(null as string) accept_language", "'h' host", "token", "body",
    )
    rows.coalesce(1).write.parquet(inbox)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        topology.start_external(stream, tables, lambda s: registry, lambda: now).awaitTermination()
    clean = topology.clean_stream(spark, tables)
    assert clean.isStreaming
    got = spark.read.parquet(tables.path("clean")).collect()
    assert [(r.tenant_id, r.event_type, r.params["n"], r.request_path) for r in got] == [("t1", "order", "pt_good", "/ingest")]
    refused = spark.read.parquet(tables.path("refused"))
    assert keys(refused, "status") == [("expired",), ("malformed",), ("revoked",), ("unknown",)]
    assert "token" not in refused.columns


def test_webhook_signature_matches_python(spark, sf):
    import hashlib
    import hmac

    queue = webhooks.webhook_queue(td.silver(spark, sf), td.webhooks(spark), td.tenants(spark, sf))
    signed = webhooks.with_signature(queue, td.webhooks(spark)).limit(20).collect()
    for r in signed:
        secret = "s" + r["webhook_id"][-1]
        assert hmac.new(secret.encode(), r["payload"].encode(), hashlib.sha256).hexdigest() == r["signature"]
        assert json.loads(r["payload"])["params"]["key_prefix"] == r["tenant_id"]


def test_order_does_not_hang_on_arrow_batches():
    import pandas as pd

    from eventloom.streaming.limits import _in_order

    rows = pd.DataFrame({"timestamp_ms": [5, 1, 4, 2, 3, 0], "event_id": list("abcdef")})
    whole = [x.timestamp_ms.tolist() for x in _in_order(iter([rows]))]
    cut = [x.timestamp_ms.tolist() for x in _in_order(iter([rows[:2], rows[2:5], rows[5:]]))]
    assert whole == cut == [[0, 1, 2, 3, 4, 5]] and list(_in_order(iter([]))) == []
