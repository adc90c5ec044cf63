"""Stored tiers: layout, repeats, damaged and older files, dimensions, ad-hoc SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.operators import dedup, rollup
from eventloom.plans import sqlscope, tiers as reports
from eventloom.plans.history import history_stats
from eventloom.sources import dims, tiers
from eventloom.sources import testdata as td
from eventloom.session import shared_dir


def keys(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def days(spark, sf):
    return td.replayed(spark, sf).where("date_path between '2024-01-14' and '2024-01-16'").cache()


WARM = ["tenant_id", "event_type", "date_path", "hour", "count"]


def test_cold_scan_reads_what_was_archived(spark, days, tmp_path):
    path = str(tmp_path / "archive")
    tiers.write_archive(days, path, 1)
    tiers.write_archive(days, path, 1)
    got = tiers.cold_events(spark, path)
    assert keys(got, "event_id", "timestamp_ms") == keys(days, "event_id", "timestamp_ms")
    assert got.schema["event_hour"].dataType.simpleString() == "string"
    pruned = got.where("tenant_id = 't1' and date_path = '2024-01-15'")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    want = history_stats(days, "date", "2024-01-15", "2024-01-15", tenant="t1")
    stored = history_stats(got, "date", "2024-01-15", "2024-01-15", tenant="t1")
    assert keys(stored, "date", "event_type", "count") == keys(want, "date", "event_type", "count")


def test_cold_scan_fills_columns_older_files_lack(spark, days, tmp_path):
    path = str(tmp_path / "archive")
    tiers.write_archive(days.where("tenant_id = 't0'"), path, 1)
    old = tiers.cold_scan(spark, path).drop("raw_payload").withColumns(
        {"tenant_id": F.lit("old"), "batch": F.lit("0")}
    )
    old.write.mode("append").partitionBy(*tiers.ARCHIVE_PARTITIONS).parquet(path)
    got = tiers.cold_scan(spark, path)
    assert got.where("tenant_id = 'old' and raw_payload is not null").count() == 0
    assert got.where("tenant_id = 't0' and raw_payload is not null").count() > 0


def test_compact_day_keeps_rows_and_merges_files(spark, days, tmp_path):
    path = str(tmp_path / "archive")
    for batch in range(3):
        tiers.write_archive(days.where(f"cast(event_id as int) % 3 = {batch}"), path, batch)
    before = keys(tiers.cold_scan(spark, path), "event_id", "timestamp_ms", "params")
    for run in range(2):
        tiers.compact_day(spark, path, str(tmp_path / f"staging{run}"), "t1", "2024-01-15")
        assert keys(tiers.cold_scan(spark, path), "event_id", "timestamp_ms", "params") == before
    day = tmp_path / "archive" / "tenant_id=t1" / "date_path=2024-01-15"
    assert [p.name for p in day.iterdir()] == ["batch=compacted"]
    assert len(list(day.rglob("*.parquet"))) == 1
    assert len(list((day.parent / "date_path=2024-01-14").iterdir())) == 3


def test_warm_scan_prunes_and_skips_a_damaged_file(spark, days, tmp_path):
    base = str(tmp_path)
    tiers.write_rollup(rollup.warm_rollup(days), base)
    assert keys(tiers.warm_scan(spark, base), *WARM) == keys(rollup.warm_rollup(days), *WARM)
    hour = next(p for p in (tmp_path / "aggregates" / "tenant_id=t1").rglob("hour=*"))
    assert len(hour.name) == len("hour=07")
    (next(hour.rglob("batch=*")) / "agg_9.parquet").write_bytes(b"not parquet at all")
    one = tiers.warm_scan(spark, base, "t1", "2024-01-14", "2024-01-15")
    want = rollup.warm_rollup(days).where("tenant_id = 't1' and date_path <= '2024-01-15'")
    assert keys(one, *WARM) == keys(want, *WARM)
    assert tiers.rollup_path("", "acme", "2026-02-09", "14") == "/aggregates/tenant_id=acme/date_path=2026-02-09/hour=14"


def test_reconcile_replaces_a_day(spark, days, tmp_path):
    archive, base = str(tmp_path / "archive"), str(tmp_path)
    tiers.write_archive(days, archive, 1)
    tiers.add_to_rollup(rollup.warm_rollup(days), base, 1)
    other = rollup.warm_rollup(days).where("date_path <> '2024-01-15'")
    want = rollup.warm_reconcile(days, "2024-01-15").unionByName(other)
    for _ in range(2):
        rollup.reconcile_day(spark, archive, base, "2024-01-15")
        assert keys(tiers.warm_scan(spark, base), *WARM) == keys(want, *WARM)


def test_merged_stats_count_each_event_once(spark, sf):
    rows = td.silver(spark, sf)
    hot, warm = rollup.stats_hourly(rows), rollup.warm_rollup(rows)
    want = keys(rows.groupBy("event_type").agg(F.count("*").alias("total")), "event_type", "total")
    for options in ({"cold": rows}, {"warm": warm, "plan": "free"}, {"warm": warm, "cold": rows, "tier": "warm"}):
        got = reports.merged_stats(hot, td.AS_OF_MS, hours=720, **options)
        assert keys(got, "event_type", "total") == want
    recent = reports.merged_stats(hot, td.AS_OF_MS, cold=rows, hours=24)
    assert recent.agg(F.sum("total")).head()[0] == rows.where(f"timestamp_ms >= {td.AS_OF_MS - 86_400_000}").count()


def test_dims_load(spark, sf, tmp_path):
    td.tenants(spark, sf).write.parquet(str(tmp_path / "tenants"))
    td.webhooks(spark).selectExpr(
        "id", "to_json(event_types) event_types", "cast(active as int) active"
    ).write.parquet(str(tmp_path / "webhooks"))
    loaded = dims.load_parquet(spark, str(tmp_path))
    assert sorted(loaded) == ["tenants", "webhooks"]
    hook = loaded["webhooks"].where("id = 'wh_3'").head()
    assert hook.event_types == ["click", "purchase"] and hook.active is True


def test_shared_dir_is_the_clusters_setting(spark):
    class Session:
        def __init__(self, named):
            self.conf = {"spark.checkpoint.dir": named} if named else {}

    assert shared_dir(Session("hdfs:///shared"), "/tmp/x") == "hdfs:///shared"
    assert shared_dir(Session(None), "/tmp/x") == "/tmp/x"
    with pytest.raises(ValueError):
        shared_dir(Session(None))


ESCAPES = [
    "SELECT * FROM events",
    "SELECT * FROM global_temp.secret",
    "SELECT * FROM (SELECT * FROM other_view)",
    "SELECT (SELECT max(event_id) FROM other_view) x FROM scoped",
    "SELECT * FROM scoped WHERE event_id IN (SELECT event_id FROM other_view)",
    "WITH a AS (SELECT * FROM other_view) SELECT * FROM a",
    "SELECT * FROM scoped UNION ALL SELECT * FROM spark_catalog.default.other",
    "SELECT * FROM parquet.`{sf}/events.parquet`",
    "DROP VIEW scoped",
    "SELECT * FROM IDENTIFIER('owned')",
    "SELECT * FROM identifier /* x */ ('global_temp.secret')",
    "EXECUTE IMMEDIATE 'select * from owned'",
    "SELECT * FROM owned WHERE 1 IN (WITH owned AS (SELECT 1 x) SELECT x FROM owned)",
    "INSERT INTO scoped VALUES (1)",
    "CREATE TABLE x AS SELECT * FROM scoped",
    "WITH a AS (SELECT 1) INSERT INTO scoped SELECT * FROM a",
    "SET spark.sql.runSQLOnFiles=true",
    "SHOW TABLES",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM scoped",
    "SELECT '--' AS c, event_id FROM IDENTIFIER('global_temp.secret')",
    "SELECT '/*' AS c, event_id FROM IDENTIFIER('global_temp.secret') WHERE '*/' <> ''",
    "SELECT * FROM IDENTIFIER('global_' || 'temp.secret')",
    "SELECT IDENTIFIER('refl' || 'ect')('java.lang.System', 'getenv', 'HOME')",
    "SELECT try_reflect('java.lang.System', 'getenv', 'HOME') FROM scoped",
    "SELECT system.builtin.reflect('java.lang.System', 'getenv', 'HOME') FROM scoped",
    "SELECT transform(event_id) USING 'cat' AS (x) FROM scoped",
    "SELECT s.event_id FROM scoped s JOIN LATERAL (SELECT * FROM global_temp.secret g WHERE g.event_id = s.event_id)",
    "SELECT * FROM scoped WHERE EXISTS (WITH c AS (TABLE owned) SELECT 1 FROM c)",
    "FROM scoped |> UNION ALL TABLE global_temp.secret",
    "WITH RECURSIVE c(n) AS (SELECT event_id FROM owned UNION ALL SELECT n FROM c WHERE false) SELECT * FROM c",
    "SELECT * FROM owned VERSION AS OF 1",
    "SELECT * FROM python_worker_logs()",
    "SELECT input_file_name() FROM scoped",
    "SELECT current_catalog(), version() FROM scoped",
    "BEGIN SELECT * FROM scoped; END",
    "CACHE TABLE x AS SELECT * FROM scoped",
    "SELECT default.json_get_str('{}', 'a') FROM scoped",
    "",
]

ALLOWED = [
    "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(n, s)",
    "SELECT n, sum(n) OVER (ORDER BY n) s FROM range(3) AS r(n)",
    "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 3) SELECT * FROM c",
    "SELECT event_type, count(DISTINCT tu_id) FILTER (WHERE tu_id IS NOT NULL) n FROM scoped GROUP BY ALL HAVING count(*) > 0 ORDER BY 1",
    "SELECT * EXCEPT (params) FROM scoped s WHERE EXISTS (SELECT 1 FROM scoped t WHERE t.event_id = s.event_id)",
    "SELECT k, v FROM scoped LATERAL VIEW explode(params) e AS k, v",
    "SELECT * FROM (SELECT event_type, tenant_id FROM scoped) PIVOT (count(*) FOR event_type IN ('click', 'view'))",
    "SELECT json_get_str('{\"a\": 1}', 'a') x, json_length('[1]') n, filter(array(1, 2), i -> i > 1) f FROM scoped",
    "FROM scoped |> WHERE event_type = 'click' |> AGGREGATE count(*) n GROUP BY tu_id",
    "(SELECT event_id FROM scoped EXCEPT SELECT event_id FROM scoped) UNION SELECT params['tu_id'] FROM scoped",
    "SELECT a.event_id, b.n FROM scoped a, LATERAL (SELECT count(*) n FROM scoped c WHERE c.tu_id = a.tu_id) b",
    "SELECT '--' c, 'IDENTIFIER(1)' d, date_format(event_time, 'yyyy') y, ceil(1.5) z, lpad('a', 2, 'b') l FROM scoped",
    "SELECT window(event_time, '1 hour').start h, approx_count_distinct(ip), percentile(timestamp_ms, 0.5) FROM scoped GROUP BY 1",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_scoped_sql_runs(spark, sf, sql):
    got = sqlscope.scoped_sql(spark, sql, lambda s: td.silver(s, sf), td.AS_OF_MS, tenant="t1", hours=168)
    assert got.count() > 0


@pytest.mark.parametrize("sql", ESCAPES)
def test_scoped_sql_refuses(spark, sf, sql, tmp_path):
    td.silver(spark, sf).createOrReplaceTempView("other_view")
    td.silver(spark, sf).createOrReplaceGlobalTempView("secret")
    if not spark.catalog.tableExists("owned"):
        td.silver(spark, sf).limit(1).write.option("path", str(tmp_path / "owned")).saveAsTable("owned")
    with pytest.raises(sqlscope.RefusedStatement):
        sqlscope.scoped_sql(
            spark, sql.replace("{sf}", sf), lambda s: td.silver(s, sf), td.AS_OF_MS, tenant="t1"
        ).collect()


def test_scoped_sql_shows_one_tenant(spark, sf):
    run = lambda sql, **kw: sqlscope.scoped_sql(
        spark, sql, lambda s: td.silver(s, sf), td.AS_OF_MS, tenant="t1", hours=168, **kw
    )
    assert [r.tenant_id for r in run("SELECT DISTINCT tenant_id FROM scoped").collect()] == ["t1"]
    named = run("WITH mine AS (SELECT * FROM scoped) SELECT count(*) n FROM mine m JOIN scoped s USING (event_id)")
    want = td.silver(spark, sf).where(f"tenant_id = 't1' and timestamp_ms >= {td.AS_OF_MS - 168 * 3_600_000}")
    assert named.head().n == want.count()
    assert run("SELECT event_id FROM scoped", limit=7).count() == 7
    assert run("SELECT event_id FROM scoped LIMIT 3", limit=7).count() == 3
    text = run("SELECT 'drop table; update x' AS note FROM scoped", limit=1).head()
    assert text.note == "drop table; update x"


def test_deduped_is_deduplicated(spark, sf):
    got = sqlscope.deduped_sql(
        spark, "SELECT count(*) n, count(DISTINCT event_id) d FROM deduped", lambda s: td.replayed(s, sf)
    ).head()
    assert got.n == got.d == dedup.dedup_latest(td.replayed(spark, sf)).count()
    assert "event_id:string" in sqlscope.describe_views(spark, {"v": lambda s: td.silver(s, sf)})["v"]


def test_test_tables_follow_the_silver_rules(spark, sf):
    from eventloom.schema import derive_silver

    given = td.silver(spark, sf)
    envelope = given.drop("tenant_id", "tu_id", "event_time", "date_path", "event_hour")
    derived = derive_silver(envelope.withColumnRenamed("timestamp_ms", "timestamp"))
    cols = [c for c in given.columns if c != "params"]
    assert keys(given, *cols, F.to_json("params")) == keys(derived, *cols, F.to_json("params"))


def test_a_damaged_rollup_is_not_folded(spark, tmp_path):
    columns = "tenant_id string, date_path string, hour string, event_type string, count long"
    new = spark.createDataFrame([("t1", "2024-01-01", "07", "click", 10)], columns)
    base = str(tmp_path)
    for batch in (1, 2):
        tiers.add_to_rollup(new, base, batch)
    for part in (tmp_path / "aggregates").rglob("batch=1/*.parquet"):
        part.write_bytes(b"no parquet")
    assert tiers.warm_scan(spark, base).head()["count"] == 10
    with pytest.raises(Exception, match="(?i)parquet|magic|FAILED_READ"):
        tiers.rollup_log(base).fold(spark, 2)


def test_archive_gains_columns_by_name(spark, days, tmp_path):
    path = str(tmp_path / "archive")
    tiers.write_archive(days.where("event_type = 'click'"), path, 0)
    wider = days.where("event_type = 'view'").withColumns({"country": F.lit("FR"), "score": F.lit(1.5)})
    tiers.write_archive(wider, path, 1)
    tiers.write_archive(days.where("event_type = 'purchase'").withColumn("score", F.lit(2.5)), path, 2)
    got = tiers.cold_scan(spark, path)
    assert got.columns[-2:] == ["country", "score"]
    assert {tuple(r) for r in got.select("event_type", "country", "score").distinct().collect()} == {
        ("click", None, None), ("view", "FR", 1.5), ("purchase", None, 2.5)
    }
    before = keys(got, "event_id", "country", "score")
    tiers.compact_day(spark, path, str(tmp_path / "staging"), "t1", "2024-01-15")
    assert keys(tiers.cold_scan(spark, path), "event_id", "country", "score") == before
    with pytest.raises(ValueError, match="score"):
        tiers.write_archive(days.withColumn("score", F.lit("high")), path, 3)
