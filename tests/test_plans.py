"""What Spark plans: nothing multiplies, filters and columns reach the scan, ranks are cut early."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries
from eventloom.operators import dedup, filters, match, rollup, similar, webhooks
from eventloom.plans.history import history_stats
from eventloom.sources import testdata as td


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    """Silver as a stored table."""
    path = str(tmp_path_factory.mktemp("silver") / "t")
    td.silver(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_query_pairs_rows_without_a_key(spark, sf, name):
    text = plan(queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def scans(df):
    return [line for line in plan(df).splitlines() if "FileScan" in line]


def test_rollup_reads_three_columns_and_combines_before_the_shuffle(stored):
    df = rollup.stats_hourly(stored)
    (scan,) = scans(df)
    assert "ReadSchema: struct<tenant_id:string,event_type:string,timestamp_ms:bigint>" in scan
    assert plan(df).count("HashAggregate") == 2


def test_filters_reach_the_scan(stored):
    (scan,) = scans(filters.list_events(stored, tenant="t1", event_types="click", tu_id="tu_1", since_ms=5))
    for pushed in ("EqualTo(tenant_id,t1)", "EqualTo(event_type,click)", "EqualTo(tu_id,tu_1)", "GreaterThan(timestamp_ms,5)"):
        assert pushed in scan


def test_history_counts_leave_the_params_unread(stored):
    (scan,) = scans(history_stats(stored, "date", "2024-01-05", "2024-01-20", tenant="t1"))
    assert "params" not in scan.split("ReadSchema")[1]


@pytest.mark.parametrize("fn", [dedup.dedup_latest, dedup.recent_per_tenant, dedup.recent_per_link])
def test_ranks_are_cut_in_the_map_tasks(stored, fn):
    text = plan(fn(stored))
    # The plan prints from the result down: the cut below the exchange is the map-side one.
    assert text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")


def test_match_page_sends_few_results_through_the_shuffle(stored):
    text = plan(match.match_pairs(stored, td.AS_OF_MS, result="purchase", hours=168))
    assert text.count("WindowGroupLimit") == 2
    # Nothing runs while planning: triggers are read for the page and for its keys, results once.
    assert len([line for line in text.splitlines() if "FileScan" in line]) == 3


def test_no_task_gets_all_events_of_a_tenant(spark, stored, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(webhooks.webhook_queue(stored, td.webhooks(spark), td.tenants(spark, sf)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("BroadcastHashJoin [tenant_id") == 2
    assert not re.search(r"SortMergeJoin \[tenant_id#\d+\], \[tenant_id#", text)


def test_match_summary_is_one_pass(stored):
    assert len(scans(match.match_summary(stored, td.AS_OF_MS, result="purchase"))) == 1


def test_pages_keep_a_top_list_per_task(stored):
    assert "TakeOrderedAndProject" in plan(filters.page(stored))


def test_functions_travel_by_value():
    from pyspark import cloudpickle

    from eventloom.streaming.limits import _bucket

    assert len(cloudpickle.dumps(_bucket)) > 500
