"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import connect, differences


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, sf, name):
    assert differences(spark, db, name, sf) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
