from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from eventloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("eventloom-tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def event(spark):
    """Silver rows from short descriptions: event(id, type, ms, tenant, **params)."""
    from eventloom.schema import EVENT_SCHEMA, derive_silver

    def build(rows):
        full = []
        for r in rows:
            r = dict(r)
            params = {"key_prefix": r.pop("tenant", "t0"), **r.pop("params", {})}
            full.append(
                (
                    r["event_id"], r.get("event_type", "click"), r["ts"], r.get("ip", "10.0.0.1"),
                    r.get("user_agent", "Mozilla/5.0"), r.get("referer"), r.get("accept_language"),
                    r.get("request_path", "/t"), r.get("request_host", "h"), params, r.get("raw_payload"),
                )
            )
        return derive_silver(spark.createDataFrame(full, EVENT_SCHEMA))

    return build
