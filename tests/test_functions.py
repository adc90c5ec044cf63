"""Scalar building blocks against known vectors and plain Python."""

from __future__ import annotations

import hashlib
import hmac
import random

from pyspark.sql import functions as F

from eventloom.functions import crypto, urls
from eventloom.functions.columns import date_path, event_hour, hour_epoch
from eventloom.operators import links, similar
from eventloom.operators.filters import page, type_list
from eventloom.sources import testdata as td

SECRET, URL = "super-secret-key-change-me", "https://example.com/landing"
GOLDEN = "5e52f1d64a5c437a084126d3040f19a7e4f997d44015796ad5e00b7fed404b08"
KEY = "0123456789abcdef" * 4


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_hmac_known_vector(spark):
    assert one(spark, crypto.hmac_hex(*crypto.literal_pads(SECRET), F.lit(URL))) == GOLDEN


def test_hmac_secret_column_equals_python(spark):
    secrets = ["", "k", SECRET, "x" * 64, "y" * 65, "ключ-" * 30]
    rows = spark.createDataFrame([(s,) for s in secrets], "s string").coalesce(1)
    got = rows.select("s", crypto.hmac_hex(*crypto.pad_columns(F.col("s")), F.lit("msg ü")).alias("h")).collect()
    for r in got:
        assert r.h == hmac.new(r.s.encode(), "msg ü".encode(), hashlib.sha256).hexdigest()


def test_aes_round_trip_and_rejections(spark):
    seal = crypto.aes_seal(F.lit(URL), F.lit(KEY))
    blob = one(spark, seal)
    assert not set(blob) & set("+/=\n") and len(blob) == -(-(12 + len(URL) + 16) * 4 // 3)
    assert blob != one(spark, seal)
    assert one(spark, crypto.aes_open(F.lit(blob), F.lit(KEY))) == URL
    changed = blob[:-3] + ("A" if blob[-3] != "A" else "B") + blob[-2:]
    for bad, key in ((blob, "f" * 64), (changed, KEY), ("!!", KEY), ("abcde", KEY), ("", KEY)):
        assert one(spark, crypto.aes_open(F.lit(bad), F.lit(key))) is None


def test_decrypt_links_reports_bad_rows(spark):
    good = one(spark, crypto.aes_seal(F.lit(URL), F.lit(KEY)))
    rows = spark.createDataFrame([(good,), ("junk",), (None,)], "d string")
    got = {r.d: (r.destination, r.ok) for r in links.decrypt_links(rows, F.lit(KEY)).collect()}
    assert got == {good: (URL, True), "junk": (None, False), None: (None, False)}


def test_sketch_slot_equals_full_hash(spark):
    def full(text, row):
        h = (14695981039346656037 + row * 2654435761) % 2**64
        for b in text.encode():
            h = ((h ^ b) * 1099511628211) % 2**64
        return h % 65536

    rng = random.Random(3)
    texts = ["", "::1", "ü" * 3] + [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", crypto.sketch_slots(F.col("t")).alias("s")).collect():
        assert r.s == [full(r.t, i) for i in range(4)]


def test_query_params_decode_and_keep_the_last(spark):
    q = "a=1&b=x%20y+z&a=2&c&d=&=e&bad=%zz&t=p%3Dq=r"
    assert one(spark, urls.query_params(F.lit(q))) == {
        "a": "2", "b": "x y z", "c": "", "d": "", "": "e", "bad": "%zz", "t": "p=q=r",
    }
    assert one(spark, urls.query_params(F.lit(None).cast("string"))) == {}


def test_signed_link_of_a_root_with_slashes(spark):
    params = F.create_map(F.lit("offer_id"), F.lit("1 2"), F.lit("aff_id"), F.lit("ü"))
    url = one(spark, links.signed_click_url("https://t.example.com///", crypto.literal_pads(SECRET), F.lit(URL), params))
    assert url == (
        "https://t.example.com/t?url=https%3A%2F%2Fexample.com%2Flanding&sig=" + GOLDEN
        + "&aff_id=%C3%BC&offer_id=1+2"
    )


def test_append_param(spark):
    for url, want in (("https://a/b", "https://a/b?k=v"), ("https://a/b?x=1", "https://a/b?x=1&k=v")):
        assert one(spark, urls.append_param(F.lit(url), "k", F.lit("v"))) == want


def test_time_columns_ignore_the_session_zone(spark):
    rows = spark.createDataFrame([(1704067199999,), (1704067200000,)], "timestamp_ms long")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [tuple(r) for r in rows.select(date_path(), event_hour(), hour_epoch()).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [("2023-12-31", "23", 1704063600), ("2024-01-01", "00", 1704067200)]


def test_a_page_has_the_rows_asked_for(spark, sf):
    rows = td.silver(spark, sf)
    assert page(rows, limit=700).count() == 700 and page(rows, limit=None).count() == rows.count()
    assert type_list(" click, view,,") == ["click", "view"]


def test_embedding_equals_formula(spark):
    import numpy as np

    texts = ["event_type:click", "ü", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in rows.select("t", similar.embedding(F.col("t")).alias("v")).collect()}
    assert got[""] is None and got[None] is None
    for t in texts[:2]:
        data = t.encode()
        v = np.array([np.sin(data[i % len(data)] * 0.00784 + i * 0.001) for i in range(384)])
        assert len(got[t]) == 384
        assert np.allclose(got[t], v / np.linalg.norm(v), atol=1e-5)


def test_each_text_is_embedded_once(event):
    import numpy as np

    rows = event([{"event_id": str(i), "ts": i, "ip": f"10.0.0.{i % 9}", "params": {"n": "x" * (i % 70)}} for i in range(1200)])
    df = similar.vector_rows(rows.coalesce(1))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.event_id: r for r in df.collect()}
    assert len(got) == 1200
    for i in (0, 511, 512, 1199):
        data = got[str(i)].text.encode()
        v = np.array([np.sin(data[j % len(data)] * 0.00784 + j * 0.001) for j in range(384)])
        assert np.allclose(got[str(i)].vector, v / np.linalg.norm(v), atol=1e-6)


def test_similar_search(spark, sf):
    vectors, query = td.vectors(spark, sf), td.query_vector(spark, sf)
    exact = [r.vec_id for r in similar.similar_exact(vectors, query, None, 10, "vec_id").collect()]
    for bucket in (0.02, 0.5, 50.0):
        hashed = similar.similar_lsh(vectors, query, None, 10, "vec_id", bucket=bucket)
        assert [r.vec_id for r in hashed.collect()] == exact
    few = similar.similar_lsh(vectors.limit(3), query, None, 10, "vec_id", bucket=0.001)
    assert few.count() == 3


def test_distance_of_odd_vectors_is_null(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<float>")
    got = {r.id: r.d for r in rows.select("id", similar.l2_squared(F.col("v"), [1.0, 0.0]).alias("d")).collect()}
    assert got == {1: 4.0, 2: None, 3: None}
