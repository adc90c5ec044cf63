"""Whitening: sums, deviations and components against numpy's own eigenvectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from eventloom.llm.queries import op12_whitening
from eventloom.llm.whitening import leading, negatives, whiten


def brute(rows, components=16):
    """{row number: (deviation, whitened, explained)} of (id, vector) rows of one length, and n."""
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, (_, v) in enumerate(rows)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = {}
    for k, vec in x.items():
        y = [n * c - s for c, s in zip(vec, sums)]
        out[k] = (sum(c * c for c in y), (np.array(y) / n) @ v / np.sqrt(np.maximum(e, 1e-300)), e / (z.T @ z / n).trace())
    return out, n


def compare(got, rows, components=16):
    want, n = brute(rows, components)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    width = min(components, len(rows[0][1]))
    assert sorted(by_id) == sorted(i for i, _ in rows) and len(got) == len(rows) * width
    sign = np.sign([sum(by_id[i][c + 1].whitened * want[k][1][c] for k, (i, _) in enumerate(rows)) for c in range(width)])
    for k, (i, _) in enumerate(rows):
        deviation, whitened, explained = want[k]
        for c in range(width):
            r = by_id[i][c + 1]
            assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.whitened == pytest.approx(whitened[c] * sign[c], abs=1e-7)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op12_whitening(spark, sf).collect(), rows)


def test_repeats_count_once_in_the_fit(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=5).tolist() for _ in range(30)]
    rows = [(i, base[i % 30 if i < 40 else 0]) for i in range(90)]
    df = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "vec_id long, embedding array<double>, n int, component double")
    compare(whiten(df).collect(), rows)
    compare(whiten(df, components=2).collect(), rows, components=2)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1e300, 0.0])]
    good = [(None, [1.0, 2.0]), (6, [1.0, 2.0]), (6, [3.0, -2.0]), (7, [0.5, 0.25])]
    odd = [(8, [1.0]), (9, [])]
    kind = "vec_id long, embedding array<double>"
    got = whiten(spark.createDataFrame(bad + good + odd, kind)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["6"] * 4 + ["7"] * 2 + ["None"] * 2
    assert {r.n for r in got} == {3}
    assert whiten(spark.createDataFrame(bad, kind)).count() == 0
    assert whiten(spark.createDataFrame([(9, [])], kind)).count() == 0
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, kind)).collect()
    assert len(same) == 9 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, 0.0) for r in same)
    line = whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], kind)).collect()
    assert sorted((r.component, r.whitened is None, round(abs(r.whitened or 0), 9)) for r in line) == [
        (1, False, 1.0), (1, False, 1.0), (2, True, 0), (2, True, 0)
    ]


def test_wide_numbers_stay_exact(spark):
    rows = [(1, [2.0**55, 1.0]), (2, [-(2.0**55), 3.0]), (3, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(df).collect()
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == [(1, None), (2, None), (3, 475136)]
    small = [(1, [2.0**20, 1.0]), (2, [-(2.0**20), 3.0])]
    got = whiten(spark.createDataFrame(small, "vec_id long, embedding array<double>"), components=1).collect()
    assert {r.vec_id: r.deviation for r in got} == {k: v[0] for (k, _), v in zip(small, brute(small)[0].values())}


def test_spectrum():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 40):
        a = rng.normal(size=(size, size))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in (*rng.normal(size=5) * 3, 0.0):
            assert negatives(a, shift) == (e < shift).sum()
        got = leading(a, 5)
        assert [v for v, _ in got] == pytest.approx(e[::-1][:5], abs=1e-10)
        assert all(np.abs(a @ v - x * v).max() < 1e-10 for x, v in got)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    for e in ([4.0] * 5 + [1.0] * 7, [3, 3 - 1e-9, 3 - 2e-9, 2] + [1e-7] * 8, [5.0] + [0.0] * 11):
        a = q @ np.diag(e) @ q.T
        a = (a + a.T) / 2
        got = leading(a, 6)
        v = np.array([x for _, x in got])
        assert np.abs(v @ v.T - np.eye(6)).max() < 1e-9 and [x for x, _ in got] == pytest.approx(e[:6], abs=1e-12)
    assert leading(np.zeros((3, 3)), 2)[1][0] == 0.0
