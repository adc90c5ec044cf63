"""Cover tree: links and classes against all pairs."""

from __future__ import annotations

import math

import numpy as np

from eventloom.llm import cover_tree
from eventloom.llm.cover_tree import LEVELS, Tree, _deal, _judged, build, distances, links, meet, unit
from eventloom.llm.queries import op10_cover_tree


def brute(rows, cosine=0.95):
    """{position: (n_links, least id)} of (id, vector) rows."""
    fine = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[k] = np.array(v, float) / np.linalg.norm(v)
    near = {k: [j for j in fine if j != k and len(fine[j]) == len(fine[k]) and fine[j] @ fine[k] >= cosine] for k in fine}
    out = {}
    for k in range(len(rows)):
        seen, work = {k}, [k]
        while work:
            for j in near.get(work.pop(), []):
                if j not in seen:
                    seen.add(j)
                    work.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[k] = (len(near.get(k, [])), min(ids, default=None))
    return out


def compare(got, rows, **more):
    want = brute(rows, **more)
    expected = sorted((str(rows[k][0]), n, str(c)) for k, (n, c) in want.items())
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op10_cover_tree(spark, sf).collect(), rows)


def test_clusters_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.25).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(links(df, block_rows=32).collect(), rows)
    compare(links(df, block_rows=64, max_cells=2, cosine=0.8).collect(), rows, cosine=0.8)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, -0.0]), (9, [1e300, 1e299]), (9, [1e300, 1e299]), (None, [1.0, 0.01]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, links int")
    got = links(df).collect()
    fine = [(i, [1.0, 0.1] if v and v[0] == 1e300 else v) for i, v in rows]
    want = brute(fine)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted(
        (str(rows[k][0]), n, str(c)) for k, (n, c) in want.items()
    )
    assert links(df.limit(0)).count() == 0 and links(df.where("vec_id < 4")).count() == 3


def test_levels_nest_and_cover():
    x = unit(np.random.default_rng(1).normal(size=(300, 3)))
    path, gap = build(x), distances(x, x)
    for k, radius in enumerate(LEVELS):
        assert (gap[np.arange(300), path[:, k]] <= radius).all()
        centres = np.unique(path[:, k])
        assert (path[centres, k] == centres).all()
        if k:
            assert np.isin(np.unique(path[:, k - 1]), centres).all()


def test_meetings_move_no_vectors(spark, monkeypatch):
    """Random directions meet everywhere; before, each vector was sent to every meeting."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    plans, written = {}, cover_tree.written

    def spied(df, label, **more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label, **more)

    monkeypatch.setattr(cover_tree, "written", spied)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compare(links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=16, cosine=0.8).collect(), rows, cosine=0.8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plans["met"]


def test_pages_of_any_size(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 12))
    rows = [(i % 290, (centres[i % 5] + rng.normal(size=12) * 0.2).astype("f4").tolist()) for i in range(300)]
    rows += [(None, rows[3][1])] * 40 + [(400 + i, rng.normal(size=3).astype("f4").tolist()) for i in range(50)]
    for kind, size in (("float", 1), ("double", 4000)):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
        compare(links(df, block_rows=24, page_bytes=size).collect(), rows)


def test_trees_meet_in_the_pairs_of_all(spark):
    rng = np.random.default_rng(8)
    for size, spread, cosine in ((64, 1.0, 0.95), (64, 0.03, 0.95), (8, 0.3, 0.8), (2, 0.2, 0.99), (20, 0.1, -0.2)):
        centres = rng.normal(size=(7, size))
        trees = []
        for n in (350, 260):
            x = unit(centres[rng.integers(0, 7, n)] + rng.normal(size=(n, size)) * spread)
            path = build(x)
            turn = np.lexsort(path.T[::-1])
            trees.append(Tree(x[turn], np.argsort(turn)[path[turn]], np.eye(size, 15)))
        for a, b in ((trees[0], trees[1]), (trees[0], trees[0])):
            near = np.einsum("id,jd->ij", a.x, b.x) >= cosine
            want = np.argwhere(np.triu(near, 1) if a is b else near).tolist()
            got = [sorted(pair) if a is b else list(pair) for p, q in meet(a, b, math.sqrt(2 - 2 * cosine), cosine, a is b) for pair in zip(p.tolist(), q.tolist(), strict=True)]
            assert sorted(got) == want


def test_slots_are_dealt_to_pages():
    first, many, pages = _deal(np.array([0, 5, 4, 30, 2, 0, 9, 10]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 5, 6] and many.tolist() == [1, 1, 1, 3, 1, 1, 1, 1] and pages == 7


def test_equal_vectors_on_two_pages_count_once(spark):
    pages = spark.createDataFrame(
        [(0, [1], [2], [2], [5]), (1, [1], [2], [1], [3])],
        "page long, k1 array<long>, k2 array<long>, copies array<long>, first array<long>",
    )
    met = spark.createDataFrame([(0, 0, 1), (1 << 32, 0, 2)], "node long, peer long, links long")
    keyed = spark.createDataFrame([(i, 1, 2) for i in (5, 6, 3)], "vec_id long, k1 long, k2 long")
    assert sorted(map(tuple, _judged(keyed, pages, met).collect())) == [(i, 2, 3) for i in (3, 5, 6)]


def test_repeated_rows_need_no_pages(spark, monkeypatch):
    rng = np.random.default_rng(2)
    some = rng.normal(size=(20, 5)).tolist()
    rows = [(i, some[i % 20]) for i in range(400)]
    stored, written = {}, cover_tree.written
    monkeypatch.setattr(cover_tree, "written", lambda df, label, **more: stored.setdefault(label, written(df, label, **more)))
    compare(links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=8, page_bytes=1).collect(), rows)
    assert stored["pages"].count() < 10
