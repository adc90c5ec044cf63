"""Mixing: targets by repeated resharing, the queue by a plain sort."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from eventloom.llm.mixing import mix
from eventloom.llm.queries import op13_mixing

WEIGHTS = (5, 2, 1)


def brute(rows):
    """Sorted (doc_id, size, source_size, target, taken) of (doc_id, source, text) rows."""
    docs = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, s, t in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in docs if x == s) for s in sources}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(sources)}
    total = sum(size.values())
    target, free = {}, list(sources)
    while True:
        left = total - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * size[s]
            free.remove(s)
    queue = []
    for k, s in enumerate(sources):
        mine = [(hashlib.md5(f"13:{'' if i is None else i}".encode()).hexdigest(), i or 0, n, row) for row, (i, x, n) in enumerate(docs) if x == s]
        at = 0
        for _ in range(3):
            for _, _, n, row in sorted(mine):
                at += n
                queue.append((Fraction(at, weight[s]), k, row))
    taken, left = defaultdict(int), total
    for _, _, row in sorted(q for q in queue if docs[q[2]][2]):
        n = docs[row][2]
        if n > left:
            break
        taken[row] += n
        left -= n
    return [(str(i), n, size[s], float(target[s]), taken[row]) for row, (i, s, n) in enumerate(docs)]


def same(df, rows):
    got = sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in df.collect())
    want = sorted(brute(rows))
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)
    return got


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(op13_mixing(spark, sf), rows)


def test_targets_are_met_within_a_document(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "big", "w " * (1 + i * 7 % 40)) for i in range(2000)]
    rows += [(5000 + i, "tiny", "one two three") for i in range(4)]
    got = same(mix(spark.createDataFrame(rows, "doc_id long, source string, text string")), rows)
    source = {str(i): s for i, s, _ in rows}
    sums, target, most = defaultdict(int), {}, defaultdict(int)
    for i, n, _, want, taken in got:
        assert taken <= 3 * n
        s = source[i]
        sums[s] += taken
        target[s] = want
        most[s] = max(most[s], n)
    assert all(abs(sums[s] - target[s]) <= 2 * most[s] for s in sums)
    assert sums["tiny"] == target["tiny"] == 36


def test_edges(spark):
    long = "word " * 50_000
    rows = [(1, "a", None), (2, "a", ""), (3, None, "x y"), (None, "b", "x"), (None, "b", "x"), (4, "b", "x y z"), (4, "b", "x")]
    rows += [(5, "c", long), (6, "d", " \t"), (7, "", "p q\x0br"), (8, "é", "z z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, target int")
    same(mix(df), rows)
    assert mix(df.limit(0)).count() == 0
    empty = mix(df.where("doc_id < 3")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in empty] == [(0, 0, 0.0, 0)] * 2


def test_reruns_agree_over_any_partitions(spark):
    rows = [(i % 300, f"s{i % 4}", "w " * (i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [sorted(map(tuple, mix(df.repartition(n)).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
