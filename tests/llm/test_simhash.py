"""SimHash: fingerprints and classes against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm.components import components
from eventloom.llm.queries import op9_simhash
from eventloom.llm.simhash import classes, drop_near_copies, fingerprint, forest, near_links


def slow_fingerprint(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def slow_classes(fps, bits=3):
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= bits]
    return union(ids, pairs)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {k: slow_fingerprint(t) for k, t in texts.items()}
    want = slow_classes(fps)
    rows = op9_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        k: (f"{fps[k]:016x}", want[k]) for k in texts
    }
    assert len(rows) == len(texts) and len(set(want.values())) < len(want)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abCÉ \t\n\x0b .", max_size=80))
def test_fingerprint(text):
    assert fingerprint(text.encode()) & (1 << 64) - 1 == slow_fingerprint(text)


def near_fps(seed, n, groups):
    rng = np.random.default_rng(seed)
    roots = rng.integers(0, 1 << 63, groups, dtype=np.int64)
    out = set()
    while len(out) < n:
        x = int(roots[rng.integers(groups)])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        out.add(x - (1 << 64) if x >= 1 << 63 else x)
    return sorted(out)


def test_links_keep_components_in_crowded_buckets(spark):
    """Fingerprints that share halves, with buckets both within and beyond their bound."""
    fps = near_fps(1, 600, 3)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = slow_classes({x: x & (1 << 64) - 1 for x in fps})
    for bound in (4096, 8):
        rows = near_links(df, 3, bound).collect()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in rows)
        got = union(fps, [tuple(r) for r in rows])
        assert got == want


def test_forest_has_no_more_links_than_members():
    fps = np.array([x & (1 << 64) - 1 for x in near_fps(2, 400, 2)], np.uint64)
    members, roots = forest(fps, 3)
    assert len(members) < len(fps)


def test_edges(spark):
    rows = [(5, None, "a"), (7, "", "a"), (None, "x y", "a"), (9, "X  y", "b"), (9, "X  y", "b"), (4, "one two three four", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in classes(docs).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(4, 4), (5, 5), (7, 5), (9, 9), (9, 9), (None, 9)]
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, None), (9, "X  y"), (4, "one two three four")])
    assert classes(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    links = spark.createDataFrame([*path, *path, (None, 3)], "x long, y long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0
