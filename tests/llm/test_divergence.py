"""Divergence audit: every row against plain Python arithmetic."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from eventloom.llm import divergence
from eventloom.llm.queries import op11_divergence


def brute(rows, min_docs=10, smooth=2, scale=1_000_000_000, top=10):
    """Rows of the audit from (text, lang, source) tuples."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    used, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        groups[lang].add(source)
        used[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, d in docs[lang].items() if d >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update(used[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept) + smooth * len(kept)
            return {t: 1 + scale * (counts[t] + smooth) // total for t in kept}

        of_lang, of = shares(whole), {s: shares(used[lang, s]) for s in sources}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(gap(of[s][t], of[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(of[s][t], of_lang[t]), t) for t in kept if used[lang, s][t] and of[s][t] > of_lang[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found if part == "pair" else found[:top], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def same(df, rows, **more):
    got = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, **more)
    return got


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(op11_divergence(spark, sf), [(r.text, r.lang, r.source) for r in docs.collect()])


def test_shards_and_tiles_add_up(spark):
    rows = [(f"common word{i % 7} Word{i % 3}'s Straße {'x' * (i % 5)}", "de", f"s{i % 9}") for i in range(90)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    same(divergence.audit(df, min_docs=3, shard_rows=5, block=2), rows, min_docs=3)
    same(divergence.audit(df, min_docs=3, shard_rows=40, block=4, top=2), rows, min_docs=3, top=2)


def test_edges(spark):
    long = "alpha BETA gamma\x00delta " * 20_000
    rows = [(None, None, None), ("", "", "a"), ("a b", None, "b"), (long, "en", "a"), (long, "en", "a"), ("ÀÉ é-É", "en", None)]
    rows += [("tie one", "en", "b"), ("tie two", "en", "c")] * 6 + [("only few", "fr", "a"), ("words", "fr", "b")]
    rows += [("Alpha alpha", "one", "alone")] * 10
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, shard int, term string")
    got = same(divergence.audit(df), rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got and not any(r[0] == "one" for r in got)
    same(divergence.audit(df, min_docs=1), rows, min_docs=1)
    assert divergence.audit(df.limit(0)).count() == 0


def test_partial_counts_merge_in_bounded_pieces(spark, monkeypatch):
    rows = [(f"w{chr(97 + i % 26)} w{chr(97 + i % 5)} shared", "en", f"s{i % 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    monkeypatch.setattr(divergence, "HOLD_ROWS", 20)
    same(divergence.audit(df), rows)
