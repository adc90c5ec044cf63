"""Language model: base scores against plain Python, the filter against exact counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import bloom_lm
from eventloom.llm.bloom_lm import DISCOUNT, Filter, count_of, fill, level_of, score
from eventloom.llm.queries import op6_bloom_lm


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def slow(rows, held, pair_head=None, min_count=2):
    """{position: (n_tokens, n_known, N, base, score)}; the model with exact levels."""
    texts = [tokens(t) for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    u = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    order = [w for w, _ in sorted(((w, k) for w, k in c.items() if w), key=lambda x: (-x[1], x[0].encode()))]
    frequent = {None, *order[: (pair_head or 16_384) - 1]}
    pairs = Counter(p for t in train for p in zip([None, *t], t) if set(p) <= frequent)
    read = {p: float(count_of(level_of(np.array([k])))[0]) - DISCOUNT for p, k in pairs.items() if k >= min_count}
    rest = {w: 1.0 for w in frequent}
    for (a, _), k in read.items():
        rest[a] -= k / c[a]
    out = []
    for t in texts:
        base = sum(math.log10(u(w)) for w in t)
        full = 0.0
        for a, b in zip([None, *t], t):
            p = u(b)
            if a in frequent:
                p = max(rest[a], 1e-12) * p + (read.get((a, b), 0) / c[a] if c[a] else 0)
            full += math.log10(min(p, 1.0))
        out.append((len(t), sum(c[w] > 0 for w in t), n, base, full))
    return out


def test_whole_table(spark):
    """75,399 distinct words, pairs of all of them, those seen once too."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs]
    want = slow([(r.doc_id, r.text) for r in docs], held, pair_head=1 << 40, min_count=1)
    got = {r.doc_id: r for r in op6_bloom_lm(spark, sf).collect()}
    assert len(got) == len(docs)
    errors, gain = [], 0
    for r, (n, known, total, base, full) in zip(docs, want):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score >= full - 1e-6
        errors.append((g.score - full) / -full)
        gain += (g.score - g.base_score) if g.held_out else 0
    # Filter errors only raise a word's probability, and are rare.
    assert sum(errors) / len(errors) < 0.01
    assert gain > 0


def test_small_head_and_many_passes(spark, monkeypatch):
    rows = [(i, f"the a{i % 7} of b{i % 5} and the c{i % 3} end{i}") for i in range(200)] + [(None, "the Unseen"), (1000, None), (1001, "")]
    held = [i is not None and i % 4 == 1 for i, _ in rows]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    flag = F.col("doc_id") % 4 == 1
    want = sorted(slow(rows, held, pair_head=8))
    for mb in (256, 0):
        got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score(docs, flag, head=12, pair_head=8, max_filter_mb=mb).collect())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-6)
    assert score(docs.limit(0), flag).count() == 0
    assert {r.n_known for r in score(docs.where("doc_id = 1"), F.lit(True)).collect()} == {0}


def test_pairs_of_all_words_are_counted_by_default(spark):
    """More words than the 16,384 that pairs were once held to, every one in a pair that recurs."""
    rows = [(i, " ".join(f"p{i}w{k} q{i}w{k}" for k in range(20))) for i in range(1000)] * 2
    docs = spark.createDataFrame([*rows, *[(i, r[1]) for i, r in enumerate(rows[:3], 5000)]], "doc_id long, text string").repartition(3)
    got = [r.score - r.base_score for r in score(docs, F.col("doc_id") >= 5000).collect()]
    assert len(got) == 2003 and min(got) > 40


def test_pairs_of_rare_words_count(spark):
    """Pairs beyond the words that travel with the task, and so beyond any pair_head, are the model's."""
    rows = [(i, f"the a{i % 7} of b{i % 5} x{i % 11} y{i % 11} z{i // 2} the end{i}") for i in range(200)] + [(1000, "new z3")]
    held = [i % 4 == 1 for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: x for (i, _), x in zip(rows, slow(rows, held))}
    for mb in (256, 0):
        got = {r.doc_id: r for r in score(docs, F.col("doc_id") % 4 == 1, head=4, max_filter_mb=mb).collect()}
        for i, (n, known, total, base, full) in want.items():
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
            assert got[i].base_score == pytest.approx(base, rel=1e-9)
            # A filter error reads a pair's level too high.
            assert got[i].score >= full - 1e-6 and got[i].score == pytest.approx(full, rel=0.05)


def test_probabilities_add_up_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "a b", "a b c", "b a", "c a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    probe = spark.createDataFrame([(100 + i, f"a {w}") for i, w in enumerate("abcd")] + [(200, "a")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(docs.union(probe), F.col("doc_id") >= 100).collect()}
    want = slow(rows + [(r.doc_id, r.text) for r in probe.collect()], [i >= 100 for i in [*range(5), 100, 101, 102, 103, 200]])
    assert [got[i] for i in (100, 101, 102, 103, 200)] == pytest.approx([w[4] for w in want[5:]])


def test_filter_reads_levels_back():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 1 << 60, 20_000).astype(np.uint64))
    counts = rng.zipf(1.5, len(pairs)).clip(1, 10**9)
    levels = level_of(counts)
    held = Filter({3: fill(pairs, levels).tobytes()}, 5)
    shard = np.full(len(pairs), 3)
    got = held.levels(pairs, shard)
    assert (got >= levels).all() and (got > levels).mean() < 0.01
    assert (count_of(levels) <= counts).all() and (level_of(count_of(levels)) == levels).mean() > 0.99
    others = rng.integers(1 << 61, 1 << 62, 20_000).astype(np.uint64)
    assert (held.levels(others, np.full(20_000, 3)) > 0).mean() < 0.01
    assert not held.levels(others, np.full(20_000, 2)).any()
    assert bloom_lm.HASHES == 8


def test_filter_reads_numbers_of_words_back():
    """Exact up to 2047, then ten bits below the leading one; what a word seen once leaves is not held."""
    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    counts = rng.zipf(1.4, len(words)).clip(1, 10**9)
    left = np.maximum(1, (2 * counts * rng.random(len(words))).astype(np.int64))
    held = Filter({1: bloom_lm.fill_words(words, counts, left, 1).tobytes()}, 2)
    shard = np.ones(len(words), np.int64)
    for got, want in ((held.numbers(words, shard), counts), (held.numbers(bloom_lm.share_keys(words), shard)[counts > 1], left[counts > 1])):
        small = want < 2048
        assert (got[small] != want[small]).sum() <= 3
        assert (got <= want).mean() > 0.999 and (got >= want * (1 - 2**-10) - 1).mean() > 0.999
    others = rng.integers(1 << 62, 1 << 63, 20_000).astype(np.uint64)
    assert (held.numbers(others, shard) > 0).sum() <= 3
    assert not held.numbers(words, shard * 0).any()


def test_pairs_of_ranks_spread_over_shards():
    """Pairs of one frequent first word do not meet in one shard; a rare word's lie with it."""
    v, w = np.zeros(50_000, np.int64), np.arange(50_000)
    shard = bloom_lm.pair_shards(bloom_lm.pair_keys(v, w), v, w, 16)
    assert np.bincount(shard, minlength=16).max() < 50_000 / 16 * 2
    rare = np.full(50_000, bloom_lm.word_hash(b"rare"))
    for a, b in ((rare, w), (w, rare)):
        assert set(bloom_lm.pair_shards(bloom_lm.pair_keys(a, b), a, b, 16)) == set(bloom_lm.word_shards(rare[:1], 16))


def test_a_shard_is_merged_in_little_memory():
    """As many different pairs as a shard has tokens, half of them twice."""
    import tracemalloc

    import pyarrow as pa

    n = bloom_lm.SHARD_TOKENS
    rng = np.random.default_rng(1)
    keys, firsts = rng.integers(0, 1 << 63, n).astype("<u8"), np.sort(rng.integers(-(1 << 63), 0, n)).astype("<u8")
    counts = (1 + np.arange(n) % 2).astype("<u4")
    blob = zlib.compress(bloom_lm._planes(np.diff(firsts, prepend=np.uint64(0))) + counts.tobytes() + keys.tobytes(), 1)
    table = pa.table({"shard": pa.array([3], pa.int32()), "pairs": [zlib.compress(b"")], "others": [blob]})
    tracemalloc.start()
    try:
        merged = bloom_lm._merge(2)(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 250e6
    assert sum(map(len, merged["word"].to_pylist())) > 0.49 * n


def test_a_pair_is_read_once_a_chunk(monkeypatch):
    """However often a pair stands in a chunk's texts, the filter is asked for it once."""
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 0

    asked = []
    levels = Filter.levels

    def counted(self, keys, shard, hashes=bloom_lm.HASHES):
        if hashes == bloom_lm.HASHES:
            asked.append(len(keys))
        return levels(self, keys, shard, hashes)

    monkeypatch.setattr(bloom_lm.TaskContext, "get", Task)
    monkeypatch.setattr(Filter, "levels", counted)
    ids = {bloom_lm.END: 0, b"a": 1, b"b": 2}
    v, w = np.array([0, 1, 2, 2]), np.array([1, 2, 1, 0])
    keys = bloom_lm.pair_keys(v, w)
    held, no_words = Filter({0: fill(keys, np.full(4, 3)).tobytes()}, 1), Filter({}, 1)

    class Shared:
        value = held.arrays(), no_words.arrays(), np.full(3, 9.0), np.full(3, 0.5)

    run = bloom_lm._score(ids, np.full(3, -1.0), None, 1, Shared, 0, [0], 2, 30.0)
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([False, False]), pa.array([b"a b " * 50, b"a b"])], ["doc_id", "held_out", "text"])
    (got,) = run(iter([rows]))
    assert asked == [4]
    known = math.log10((2 - DISCOUNT) / 9 + 0.05)
    assert got["n_tokens"].to_pylist() == [101, 3]
    assert got["score"].to_pylist() == pytest.approx([101 * known, 3 * known])


def test_rare_words_are_read_once(monkeypatch):
    """What was read is kept while there is room, and read again after; the numbers are the filter's."""
    words = np.array([bloom_lm.word_hash(b"w%d" % i) for i in range(60)])
    counts, left = np.arange(60) + 1, np.arange(60) + 1
    blob = bloom_lm.fill_words(words.astype(np.uint64), counts, left, 2).tobytes()
    asked = []
    read = bloom_lm.RareWords._read
    monkeypatch.setattr(bloom_lm.RareWords, "_read", lambda self, h: asked.append(len(h)) or read(self, h))
    monkeypatch.setattr(bloom_lm, "FLUSH", 50)
    rare = bloom_lm.RareWords(Filter({0: blob}, 1), 1, 2)
    for part, new in ((slice(0, 0), []), (slice(0, 20), [20]), (slice(10, 40), [20]), (slice(0, 40), []), (slice(30, 60), [30]), (slice(0, 60), [60])):
        asked.clear()
        count, rest = rare.of(np.repeat(words[part], 2)[::-1])
        assert asked == new
        assert count.tolist() == np.repeat(counts[part], 2)[::-1].tolist()
        assert rest.tolist() == [1.0 if c == 1 else 0.5 for c in count]
    assert rare.of(np.array([bloom_lm.word_hash(b"unknown")]))[0].tolist() == [0]


ODD_TEXTS = [
    b"  A b\x0b\x0cc\xff\xfe B\x1c\x1e\x85 e \n", b"", b"x", None, b" ", "\u0130K \u00e9\u2028\u00a0Z\u00c9".encode(), b"a\x00b a\x00b a", b"\t\r\n", b"q" * 300,
]


def test_words_are_split_as_the_rule_says():
    """Bytes that are no UTF-8, white space beyond the rule's, and texts without a word too; also of a slice."""
    import pyarrow as pa

    rule = [[*(t or b"").translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split(), None] for t in ODD_TEXTS]
    for kind in (pa.binary(), pa.large_binary()):
        for part in (slice(0, 9), slice(2, 7), slice(1, 2), slice(4, 5)):
            texts = pa.array(ODD_TEXTS, kind)[part]
            words, codes, ends = bloom_lm._split(texts)
            words = [*words.to_pylist(), None]
            got = [words[c] for c in codes]
            assert got == [w for t in rule[part] for w in t]
            assert [got[e] for e in ends] == [None] * len(texts) and np.diff(ends, prepend=-1).tolist() == [len(t) for t in rule[part]]
    texts = pa.RecordBatch.from_arrays([pa.array(ODD_TEXTS, pa.binary())], ["text"])
    counts = Counter()
    for batch in bloom_lm._count_words(iter([texts, texts[:0], texts])):
        counts.update(dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist())))
    assert counts == Counter([w or bloom_lm.END for t in rule for w in t] * 2)
    assert not list(bloom_lm._count_words(iter([texts[:0]])))


def test_chunks_hold_every_row_once():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([None if i % 7 == 0 else b"w " * (i * i % 50) for i in range(200)], pa.binary())], ["i", "text"])
    cost = [len(t or b"") + 16 for t in rows["text"].to_pylist()]
    batches = [rows[:3], rows[3:3], rows[3:90], rows[90:91], rows[91:]]
    for most in (1, 40, 100, 1000, 1 << 20):
        chunks = [c["i"].to_pylist() for c in bloom_lm._chunks(iter(batches), most)]
        assert [i for c in chunks for i in c] == list(range(200)) and all(chunks)
        assert all(len(c) == 1 or sum(cost[i] for i in c) <= most for c in chunks)
        # No two that lie side by side would fit in one.
        assert all(sum(cost[i] for i in a) + cost[b[0]] > most for a, b in zip(chunks, chunks[1:]))


def test_a_word_is_hashed_once_a_chunk(monkeypatch):
    """However often a rare word stands in a chunk's texts; nothing is kept for it from chunk to chunk."""
    import pyarrow as pa

    asked, hash_of = [], bloom_lm.word_hash
    monkeypatch.setattr(bloom_lm, "FLUSH", 0)
    monkeypatch.setattr(bloom_lm, "word_hash", lambda word: asked.append(word) or hash_of(word))
    batch = pa.RecordBatch.from_arrays([pa.array([b"the rare Rare other " * 50] * 3, pa.binary())], ["text"])
    rows = list(bloom_lm._count_pairs({bloom_lm.END: 0, b"the": 1}, None, 1)(iter([batch])))
    # The empty string at a text's end has a number too.
    assert sorted(filter(None, asked)) == [b"other", b"rare"]
    often, others = (zlib.decompress(rows[0][c][0].as_py()) for c in ("pairs", "others"))
    assert np.frombuffer(often, "<u4", 1, 8).tolist() == [3]
    n = len(others) // 20
    assert sorted(np.frombuffer(others, "<u4", n, 8 * n).tolist()) == [3, 147, 150, 150, 150]


def test_runs_of_keys_give_the_same(monkeypatch):
    """Keys of many shards, in any order, more than are looked up at a time."""
    rng = np.random.default_rng(7)
    keys, counts = rng.integers(0, 1 << 62, 3000).astype(np.uint64), rng.zipf(1.5, 3000).clip(1, 10**6)
    shard, levels = rng.integers(0, 4, 3000), level_of(counts)
    held = Filter({s: fill(keys[shard == s], levels[shard == s]).tobytes() for s in (0, 1, 3)}, 5)
    want = np.zeros(3000, np.int64)
    for s in (0, 1, 3):
        want[shard == s] = Filter({s: fill(keys[shard == s], levels[shard == s]).tobytes()}, 5).levels(keys[shard == s], shard[shard == s])
    assert (want >= np.where(shard == 2, 0, levels)).all() and not want[shard == 2].any()
    looked, hits = [], Filter._hits
    monkeypatch.setattr(Filter, "_hits", lambda self, keys, *a: looked.append(len(keys)) or hits(self, keys, *a))
    monkeypatch.setattr(bloom_lm, "RUN", 100)
    assert (held.levels(keys, shard) == want).all()
    assert max(looked) == 100
