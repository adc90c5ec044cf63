"""Kneser-Ney: probabilities against a plain implementation; decisions on planted junk."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from eventloom.llm import common, kn_classifier
from eventloom.llm.kn_classifier import EDGE, Vocabulary, classify, keep, pack_trigrams, perplexities, text_key, train, unpack_trigrams

TRUSTED = ["the cat sat on the mat", "the cat ate the fish", "a dog sat on the cat", "the dog ate a fish today", "a cat and a dog"] * 3 + [
    "the fish sat", "on the mat a dog sat", "the cat sat on a dog",
]


def slow_model(vocabulary, texts):
    """P(w3 | w1 w2) by the textbook's formulas."""
    tri = Counter()
    for t in texts:
        s = [EDGE, EDGE, *vocabulary.ids(t.encode()).tolist(), EDGE]
        tri.update(zip(s, s[1:], s[2:]))
    pair = Counter((b, c) for _, b, c in tri)
    one = Counter(c for _, c in pair)

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [min(k + 1, max(0, k + 1 - (k + 2) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in range(3)]

    d3, d2, d1 = discounts(tri), discounts(pair), discounts(one)
    take = lambda d, c: d[min(c, 3) - 1]
    size = max(vocabulary.values()) + 1
    context, following = defaultdict(list), defaultdict(list)
    for (a, b, _), c in tri.items():
        context[a, b].append(c)
    for (b, _), c in pair.items():
        following[b].append(c)
    total = sum(one.values())
    freed = sum(take(d1, c) for c in one.values())

    def p1(w):
        return ((one[w] - take(d1, one[w]) if one[w] else 0) + freed / size) / total

    def p2(b, w):
        if b not in following:
            return p1(w)
        n = sum(following[b])
        own = pair[b, w] - take(d2, pair[b, w]) if pair[b, w] else 0
        return own / n + sum(take(d2, c) for c in following[b]) / n * p1(w)

    def p3(a, b, w):
        if (a, b) not in context:
            return p2(b, w)
        n = sum(context[a, b])
        own = tri[a, b, w] - take(d3, tri[a, b, w]) if tri[a, b, w] else 0
        return own / n + sum(take(d3, c) for c in context[a, b]) / n * p2(b, w)

    return p3, size


def test_perplexity_equals_the_formulas(spark):
    trusted = spark.createDataFrame([(t,) for t in TRUSTED], "text string")
    words, _, _ = train(trusted)
    vocabulary = Vocabulary(words)
    p3, size = slow_model(Vocabulary(words), TRUSTED)
    assert sum(p3(EDGE, EDGE, w) for w in range(size)) == pytest.approx(1)
    asked = ["the cat sat on the mat", "WHAT!! is 12 this", "a zebra", "mat mat mat", "", "the cat sat on the mat"]
    docs = spark.createDataFrame([(t,) for t in asked], "text string")
    got = {(r.k1, r.k2): r.perplexity for r in perplexities(docs, trusted, shards=3, group_tokens=2).collect()}
    keys = [tuple(r) for r in docs.select(*text_key(F.col("text"))).collect()]
    assert len(got) == 5
    for t, key in zip(asked, keys):
        s = [EDGE, EDGE, *vocabulary.ids(t.encode()).tolist(), EDGE]
        logs = [math.log10(p3(*s[i : i + 3])) for i in range(len(s) - 2)]
        assert got[key] == pytest.approx(10 ** (-sum(logs) / len(logs)), rel=1e-9)


def test_packed_trigrams_come_back():
    """Each document's trigrams, in any order; smallest and largest ids, one document and many."""
    rng = np.random.default_rng(3)
    for size, docs in ((1, 1), (7, 7), (1000, 1), (50_000, 300)):
        doc = np.sort(rng.integers(0, docs, size)) * 3
        w = (2.0 ** rng.uniform(0, 21, (3, size))).astype(np.uint32) - 1
        w[:, 0] = (0, (1 << 21) - 1, 255)
        n, got = unpack_trigrams(pack_trigrams(doc, w, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())
        own = np.unique(doc, return_counts=True)
        assert n.tolist() == own[1].tolist()
        assert sorted(zip(doc.tolist(), *w.tolist())) == sorted(zip(np.repeat(own[0], n).tolist(), *got.tolist()))


def test_no_word_of_the_sample_is_left_out(spark):
    """More words than 16 bits count: each has its own id, and late ones are scored by the formulas."""
    texts = [" ".join(f"v{i + k}q" for k in range(100)) for i in range(0, 70_000, 100)] * 2
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    words, p1, _ = train(trusted)
    assert len(words) == 70_000 and len(p1) > 1 << 16
    vocabulary = Vocabulary(words)
    p3, _ = slow_model(Vocabulary(words), texts)
    late = [words[-1], words[66_000], words[5]]
    asked = [" ".join(late), texts[-1], f"{late[0]} {late[0]}", f"{texts[3]} {late[1]}"]
    docs = spark.createDataFrame([(t,) for t in asked], "text string")
    got = {(r.k1, r.k2): r.perplexity for r in perplexities(docs, trusted).collect()}
    for t, key in zip(asked, [tuple(r) for r in docs.select(*text_key(F.col("text"))).collect()]):
        s = [EDGE, EDGE, *vocabulary.ids(t.encode()).tolist(), EDGE]
        logs = [math.log10(p3(*s[i : i + 3])) for i in range(len(s) - 2)]
        assert got[key] == pytest.approx(10 ** (-sum(logs) / len(logs)), rel=1e-9)


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    clean = [r.kept for r in rows if quality.get(r.doc_id) == 1 and r.n_words >= 10]
    assert sum(clean) >= 0.98 * len(clean)
    junk = [r.kept for r in rows if quality.get(r.doc_id) == 0 and r.n_words >= 10]
    assert sum(junk) <= 0.6 * len(junk)


def test_threshold_is_the_quantile_of_all_held_out(spark):
    """A rare language keeps its own threshold beside a large one, and bad rows go."""
    en = [(i, f"the cat sat on the mat with dog {i % 50} and fish {i % 41}", "en") for i in range(10_000)]
    xx = [(20_000 + i, f"lo gato come un pez {i % 30} y {i % 29}", "xx") for i in range(150)]
    bad = [(30_000 + i, " ".join(f"zq{i}w{k} mat" for k in range(8)), "en") for i in range(100)]
    toxic = [(40_000 + i, "vile " * 12 + str(i), "en") for i in range(100)]
    docs = spark.createDataFrame(en + xx + bad + toxic, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(
        [(r[0], 1, 0) for r in en + xx] + [(r[0], 0, 0) for r in bad] + [(r[0], 1, 1) for r in toxic],
        "doc_id long, quality int, toxic int",
    )
    rows = classify(docs, labels).collect()
    cut = {lang: {r.threshold for r in rows if r.lang == lang} for lang in ("en", "xx")}
    assert len(cut["en"]) == len(cut["xx"]) == 1 and cut["en"] != cut["xx"]
    clean = [r.perplexity for r in rows if r.lang == "xx"]
    assert cut["xx"].pop() <= max(clean)
    assert not any(r.kept for r in rows if r.doc_id >= 30_000)
    assert sum(r.kept for r in rows if r.doc_id < 30_000) >= 0.97 * (len(en) + len(xx))


def test_bad_rows_are_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    rows = [(r.kept, *quality[r.doc_id]) for r in classify(docs, labels).collect() if r.doc_id in quality and r.n_words >= 10]
    good, bad = [k for k, q, t in rows if q == 1 and t != 1], [k for k, q, _ in rows if q == 0]
    print("kept: good", sum(good), len(good), "bad", sum(bad), len(bad), "good but toxic", sum(k for k, q, t in rows if q == 1 and t == 1), sum(q == 1 and t == 1 for _, q, t in rows))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_edges(spark):
    rows = [(None, None, "en", 1), (1, "", None, 2), (2, "the cat sat", "en", 3), (2, "the cat sat", "en", 3), (3, "one", "xx", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k1 int")
    labels = spark.createDataFrame([(None, 1), (2, 1), (3, 0), (77, 1), (1, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        got = keep(docs, given)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == [2, 2, 3]
    assert classify(docs.limit(0), labels).count() == 0


def test_tasks_give_their_memory_back(monkeypatch):
    import pyarrow as pa

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    given = []
    monkeypatch.setattr(kn_classifier, "give_back", lambda: given.append(common.give_back()))
    blocks = [np.ones(1000) for _ in range(20_000)]
    after = np.ones(1000)
    del blocks
    before = resident()
    texts = pa.RecordBatch.from_arrays([pa.array([b"a b a", None], pa.binary())], ["text"])
    (rows,) = kn_classifier._trigrams(["a"])(iter([texts]))
    assert rows.num_rows > 0 and len(given) == 2 and after.sum() == 1000
    assert resident() < before - 80e6


def _steps():
    known = kn_classifier.Known(np.zeros(0, np.int64), np.ones(7), np.full(7, 0.1))
    return known, [kn_classifier._trigrams(["a", "b"]), kn_classifier._shards(4), kn_classifier._requests(["a", "b"], known, 4, 1)]


def test_workers_forget_what_earlier_operators_kept():
    import pyarrow as pa

    def kept_after(step):
        common.per_worker("of another operator", list).append(1)
        step()
        return common.per_worker("of another operator", list)

    requests = pa.table({c: pa.array([], pa.binary()) for c in ("keys", "block", "local")})
    model = pa.table({"tables": pa.array([], pa.list_(pa.binary()))})
    for run in _steps()[1]:
        assert kept_after(lambda run=run: list(run(iter([])))) == []
    assert kept_after(lambda: kn_classifier._answer(np.ones(7))(requests, model)) == []


def test_trigrams_are_packed_in_little_memory():
    """A batch of over a million words, whose texts are packed some at a time."""
    import tracemalloc

    import pyarrow as pa

    texts = 2400
    keys = np.arange(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b c " * 150] * texts, pa.binary()), pa.array(keys), pa.array(keys)], ["text", "k1", "k2"])
    run = _steps()[1][2]
    tracemalloc.start()
    try:
        blocks = [(row["keys"], row["block"]) for out in run(iter([batch])) for row in out.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    unpack = zstandard.ZstdDecompressor()
    # Nothing of the text is known to the model, so each text sends its first trigram alone.
    assert sorted(k for own, _ in blocks for k in np.frombuffer(own, "<i8")[::2]) == list(range(texts))
    assert sum(unpack_trigrams(b, unpack)[1].shape[1] for _, b in blocks) == texts
    assert peak < 60e6
