"""Quality rules: counts against plain Python, learning on planted rules."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from eventloom.llm.quality_rules import judge, keep, learn, with_counts
from eventloom.llm.queries import op1_quality_rules


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            marked |= set(range(i, i + 5))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op1_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow(texts[r.doc_id])
        assert tuple(r[c] for c in NAMES) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [k for k, q in judged if q == 1]
    bad = [k for k, q in judged if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_counts_of_odd_texts(spark):
    texts = [
        None, "", " \t\n\x0b\x0c\r", "a", "a b c d e a b c d e", "a a a a a a a a", "x\n\nx\n x\nx", "é# *☃|\x85z z",
        "p q r s t u p q r s t v w p q r s t", "\x0ba\x0bb\x1cc", "one two three four five " * 400, "#" * 100_000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in with_counts(df).collect():
        assert tuple(r[c] for c in NAMES) == slow(texts[r.doc_id]), texts[r.doc_id]


def test_learns_planted_conjunction(spark):
    plain, marks, upper = "word and more of it here now so far ", "what! no! yes! oh! my! go! now! then! done! ", "ALL OF IT IN LARGE LETTERS HERE AS SAID "
    rows = []
    for i in range(600):
        kind = i % 3
        body = [plain, marks, upper][kind] + f"number{chr(97 + i % 26)}{chr(97 + i // 26)} tail{chr(97 + i % 7)}"
        rows.append((i, body, 0 if kind else 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    rules = learn(docs, labels)
    assert rules
    kept = {r.doc_id for r in judge(docs, rules).where("kept").collect()}
    assert kept == {i for i, _, q in rows if q == 1}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(None, None, "a", 1), (1, "", "b", 2), (2, "ten words are here so that this one is kept today", None, 3)] * 2,
        "doc_id long, text string, n_words string, rule_kept int",
    )
    labels = spark.createDataFrame([(None, 0), (1, None), (9, 0), (2, 1)], "doc_id long, quality int")
    rules = learn(docs, labels)
    assert rules == []
    kept = keep(docs, rules)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert learn(docs.limit(0), labels) == [] == learn(docs, labels.limit(0))
    assert keep(docs.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark, sf):
    df = op1_quality_rules(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.count("*")).first()[0] > 0
