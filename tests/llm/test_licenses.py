"""License scan: base places against plain Python, templates planted in texts."""

from __future__ import annotations

import re

from eventloom.llm.licenses import BASE, TEMPLATES, scan
from eventloom.llm.queries import op8_license_scan


def slow(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in BASE.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def compare(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    compare(rows, texts)


def test_templates_and_edges(spark):
    filler = [f"kolo{i} the of bar this is a and under software" for i in range(60)]
    planted = [f"foo the bar {text.upper() if t % 2 else text}, more of the same" for t, (_, _, text) in enumerate(TEMPLATES)]
    odd = [
        None, "", "...", "ALL RIGHTS-reserved all rights", "ccé by cc by CC.BY", "generalK public license",
        "Permission is hereby granted to no one", "license mit the released", "apache " * 50_000 + "cc by",
    ]
    texts = dict(enumerate(filler + planted + odd))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, words int")
    rows = scan(docs).collect()
    assert len(rows) == len(texts)
    compare(rows, texts)
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in rows}
    for t, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[60 + t][0] and got[60 + t][1] == 1
    assert all(got[i] == ({""}, 0) for i in range(60))
    assert got[60 + len(TEMPLATES) + 6] == ({""}, 0)
    assert scan(docs.limit(0)).count() == 0
    nobody = scan(docs.where("doc_id = 0").selectExpr("cast(null as long) doc_id", "text")).collect()
    assert [r.doc_id for r in nobody] == [None]


def whole(text):
    """Labels and score of every template at every place, by plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    labels, score = set(filter(None, slow(text)[4].split(","))), float(slow(text)[1] > 0)
    for label, key, notice in TEMPLATES:
        parts, keys = notice.split(), key.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(keys)] == keys)
        for i in range(len(words)):
            if words[i : i + len(keys)] == keys:
                share = sum(0 <= i - at + p < len(words) and words[i - at + p] == w for p, w in enumerate(parts)) / len(parts)
                if share >= 0.5:
                    labels, score = labels | {label}, max(score, share)
    return labels, score


def test_many_notices_and_mixed_words(spark):
    notices = [text for _, _, text in TEMPLATES]
    mixed = " ".join(sorted({w for text in notices for w in text.split()}))
    texts = dict(enumerate(
        [f"kolo{i} the of bar this is" for i in range(60)]
        + [" foo ".join(notices)] + [f"{mixed} foo {text} foo {mixed}" for text in notices]
    ))
    rows = scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    compare(rows, texts)
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), r.score) for r in rows}
    assert got == {i: whole(t) for i, t in texts.items()}
    assert got[60][0] == {label for label, _, _ in TEMPLATES}


def test_notices_that_stand_everywhere(spark):
    for label, _, text in (TEMPLATES[0], TEMPLATES[7]):
        for n in (1, 5):
            docs = spark.createDataFrame([(i, f"foo {text} bar{i}") for i in range(n)], "doc_id long, text string")
            assert [(label in r.labels.split(","), r.score) for r in scan(docs).collect()] == [(True, 1.0)] * n


def test_no_python_in_the_plan(spark, sf):
    plan = op8_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
