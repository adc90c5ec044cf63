"""The pipeline, stage by stage, against plain implementations of each stage's decision."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm.common import written
from eventloom.llm.queries import tokenizer_path
from eventloom.llm.secrets import scan_text

from .test_packing import check
from .test_quality_rules import slow as slow_counts
from .test_secrets import plain
from .test_simhash import slow_classes, slow_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_columns_stay(stages):
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[1:-1])


def test_filters_keep_clean_and_drop_bad(spark, stages):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for before, after in zip(stages[:2], stages[1:3]):
        left = {r.doc_id for r in after.collect()}
        clean = []
        for r in before.collect():
            n = slow_counts(r.text)
            failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
            assert not (failed and r.doc_id in left)
            if not failed and quality.get(r.doc_id) == 1:
                clean.append(r.doc_id in left)
        assert sum(clean) >= 0.98 * len(clean)
    left = [quality[r.doc_id] for r in stages[2].collect() if r.doc_id in quality]
    assert left.count(0) <= 0.02 * len(left)


def test_one_of_each_group_stays(stages):
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    roots = set(slow_classes({k: slow_fingerprint(t) for k, t in texts.items()}).values())
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(roots)


def test_secrets_are_gone(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = stages[4].collect()
    assert len(after) == len(before)
    for r in after:
        assert not plain(r.text) and not scan_text(r.text.encode())[1] and r.n_chars == len(r.text)
        if not scan_text(before[r.doc_id].text.encode())[1]:
            assert r.text == before[r.doc_id].text
    assert any(r.text != before[r.doc_id].text for r in after)


def test_packed(stages):
    exact = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    check(stages[5].collect(), {r.doc_id: r.text for r in stages[4].collect()}, exact)


def _folder(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_edge_rows_and_clashing_columns(spark, tmp_path):
    """Rows without text go at the first stage, a repeated row stays once, extra columns stay to the last stage."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = [r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()]
    long_text = " ".join(f"word{k} of{k % 97} a{k % 1009} very{k % 31} long{k % 53} text" for k in range(30_000))
    odd = spark.createDataFrame(
        [(90_000, None, None, None, None), (90_001, "", "", "", 0), (90_002, " \n\t ", "en", None, 4),
         (90_003, long_text, None, None, None), (None, "too few words here", "en", "web", 18)],
        base.schema,
    )
    again = base.where(base.doc_id == good[0])
    docs = base.unionByName(odd).unionByName(again)
    extra = ["kept", "n_words", "score", "fingerprint", "component_id", "h", "row", "quality", "rank"]
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(k))
    sf = _folder(spark, tmp_path, docs.repartition(3), labels.withColumn("text", F.lit("x")).withColumn("lang", F.lit(None).cast("string")))
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, written(stage(spark, now, sf), "edge")
        assert now.columns == docs.columns, name
        rows = now.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
        assert not {90_000, 90_001, 90_002, None} & {r.doc_id for r in rows}
        assert all(r[c] == k for r in rows for k, c in enumerate(extra))
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids))
    tokens = {}
    for r in corpus_pipeline.pack_sequences(spark, now, sf).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert tokens[r.doc_id] <= r.doc_tokens
    assert set(tokens) == set(ids)


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0)
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, docs, labels)).count() == 0
