"""Separator scan: counts against tokenising each text, and against splitting flat files."""

from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm.queries import op7_token_counts, tokenizer_path
from eventloom.llm.token_scan import flat_files, flat_table, scan


def slow(ids, end):
    """(start, length, closed) of each document of one file."""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


def test_whole_table(spark, sf):
    exact = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(exact.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
    assert len(rows) == len(texts) and all(r.closed for r in rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=4))
def test_blocks_of_any_size(spark, files):
    rows = []
    for f, ids in enumerate(files):
        raw = np.array(ids, "<u4").tobytes()
        rows += [(f, k, raw[4 * k : 4 * k + 4], "x") for k in range(len(ids))] if f % 2 else [(f, k, raw[12 * k : 12 * k + 12], "x") for k in range((len(ids) + 2) // 3)]
    blocks = spark.createDataFrame(rows, "file int, block int, tokens binary, start string")
    got = sorted((r.file, r.doc_no, r.start, r.n_tokens, r.closed) for r in scan(blocks, 0, 4, segment_blocks=4).collect())
    assert got == [(f, d, *x) for f, ids in enumerate(files) for d, x in enumerate(slow(ids, 0))]


def test_real_flat_files(spark, tmp_path):
    files = {"a.bin": [5, 9, 0, 0, 7, 0], "b.bin": [1, 2, 3], "c.bin": []}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = sorted((r.file.rsplit("/", 1)[1], r.doc_no, r.start, r.n_tokens, r.closed) for r in scan(flat_files(spark, str(tmp_path), 4), 0).collect())
    assert got == [(f, d, *x) for f, ids in files.items() for d, x in enumerate(slow(ids, 0))]


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a b " * 5000, 3), (2, "a", 4)], "doc_id long, text string, file int").coalesce(1)
    blocks, order = flat_table(docs, tokenizer_path("byte_bpe_50k.json"), block_tokens=64)
    assert blocks.count() > 100
    got = scan(blocks, segment_blocks=8).join(order, ["file", "doc_no"]).orderBy("doc_no").collect()
    assert [(r.doc_id, r.n_tokens > 5000, r.closed) for r in got] == [(None, False, True), (1, False, True), (2, True, True), (2, False, True)]
    assert scan(blocks.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, 0, None), (1, 1, b"")], "file int, block int, tokens binary")
    assert scan(nothing).count() == 0
