"""Packing: the contract's checks on whole rows, against the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm.packing import Packer, pack
from eventloom.llm.queries import op3_packing, tokenizer_path
from eventloom.llm.tokenizer import ByteBpe, load_spec

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(load_spec(PATH))


def check(rows, texts, exact, width=1024):
    """Every id of every document in exactly one piece, sequences gapless, padding nowhere."""
    ids = {k: exact.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    at = {}
    for r in rows:
        at.setdefault(r.doc_id, []).append(r)
    assert set(at) == set(ids)
    for k, pieces in at.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(ids[k])
        for p in pieces:
            part = np.array(ids[k][p.start : p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids[k])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        total = sum(p.length for p in pieces)
        assert total <= width and total & (total - 1) == 0 and {p.sequence_length for p in pieces} == {total}


def test_whole_table(spark, sf, exact):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op3_packing(spark, sf).collect()
    check(rows, texts, exact)
    whole = {r.sequence_id for r in rows if r.sequence_length == 1024}
    assert len(whole) >= 0.9 * len({r.sequence_id for r in rows})


def test_nulls_repeats_and_clashing_columns(spark, exact):
    rows = [(1, None, 7, "x"), (2, "", 8, "y"), (3, "the end " * 3000, 9, "z"), (4, "é  <|endoftext|>  中文", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, sequence_id string")
    check(pack(docs, PATH).collect(), {r[0]: r[1] for r in rows}, exact)
    twice = pack(docs.where("doc_id = 2").union(docs.where("doc_id = 2")), PATH).collect()
    assert [(r.doc_id, r.start, r.length) for r in twice] == [(2, 0, 1)] * 2
    nobody = docs.where("doc_id = 2").selectExpr("cast(null as long) doc_id", "text")
    assert pack(nobody, PATH).first().doc_id is None
    assert pack(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n \x1c\x85　aB1.,'sé中-_😀"), max_size=60))
def test_ids_equal_the_library(bpe, exact, text):
    assert np.frombuffer(bpe.encode(text), "<u2").tolist() == exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80))
def test_packer_loses_no_id(sizes):
    packer = Packer(16, 0, 4)
    for k, n in enumerate(sizes):
        packer.add((k, n), np.arange(n, dtype="<u2").tobytes())
        level = sum(len(w) for w in packer.open)
        assert level == packer.n_open <= 4 and (packer.levels == [len(w) for w in packer.open]).all()
    packer.drain()
    got = {}
    for doc, start, length, *_ in packer.rows:
        got.setdefault(doc, []).extend(range(start, start + length))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}


def test_piece_goes_where_squares_grow_least():
    packer = Packer(10, 0, 100)
    for k in range(3):
        packer.add((k, 6), b"\0" * 12)
    assert packer.levels[6] == 3
    packer.add((9, 4), b"\0" * 8)  # fills a window: three windows at one level become two
    assert packer.levels[6] == 2 and packer.levels.sum() == 2
