"""N-best segmentation: against listing all segmentations, and exact round trips."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm.queries import op5_sentencepiece, tokenizer_path
from eventloom.llm.sentencepiece_nbest import BYTE, NORMAL, SPACE, Model, _marked, decode, encode, load_model

PATH = tokenizer_path("piece_bpe_32k.model")
SMALL = [f"<0x{b:02X}>" for b in range(256)] + [SPACE, "a", "b", "ab", "ba", "aba", SPACE + "a", SPACE + "ab", "abab", SPACE * 2, "bb"]


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(4)
    return Model(SMALL, [0.0] * 256 + [-float(x) for x in rng.integers(1, 12, len(SMALL) - 256)], [BYTE] * 256 + [NORMAL] * (len(SMALL) - 256))


@pytest.fixture(scope="module")
def whole():
    return Model(*load_model(PATH))


def all_scores(model, text):
    """Scores of all segmentations, best first."""
    s = _marked(text)
    normal = {p: i for i, p in enumerate(model.pieces) if i >= 256}

    def go(at):
        if at == len(s):
            return [0.0]
        out = []
        for end in range(at + 1, min(len(s), at + model.longest) + 1):
            i = normal.get(s[at:end], model.unknown if end == at + 1 else None)
            if i is not None:
                out += [model.scores[i] + x for x in go(end)]
        return out

    return sorted(go(0), reverse=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aabb é▁", max_size=9), min_size=1, max_size=4), st.integers(1, 6))
def test_n_best_of_all(small, texts, n):
    for text, found in zip(texts, small.encode(texts, n)):
        want = all_scores(small, text)[:n]
        assert [s for s, _ in found] == pytest.approx(want)
        assert len({tuple(i) for _, i in found}) == len(found)
        for _, ids in found:
            assert small.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=50))
def test_round_trip(whole, text):
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    ((_, ids),) = next(iter(whole.encode([text], 1)))
    assert whole.decode(ids) == text


def test_score_is_that_of_the_pieces(whole):
    texts = ["The quick brown fox", "Hello world, this is a test of segmentation."]
    for text, found in zip(texts, whole.encode(texts, 4)):
        for score, ids in found:
            assert score == pytest.approx(whole.scores[ids].sum())
        assert all(a >= b for a, b in itertools.pairwise([s for s, _ in found])) and len(found) == 4


def test_whole_table(spark, sf):
    rows = op5_sentencepiece(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.round_trip and r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in rows)
    assert sum(len(r.nbest_scores) == 3 for r in rows) >= 0.9 * len(rows)


def test_edges(spark):
    long = "word" * 20_000
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "a  b\n", 3), (2, "a  b\n", 3), (3, long, 4)], "doc_id long, text string, ids int")
    got = encode(docs, PATH, 2).withColumn("text", decode("ids", PATH)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (1, ""), (2, "a  b\n"), (2, "a  b\n"), (3, long)]
    assert {len(r.others) for r in got if r.doc_id in (None, 1)} == {0} and {len(r.others) for r in got if r.doc_id == 2} == {1}
    assert encode(docs.limit(0), PATH).count() == 0
