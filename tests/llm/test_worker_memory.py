"""What the pipeline's operators hold in Python workers, and send to them at once."""

from __future__ import annotations

import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, kn_classifier, packing, secrets, simhash
from eventloom.llm.queries import tokenizer_path

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
SPEC = tokenizer_path("byte_bpe_50k.json")


def classified(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).limit(0)
    return kn_classifier.keep(docs, labels)


STEPS = {
    "packing": lambda docs: packing.pack(docs, SPEC),
    "secrets": secrets.redact,
    "secret scan": secrets.scan,
    "fingerprints": lambda docs: simhash.fingerprints(docs, "doc_id", "text", 3),
    "near copies": simhash.drop_near_copies,
    "classifier": classified,
}


@pytest.fixture
def own_size(spark):
    """The session as a caller brings it, without a size of batches."""
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


@pytest.mark.parametrize("step", STEPS)
def test_long_texts_travel_a_few_at_a_time(spark, own_size, step):
    """40 texts of a megabyte in one task; before, all of them were one batch."""
    STEPS[step](spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    docs = spark.range(40, numPartitions=1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    got = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r.n for r in got) == 40
    assert max(r.size for r in got) <= common.BATCH_BYTES + 2_000_000


def test_a_size_of_the_session_stays(spark, own_size):
    spark.conf.set(KEY, "1234567")
    common.small_batches(spark)
    assert spark.conf.get(KEY) == "1234567"


def test_tasks_give_their_memory_back(monkeypatch):
    given = []
    for module in (packing, simhash, kn_classifier):
        monkeypatch.setattr(module, "give_back", lambda: given.append(common.give_back()))
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    texts = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["some words"])], ["doc_id", "text"])
    run = packing._pieces(packing.load_spec(SPEC), 1024, b"\0\0", 512)
    rows = [r for batch in run(iter([texts])) for r in batch.to_pylist()]
    assert {r["doc_id"] for r in rows} == {7} and sum(r["length"] for r in rows) == rows[0]["doc_tokens"]
    assert len(given) == 1
    list(simhash._bucket_links(3)(iter([])))
    list(kn_classifier._shards(4)(iter([])))
    assert len(given) == 3
