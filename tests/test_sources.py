"""The log source by offset, the feed with its missed count, and the stored vector index."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from eventloom.operators.vector_index import VectorIndex
from eventloom.streaming import feed, offset_log, sinks, source


def append(root, partition, first, records, end="\n"):
    folder = root / f"partition={partition}"
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / f"{first:020d}.log", "a") as f:
        f.write("".join(r + "\n" for r in records[:-1]) + records[-1] + end)


def drain(df, out, checkpoint):
    df.writeStream.foreachBatch(sinks.rows_sink(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rows(spark, out):
    return sorted((r.partition, r.offset, r.value) for r in spark.read.parquet(out).drop("batch").collect())


def test_offsets_resume_where_the_last_batch_ended(spark, tmp_path):
    log, out, c = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "c")
    append(log, 0, 0, ["a0", "a1", "a2"])
    append(log, 1, 10, ["b10"])
    read = lambda **o: offset_log.offset_log(spark, str(log), rowsPerTask="2", **o)
    drain(read(), out, c)
    assert rows(spark, out) == [(0, 0, "a0"), (0, 1, "a1"), (0, 2, "a2"), (1, 10, "b10")]
    # A new segment, a line that is not ended yet, and a new partition.
    append(log, 0, 3, ["a3", "a4"])
    append(log, 1, 10, ["b11", "b12 half"], end="")
    append(log, 2, 0, ["c0"])
    drain(read(), out, c)
    more = [(0, 3, "a3"), (0, 4, "a4"), (1, 11, "b11"), (2, 0, "c0")]
    assert [r for r in rows(spark, out) if r in more] == more and len(rows(spark, out)) == 8
    append(log, 1, 10, ["", "é"])
    drain(read(), out, c)
    assert [r[1:] for r in rows(spark, out) if r[0] == 1] == [(10, "b10"), (11, "b11"), (12, "b12 half"), (13, "é")]


@pytest.mark.parametrize("start, error", [
    ('{"0": 99}', "holds offsets 5 to 7"), ('{"0": 4}', "holds offsets 5 to 7"), ('{"7": 0}', "no partition 7"), ("newest", "earliest, latest"),
])
def test_bad_start_positions_are_refused(spark, tmp_path, start, error):
    append(tmp_path / "log", 0, 5, ["x", "y"])
    with pytest.raises(Exception, match=error):
        drain(offset_log.offset_log(spark, str(tmp_path / "log"), start), str(tmp_path / "out"), str(tmp_path / "c"))


def test_start_positions_and_lost_records(spark, tmp_path):
    log = tmp_path / "log"
    append(log, 0, 5, ["x5", "x6"])
    append(log, 0, 7, ["x7"])
    for name, start, want in (("j", '{"0": 6}', [6, 7]), ("l", "latest", [])):
        drain(offset_log.offset_log(spark, str(log), start), str(tmp_path / name), str(tmp_path / f"c{name}"))
        found = [r[1] for r in rows(spark, str(tmp_path / name))] if (tmp_path / name).exists() else []
        assert found == want
    reader = offset_log.OffsetLogReader({"path": str(log), "failondataloss": "false"})
    assert [(s.start, s.end) for s in reader.partitions({"0": 1}, {"0": 8})] == [(5, 8)]
    with pytest.raises(offset_log.OffsetError, match="gone"):
        offset_log.OffsetLogReader({"path": str(log)}).partitions({"0": 1}, {"0": 8})


def test_poison_in_the_log_is_set_aside(spark, tmp_path):
    good = {"event_id": "e", "event_type": "click", "timestamp": 1, "ip": "i", "user_agent": "", "request_path": "/", "request_host": "h", "params": {}}
    append(tmp_path / "log", 0, 0, [json.dumps(good), "{broken", "[]"])
    log = offset_log.offset_log(spark, str(tmp_path / "log"))
    drain(source.silver_stream(log), str(tmp_path / "ok"), str(tmp_path / "c1"))
    drain(source.poison_of(source.decode(log)), str(tmp_path / "bad"), str(tmp_path / "c2"))
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["e"]
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["[]", "{broken"]


def test_a_lagging_reader_learns_what_it_missed(spark, event, tmp_path):
    live = feed.Feed(str(tmp_path / "feed"), keep=3)
    assert live.read(spark)[1:] == (-1, 0)
    for batch in range(6):
        rows = event([{"event_id": f"{batch}-{i}", "ts": batch, "tenant": f"t{i % 2}"} for i in range(batch + 1)])
        for _ in range(2):
            live.sink()(rows, batch)
    read = lambda after, **f: (lambda r: (sorted(x.event_id for x in r[0].collect()), *r[1:]))(live.read(spark, after, **f))
    assert read(4) == ([f"5-{i}" for i in range(6)], 5, 0)
    # Batches 1 and 2 of the reader's gap are gone: two and three events, whatever it asks for.
    ids, position, missed = read(0, tenant="t1")
    assert (position, missed) == (5, 5) and ids == ["3-1", "3-3", "4-1", "4-3", "5-1", "5-3", "5-5"]
    assert read(5) == ([], 5, 0)


def nearest(vectors, k=10):
    """{query: [ids]} of ids divisible by 100, by plain arithmetic."""
    return {
        q: [i for _, i in sorted((math.dist(v, w), i) for i, w in vectors.items() if i != q)[:k]]
        for q, v in vectors.items() if q % 100 == 0
    }


def test_index_recall_and_exact_search(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    want = nearest(vectors)
    index = VectorIndex.create(table, str(tmp_path / "index"), 16, "vec_id", "embedding", sample_rows=2000)
    # The index grows by appends; a repeated batch replaces itself.
    for batch in (0, 1, 1):
        index.add(table.where(F.col("vec_id") % 2 == batch), batch, "vec_id", "embedding")
    queries = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def found(**more):
        out = {}
        for r in index.search(queries, **more).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.id)
        return out

    assert found(exact=True, scratch=str(tmp_path / "first")) == want
    recall = {}
    for nprobe in (8, 11):
        got = found(nprobe=nprobe)
        recall[nprobe] = sum(len(set(got[q]) & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))
    print("recall at 10 by cells probed of 16:", recall)
    assert recall[11] >= 0.9


def test_index_edges(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "event_id long, vector array<double>")
    index = VectorIndex.create(table.where("event_id < 3"), str(tmp_path / "index"), 2)
    index.add(table, 0)
    ask = spark.createDataFrame([(2, [1.0, 0.0]), (9, [0.0, 0.1]), (10, None), (11, [1.0])], "query_id long, vector array<double>")
    got = index.search(ask, k=5, nprobe=1, exact=True, scratch=str(tmp_path / "s"))
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == [(2, 1, 6), (2, 2, 1), (9, 1, 1), (9, 2, 2), (9, 3, 6)]
    assert index.search(ask.limit(0)).count() == 0
