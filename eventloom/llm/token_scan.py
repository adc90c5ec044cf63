"""Token counts of documents in flat token files that have no index.

A flat file is a run of ids in which an end-of-document id closes each document. It is read as
blocks of equal size that know nothing of documents. Each block is searched for the end id in
one vectorised comparison; a prefix scan over the blocks of a file then says how many documents
end before a block and where the document began that the block continues. The scan has two
levels, blocks within a segment and segments within a file, so a file of any length (one that
holds a third of all tokens, say) is never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .tokenizer import load_spec, worker_bpe

FLAT = "file int, block int, tokens binary, doc_no long, doc_id long"


def flat_table(
    docs: DataFrame, tokenizer_path: str, end_id: int = 50256, block_tokens: int = 1 << 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Documents as flat files: blocks (file, block, tokens) and, for checks, the order of ids.

    One file per input partition, ids as little-endian unsigned 16-bit numbers, every text
    followed by ``end_id``; blocks cut wherever they are full. A null text is empty.
    """
    spec = load_spec(tokenizer_path)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = worker_bpe(spec), TaskContext.get().partitionId()
        held, size, block, doc_no, full = [], 0, 0, 0, 2 * block_tokens

        def rows(blocks: list[bytes], first: int, ids: list, first_doc: int) -> pa.RecordBatch:
            n, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (n + m), pa.int32()),
                    pa.array([*range(first, first + n), *[None] * m], pa.int32()),
                    pa.array(blocks + [None] * m, pa.binary()),
                    pa.array([None] * n + [*range(first_doc, first_doc + m)], pa.int64()),
                    pa.array([None] * n + ids, pa.int64()),
                ],
                [c.split()[0] for c in FLAT.split(", ")],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, first, done = batch.slice(at, 1024), block, []
                for text in part.column(1):
                    ids = bpe.encode(text.as_py() or "") + end
                    held.append(ids)
                    size += len(ids)
                    if size >= full:
                        run_of = b"".join(held)
                        cut = len(run_of) // full * full
                        done += [run_of[k : k + full] for k in range(0, cut, full)]
                        held, size = [run_of[cut:]], len(run_of) - cut
                block += len(done)
                yield rows(done, first, part.column(0).to_pylist(), doc_no)
                doc_no += part.num_rows
        if size:
            yield rows([b"".join(held)], block, [], doc_no)

    both = written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, FLAT), "flat")
    blocks = both.where("tokens is not null").select("file", "block", "tokens")
    return blocks, both.where("doc_no is not null").select("file", "doc_no", "doc_id")


def flat_files(spark: SparkSession, path: str, block_bytes: int = 1 << 17) -> DataFrame:
    """Blocks (file, block, tokens) of flat files in any store Spark reads; a file up to 2 GB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                parts = [raw[k : k + block_bytes] for k in range(0, len(raw), block_bytes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                    ["file", "block", "tokens"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block int, tokens binary")


def _search(end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for tokens in batch.column("tokens"):
                ids = np.frombuffer(tokens.as_py() or b"", f"<u{width}")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            offsets = np.cumsum([0, *map(len, ends)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ends) if ends else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), lists],
                ["file", "block", "size", "ends"],
            )

    return run


def scan(blocks: DataFrame, end_id: int = 50256, width: int = 2, segment_blocks: int = 1024) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) of each document; the end id is not counted.

    ``blocks`` has file, block (numbered in order, gaps allowed) and tokens: ids of ``width``
    bytes, little-endian. What follows a file's last end id is a document that is not ``closed``.
    Empty and null blocks add nothing; other columns are not read; no blocks give no rows. A
    block that comes twice counts as twice its tokens only if its number differs.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    # The tokens stay where they are; only sizes and places of ends are shuffled.
    searched = blocks.select("file", "block", "tokens").mapInArrow(
        _search(end_id, width), f"file {kind}, block int, size long, ends array<long>"
    )
    found = written(
        searched.dropDuplicates(["file", "block"])
        .withColumn("segment", F.floor(F.col("block") / segment_blocks).cast("int")),
        "ends",
    )
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    in_segment = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Within a segment: tokens and ends before the block, and the last end before it.
    placed = found.withColumns(
        {"at": F.coalesce(F.sum("size").over(in_segment), F.lit(0)), "docs": F.coalesce(F.sum(F.size("ends")).over(in_segment), F.lit(0))}
    ).withColumn("end_before", F.max(F.col("at") + last).over(in_segment))
    whole = placed.groupBy("file", "segment").agg(
        F.sum("size").alias("s_size"), F.sum(F.size("ends")).alias("s_docs"), F.max(F.col("at") + last).alias("s_end")
    )
    in_file = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumns(
        {"f_at": F.coalesce(F.sum("s_size").over(in_file), F.lit(0)), "f_docs": F.coalesce(F.sum("s_docs").over(in_file), F.lit(0))}
    ).withColumn("f_end", F.max(F.col("f_at") + F.col("s_end")).over(in_file))
    final = F.col("segment") == F.max("segment").over(Window.partitionBy("file"))
    carried = carried.withColumn("final", final).select("file", "segment", "f_at", "f_docs", "f_end", "final", "s_size", "s_docs", "s_end")
    joined = placed.join(carried, ["file", "segment"])
    start = F.coalesce(F.col("f_at") + F.col("end_before"), F.col("f_end"), F.lit(-1)) + 1
    docs = joined.where(F.size("ends") > 0).select(
        "file", (F.col("f_docs") + F.col("docs")).alias("first"), (F.col("f_at") + F.col("at")).alias("base"),
        start.alias("begun"), "ends",
    )
    closed = docs.select("*", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("first") + F.col("k")).alias("doc_no"),
        F.when(F.col("k") == 0, F.col("begun")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("end"),
    ).select("file", "doc_no", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    last_start = F.coalesce(F.col("f_at") + F.col("s_end"), F.col("f_end"), F.lit(-1)) + 1
    open_end = carried.where("final").select(
        "file", (F.col("f_docs") + F.col("s_docs")).alias("doc_no"), last_start.alias("start"),
        (F.col("f_at") + F.col("s_size") - last_start).alias("n_tokens"), F.lit(False).alias("closed"),
    ).where("n_tokens > 0")
    return closed.union(open_end)
