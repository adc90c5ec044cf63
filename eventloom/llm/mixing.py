"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, repeated up to ``repeats`` times. A
document's virtual finish time is the words its source has sent when it ends, divided by the
source's weight; all documents are sorted by it and the order is cut at the total budget. A
source that runs out leaves the line to the others, which is how the excess is shared anew.
Positions and running sums come from range partitions, so no source is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of, written

SEED = 13
# Sources ordered by one task of their range.
SOURCE_ROWS = 1 << 16


def _running(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(names, 0)
        for batch in batches:
            columns = list(batch.columns)
            for name in names:
                sums = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False)) + so_far[name]
                so_far[name] = int(sums[-1]) if len(sums) else so_far[name]
                columns.append(pa.array(sums, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[f"{n}_to" for n in names]])

    return run


def running_sums(df: DataFrame, order: list[Column], names: list[str], parts: int, label: str) -> DataFrame:
    """``df`` with ``<name>_to``: the sum of a long column up to and with the row, in ``order``.

    Rows are dealt by range and summed within each range; one row per range then carries what
    lies before it. ``order`` must tell apart all rows whose places matter.
    """
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    local = written(dealt.mapInArrow(_running(names), f"{kinds}, " + ", ".join(f"{n}_to long" for n in names)), label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: at most ``parts`` of them.
    ends = local.groupBy("_part").agg(*[F.max(f"{n}_to").alias(n) for n in names]).select(
        "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names]
    )
    return (
        local.join(F.broadcast(ends), "_part")
        .withColumns({f"{n}_to": F.col(f"{n}_to") + F.col(f"_{n}") for n in names})
        .drop("_part", *[f"_{n}" for n in names])
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(source, source_no, source_size, weight, target) from (source, size) rows.

    Sources are numbered by code point, null last. A target is the source's share of all words by
    weight; one that would pass ``repeats`` times its source stops there, and the rest is shared anew.
    """
    sums = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), "sources")
    parts = -(-sums.count() // SOURCE_ROWS) or 1
    numbered = running_sums(sums, [F.col("source").isNull(), F.col("source")], ["one", "source_size"], parts, "source-order")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("one_to") - 1) % len(weights) + 1).cast("int"))
    placed = numbered.select(
        "source", (F.col("one_to") - 1).alias("source_no"), "source_size",
        (F.col("source_size_to") - F.col("source_size")).alias("before"), weight.alias("weight"),
        (F.col("source_size") * repeats).alias("cap"),
    )
    # In the order in which sources run out, a source is capped if its fair share of what is left is.
    whole = placed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight_sum = whole["words"] or 0, whole["weight"] or 0
    runs_out = F.col("cap") * (F.lit(lcm(*weights)).cast("long") / F.col("weight")).cast("long")
    filled = running_sums(placed, [runs_out, F.col("source_no")], ["cap", "weight"], parts, "source-caps")
    wide = lambda c: c.cast("decimal(19,0)")
    words_left = F.lit(words).cast("long") - (F.col("cap_to") - F.col("cap"))
    weight_left = F.lit(weight_sum).cast("long") - (F.col("weight_to") - F.col("weight"))
    capped = wide(F.col("cap")) * wide(weight_left) <= wide(words_left) * wide(F.col("weight"))
    judged = written(filled.withColumn("capped", capped), "source-targets")
    full = judged.where("capped").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    rest, share = words - (full["cap"] or 0), weight_sum - (full["weight"] or 0)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(share))
    )
    return judged.select("source", "source_no", "source_size", "before", "weight", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    ``size`` is the number of words, ``taken`` the words that the mix takes of the document, whole
    copies of it, up to ``repeats`` of them. The order within a source is by MD5 of the seed and the
    id, so reruns agree; equal ids are told apart by size. Null and empty texts have size 0 and are
    never taken; null is a source of its own, the last. A source without words has target 0.
    Repeated rows are documents of their own. A source's taken words miss its target by less than
    about its longest document, as documents are not cut. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.size(words_of(F.col(text_col))).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    sources = written(source_targets(sizes, weights, repeats), "targets")
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    known = sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_no", "source_size", "before", "target",
        (F.lit(lcm(*weights)).cast("long") / F.col("weight")).cast("long").alias("pace"),
    )
    queued = running_sums(known, [F.col("source_no"), shuffle, F.col("doc_id"), F.col("size")], ["size"], parts, "queue")
    # Words of the source sent when the first copy ends; a whole number stands for the finish time.
    first = F.col("size_to") - F.col("before")
    finish = lambda copy: (copy * F.col("source_size") + first) * F.col("pace")
    copies = queued.where("size > 0").select(
        "source_no", "size", F.explode(F.array(*[finish(F.lit(k).cast("long")) for k in range(repeats)])).alias("finish")
    )
    line = running_sums(copies, [F.col("finish"), F.col("source_no")], ["size"], parts, "line")
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    last = line.where(F.col("size_to") <= budget).agg(F.max(F.struct("finish", "source_no")).alias("cut")).first()["cut"]
    at, no = (last["finish"], last["source_no"]) if last else (-1, -1)
    in_time = lambda f: (f < F.lit(at).cast("long")) | ((f == F.lit(at).cast("long")) & (F.col("source_no") <= no))
    taken = sum((in_time(finish(F.lit(k).cast("long"))).cast("long") for k in range(repeats)), F.lit(0).cast("long"))
    return queued.select("doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"))
