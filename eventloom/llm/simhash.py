"""Near-duplicate texts by SimHash fingerprints and multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints within three bits agree in one
half up to one bit, so each fingerprint enters, per half, the 33 buckets of the Hamming ball of
radius one around that half. A bucket's fingerprints are checked by their complete distance.

- Equal fingerprints are collapsed before anything else: exact copies cost one row.
- A bucket yields at most one link per member (a spanning forest of its true links), never all
  pairs; components are the same.
- Buckets stream through sorted partitions. A half shared by more than ``max_bucket``
  fingerprints is cut into blocks, and each pair of blocks is a bucket of its own: exact, with
  bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, spare_name, written
from .components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
CHUNK = 1 << 16


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash over word shingles as a signed 64-bit number; no words give zero."""
    from xxhash import xxh64_digest

    words = raw.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        digests = b"".join(map(xxh64_digest, grams, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) spanning the components within ``bits`` of distinct ``fps``."""
    left, members, roots = fps, [], []
    while len(left) > 1:
        root, rest, front = left[0], left[1:], left[:1]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 22) // len(rest))
            for k in range(0, len(front), step):
                near |= (np.bitwise_count(front[k : k + step, None] ^ rest) <= bits).any(axis=0)
            front, rest = rest[near], rest[~near]
            members.append(front)
            roots.append(np.full(len(front), root))
        left = rest
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (empty, empty)


def _bucket_links(bits: int):
    """Links of each bucket in a stream sorted by (key, pair)."""

    def bucket(keys, fps, out):
        half = np.where(keys[:1] >> 32 & 1, fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))
        if len(fps) > 1 and (half == np.uint64(keys[0] & 0xFFFFFFFF)).any():
            out.append(forest(np.unique(fps), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        held = [(empty, empty, empty)]

        def links(columns, last: bool):
            """Links of the buckets that are complete, and what is left over."""
            key, pair, fp = columns
            new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            edges = np.concatenate([[0], new, [len(key)] if last else []]).astype(np.int64)
            out: list = []
            sizes = np.diff(edges)
            for i in np.flatnonzero(sizes > 1):
                a, b = edges[i], edges[i + 1]
                bucket(key[a:b], fp[a:b].view(np.uint64), out)
            done = edges[-1]
            found = [np.concatenate(x).view(np.int64) if x else empty for x in (list(zip(*out)) or [(), ()])]
            batch = pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])
            return batch, tuple(c[done:] for c in columns)

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            columns = tuple(np.concatenate(c) for c in zip(*held))
            if len(columns[0]) and columns[0][0] == columns[0][-1] and columns[1][0] == columns[1][-1]:
                continue  # one bucket so far: it goes on
            result, rest = links(columns, False)
            held = [rest]
            yield result
        columns = tuple(np.concatenate(c) for c in zip(*held))
        if len(columns[0]):
            yield links(columns, True)[0]
        del held, columns
        give_back()

    return run


def near_links(fps: DataFrame, bits: int = 3, max_bucket: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``bits``."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves with balls of radius one find distances up to three")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)

    def ball(half: Column, which: int) -> Column:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
        return F.transform(flips, lambda x: half.bitwiseXOR(x).bitwiseOR(F.lit(which << 32)))

    probes = fps.select("fp", F.explode(F.concat(ball(low, 0), ball(high, 1))).alias("key"))
    owns = fps.select(F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("key"))
    crowded = owns.groupBy("key").count().where(F.col("count") > max_bucket)
    # All buckets that a crowded half reaches; one row per max_bucket fingerprints at most.
    around = F.transform(
        F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)]),
        lambda x: F.col("key").bitwiseXOR(x),
    )
    reached = written(
        crowded.select(F.explode(around).alias("key"), "count")
        .groupBy("key")
        .agg(F.ceil(F.sum("count") / max_bucket).cast("int").alias("blocks")),
        "crowded",
    )
    if reached.isEmpty():
        rows = probes.select("key", F.lit(0).alias("pair"), "fp")
    else:
        split = probes.join(reached, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        paired = split.select("*", other.alias("other")).select(
            "key",
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1).alias("pair"),
            "fp",
        )
        rows = probes.join(reached, "key", "left_anti").select("key", F.lit(0).alias("pair"), "fp").union(paired)
    dealt = rows.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_bucket_links(bits), "a long, b long")


def _marked(docs: DataFrame, text_col: str, shingle: int, name: str) -> DataFrame:
    """``docs`` with each row's fingerprint in column ``name``."""

    @F.pandas_udf("long")
    def mark(texts):
        found = texts.map(lambda t: fingerprint(t or b"", shingle)).astype("int64")
        give_back()
        return found

    small_batches(docs.sparkSession)
    return docs.withColumn(name, mark(F.col(text_col).cast("binary")))


def classes(
    docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least id reachable over links.

    Null and empty texts share fingerprint zero and are linked like any others. Rows with a null
    id keep it and belong to their component, whose id ignores nulls (null if it has no other).
    Repeated rows come back repeated. Other columns are not read. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, all columns kept: the least id, nulls last, then least text.

    Of rows with the same id and the same text in one component one stays. Every other rule is
    that of ``classes``.
    """
    name, key = spare_name(docs, "fp"), spare_name(docs, "row_key")
    marked = _marked(docs, text_col, shingle, name).withColumn(key, F.xxhash64(text_col))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).cast("long").alias("i"), F.col(key).alias("k"))
    rows = written(marked.select(F.col(name).alias("fp"), order.alias("first")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("first").alias("first"))
    roots = components(near_links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "first", F.coalesce("root", "fp").alias("root")
    )
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.i", "first.k")
    same = docs[id_col].cast("long").eqNullSafe(kept.i) & (F.xxhash64(docs[text_col]) == kept.k)
    left = docs.join(kept, same, "left_semi")
    return left.withColumn(key, F.xxhash64(text_col)).dropDuplicates([id_col, key]).drop(key)
