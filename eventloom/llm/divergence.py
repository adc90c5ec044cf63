"""Source divergence audit: how each source's words differ from every other source's of its language.

Arrow kernels inside ``mapInArrow`` turn texts into partial counts (lower-casing, regular-expression
split, dictionary encoding, hash grouping); Spark merges them once per (language, term). The kept
counts are then cut into columnar shards of terms, and each shard adds its share of every
source pair's divergence. A shard holds a bounded number of counts; where a language has more than
``BLOCK`` sources, a shard is split again into tiles of two blocks of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# What stands between terms, once A-Z are lower-cased: ASCII that is no letter.
SEPARATOR = r"[\x00-\x60\x7B-\x7F]+"
PARTIAL = "lang string, source string, term string, n long, docs long"
SHARD_ROWS = 1 << 17
BLOCK = 256
# Bytes of text split at once, rows of partial counts held before they are merged.
SLICE_BYTES = 1 << 22
HOLD_ROWS = 1 << 19
# Terms whose shares are held as one matrix.
CHUNK_TERMS = 4096


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about SLICE_BYTES of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + SLICE_BYTES, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def _merged(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    both = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return both.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def _of_slice(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents; a null term counts a group's documents."""
    groups = pa.table({"lang": pc.fill_null(batch.column("lang"), ""), "source": pc.fill_null(batch.column("source"), "")})
    group_docs = groups.group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    rows = len(group_docs)
    of_groups = pa.table(
        {
            "lang": group_docs["lang"], "source": group_docs["source"], "term": pa.nulls(rows, pa.string()),
            "n": pa.array(np.zeros(rows, np.int64)), "docs": group_docs["count_all"],
        }
    )
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), pattern=SEPARATOR)
    coded = pc.list_flatten(lists).dictionary_encode()
    terms = coded.dictionary
    owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    # One key for (document, term), so that repeats within a document are counted by one hash.
    width = max(len(terms), 1)
    key = pa.table({"key": pa.array(owner * width + coded.indices.to_numpy(zero_copy_only=False))})
    in_doc = key.group_by("key", use_threads=False).aggregate([([], "count_all")])
    found = in_doc["key"].to_numpy()
    doc, term = found // width, found % width
    names = pa.chunked_array([pc.take(terms, pa.array(term))]).combine_chunks()
    lang, source = (groups[c].take(pa.array(doc)) for c in ("lang", "source"))
    counted = pa.table(
        {"lang": lang, "source": source, "term": names, "n": in_doc["count_all"], "docs": pa.array(np.ones(len(doc), np.int64))}
    )
    return _merged([of_groups, counted.filter(pc.not_equal(counted["term"], ""))])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch):
            held.append(_of_slice(part))
            rows += len(held[-1])
            if rows > HOLD_ROWS:
                held = [_merged(held)]
                rows = len(held[0])
                pa.default_memory_pool().release_unused()
                if rows > HOLD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def partial_counts(docs: DataFrame) -> DataFrame:
    """Counts of each task: (lang, source, term, n, docs), and one null term per group."""
    return docs.select(*[F.col(c).cast("string") for c in ("lang", "source", "text")]).mapInArrow(_count_terms, PARTIAL)


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of terms in ``min_docs`` documents of the language.

    ``first`` marks one row of each kept term. A null term with n = 0 stands for the group itself.
    """
    one = Window.partitionBy("lang", "term")
    return (
        partial_counts(docs)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns(
            {
                "lang_docs": F.sum("docs").over(one), "lang_n": F.sum("n").over(one),
                "first": F.col("term").isNotNull() & (F.col("source") == F.min("source").over(one)),
            }
        )
        .where((F.col("lang_docs") >= min_docs) | F.col("term").isNull())
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def _share(count: np.ndarray, total, scale: int) -> np.ndarray:
    """1 + floor(scale * count / total) in whole numbers, three digits at a time.

    Exact while 1000 * total fits a long: up to nine quadrillion words of a language.
    """
    whole, rest = count // total, count % total
    while scale > 1:
        step = min(scale, 1000)
        rest = rest * step
        whole, rest = whole * step + rest // total, rest % total
        scale //= step
    return whole + 1


def _gap(p, q):
    return (p - q) * (p - q) // (p + q)


def _shard(smooth: int, scale: int, top: int):
    """The function that turns one shard's counts into its share of pairs, and its best terms."""

    def run(key: tuple, counts: pa.Table, roster: pa.Table) -> pa.Table:
        lang, _, block_a, block_b = (k.as_py() for k in key)
        kept = roster["kept"][0].as_py() if len(roster) else 0
        terms_here = roster["terms"][0].as_py() if len(roster) else 0
        names = roster["source"].to_pylist()
        blocks = roster["block"].to_numpy()
        total = roster["total"].to_numpy() + smooth * kept
        place = {s: i for i, s in enumerate(names)}
        a, b = np.flatnonzero(blocks == block_a), np.flatnonzero(blocks == block_b)
        out = []
        coded = counts["term"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        who = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
        n = counts["n"].to_numpy().astype(np.int64)
        p = _share(n + smooth, total[who], scale) if len(n) else n
        sums = np.zeros((len(a), len(b)), np.int64)
        if kept:
            none = _share(np.full(len(names), smooth, np.int64), total, scale)
            order = np.argsort(code, kind="stable")
            seen = len(coded.dictionary)
            for lo in range(0, seen, CHUNK_TERMS):
                hi = min(lo + CHUNK_TERMS, seen)
                rows = order[np.searchsorted(code[order], lo) : np.searchsorted(code[order], hi)]
                grid = np.repeat(none[:, None], hi - lo, axis=1)
                grid[who[rows], code[rows] - lo] = p[rows]
                for i, s in enumerate(a):
                    sums[i] += _gap(grid[s], grid[b]).sum(axis=1)
            sums += (terms_here - seen) * _gap(none[a][:, None], none[b][None, :])
        for i, s in enumerate(a):
            for j, t in enumerate(b):
                if s != t:
                    out.append((names[s], "pair", names[t], int(sums[i, j])))
                    if block_a != block_b:
                        out.append((names[t], "pair", names[s], int(sums[i, j])))
        if block_a == block_b and len(n):
            whole = counts["lang_n"].to_numpy().astype(np.int64) + smooth
            q = _share(whole, roster["lang_total"][0].as_py() + smooth * kept, scale)
            more = np.flatnonzero((n > 0) & (p > q))
            best = pa.table(
                {"source": counts["source"].take(more), "term": counts["term"].take(more), "value": pa.array(_gap(p[more], q[more]))}
            ).sort_by([("source", "ascending"), ("value", "descending"), ("term", "ascending")])
            source = best["source"].to_pylist()
            run_of = 0
            for k, (s, t, v) in enumerate(zip(source, best["term"].to_pylist(), best["value"].to_pylist())):
                run_of = run_of + 1 if k and s == source[k - 1] else 1
                if run_of <= top:
                    out.append((s, "term", t, v))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table(
            [pa.array([lang] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["lang", "source", "part", "item", "value"],
        )

    return run


def audit(
    docs: DataFrame, min_docs: int = 10, smooth: int = 2, scale: int = 1_000_000_000, top: int = 10,
    shard_rows: int = SHARD_ROWS, block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of source pairs, and each source's own words.

    Every occurring (lang, source) is a group. Part ``pair`` has one row for each other source of
    the language; part ``term`` the ``top`` terms a group uses more than its language does. Null
    lang, source and text read as ''. A group without terms, or a language that keeps none, has
    its pair rows (value 0 in the latter) and no term rows; a language with one source has no
    pair rows; an empty table gives no rows. Repeated rows count as often as they stand there.
    Equal values are ranked by the item's UTF-8 bytes. Other columns are not read.
    """
    counts = written(kept_counts(docs, min_docs), "term-counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = written(
        counts.groupBy("lang").agg(
            F.sum(F.col("first").cast("long")).alias("kept"), F.sum("n").alias("lang_total"),
            F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"),
            F.ceil(F.count(F.when(F.col("term").isNull(), 1)) / block).cast("int").alias("blocks"),
        ),
        "term-langs",
    )
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    mine = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    tiles = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tile = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
    placed = counts.where("term is not null").join(langs, "lang").withColumns({"shard": shard, "block": mine})
    dealt = placed.select("*", tiles).select("lang", "shard", *tile, "source", "term", "n", "lang_n")
    terms = placed.groupBy("lang", "shard").agg(F.sum(F.col("first").cast("long")).alias("terms"))
    roster = (
        groups.join(langs, "lang")
        .withColumn("block", mine)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        .join(terms, ["lang", "shard"], "left")
        .select("*", tiles)
        .select("lang", "shard", *tile, "source", "block", "total", "kept", "lang_total", F.coalesce("terms", F.lit(0)).alias("terms"))
    )
    # New column identities: both sides come from the same table.
    roster = roster.toDF(*roster.columns)
    key = ["lang", "shard", "a", "b"]
    shares = dealt.groupBy(*key).cogroup(roster.groupBy(*key)).applyInArrow(
        _shard(smooth, scale, top), "lang string, source string, part string, item string, value long"
    )
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return (
        shares.groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
        .where((F.col("part") == "pair") | (F.col("rank") <= top))
    )
