"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on a bounded sample of trusted (well labelled) texts. Its tables come from
joins of counts: trigram counts with their contexts, continuation counts of pairs with theirs.
They are sharded by the middle word of a trigram, so that all that one position needs (trigram,
context, pair, back-off) lies in one shard; a frequent middle word is spread over the first.

Scoring is a join of the texts' trigrams with those shards. A Bloom filter of the model's pairs spares
it the trigrams of which the model knows no pair: their probability follows from two numbers per
word. A task packs its texts' other trigrams into one compressed block per shard, with the texts' keys. Blocks of a shard are dealt over salts, so a
group holds a bounded number of trigrams however large the corpus and however frequent a word;
the bounded model shard is repeated per salt. A group returns one sum per text. Texts of equal
content share a key and a perplexity.

A text is kept if its perplexity is at most its language's threshold: a high quantile over all
trusted texts that were not trained on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, give_back, small_batches, spare_name, words_of, written

EDGE, LARGE, DIGIT, SIGN, OTHER = range(5)
FIRST_WORD = 5
SUB = 2
CHUNK_TOKENS = 1 << 18
ID_BITS = 21
ID = (1 << ID_BITS) - 1
UPPER = re.compile(r"[A-Z].*[A-Z]")
PLAIN = re.compile(r"[^\W\d_]+['-]?[^\W\d_]*[.,;:]?")


class Vocabulary(dict):
    """Word to id; a word outside of it gets the id of its shape, kept in a bounded memory."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words, FIRST_WORD))
        self.limit = len(self) + 200_000

    def __missing__(self, word: str) -> int:
        if any(c.isdigit() for c in word):
            shape = DIGIT
        elif not PLAIN.fullmatch(word):
            shape = SIGN
        else:
            shape = LARGE if UPPER.search(word) else OTHER
        if len(self) < self.limit:
            self[word] = shape
        return shape

    def ids(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").split()
        text = [w.decode("utf-8") for w in words] if words else []
        return np.fromiter(map(self.__getitem__, text), np.int32, len(text))


def shard_of(first: np.ndarray, middle: np.ndarray, shards: int) -> np.ndarray:
    mixed = middle.astype(np.int64) * 2654435761 % (1 << 32) // 7 + first.astype(np.int64) % SUB * 97
    return mixed % shards


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(whole, F.lit(1)).alias("k2")]


def _trigrams(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whatever stages before this one left to the worker.
        forget()
        give_back()
        vocabulary = Vocabulary(words)
        for batch in batches:
            found = []
            for text in batch.column(0):
                seq = np.concatenate([[EDGE, EDGE], vocabulary.ids(text.as_py()), [EDGE]]).astype(np.int32)
                found.append(np.stack([seq[:-2], seq[1:-1], seq[2:]]))
            w = (np.concatenate(found, axis=1) if found else np.zeros((3, 0))).astype(np.int64)
            t, c = np.unique((w[0] << 2 * ID_BITS) + (w[1] << ID_BITS) + w[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], ["t", "c"])
        del vocabulary
        give_back()

    return run


def _discounts(counts: DataFrame, column: str) -> list[float]:
    """D1, D2, D3+ from the numbers of counts of one to four."""
    got = {r[column]: r["count"] for r in counts.where(F.col(column) <= 4).groupBy(column).count().collect()}
    n = [got.get(k, 0) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(k + 1, max(0.0, k + 1 - (k + 2) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in range(3)]


def _discount(column: str, d: list[float]) -> Column:
    c = F.col(column)
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _in_context(counts: DataFrame, d: list[float]) -> DataFrame:
    """Each sequence with its context (all but the last word), the context's total, the mass that
    its discounts free for the lower order, and the context's first sequence. One shuffle."""
    context = Window.partitionBy("before")
    rows = counts.select("t", "c", F.shiftright("t", ID_BITS).alias("before"))
    return rows.select(
        "t", "before", ((F.col("c") - _discount("c", d)) / F.sum("c").over(context)).alias("share"),
        (F.sum(_discount("c", d)).over(context) / F.sum("c").over(context)).alias("free"),
        F.min("t").over(context).alias("head"),
    )


def _rows(found: DataFrame, kind: int, first: Column, middle: Column, value: Column) -> DataFrame:
    """A model row of each sequence, and of each context once."""

    def row(k: int, key: str, v: Column) -> Column:
        return F.struct(F.lit(k).alias("kind"), first.alias("first"), middle.alias("middle"), F.col(key).alias("key"), v.alias("value"))

    own, context = row(kind, "t", value), row(kind + 1, "before", F.col("free"))
    both = F.when(F.col("t") == F.col("head"), F.array(own, context)).otherwise(F.array(own))
    return found.select(F.inline(both))


def train(trusted: DataFrame, min_count: int = 2) -> tuple[list[str], np.ndarray, DataFrame]:
    """Vocabulary, unigram probabilities by id, and model rows (kind, first, middle, key, value).

    ``trusted`` has the column ``text``; it is the bounded training sample, and nothing else bounds
    the model. A word of ``min_count`` occurrences there, and of 64 letters at most, has an id of its
    own; the others share their shape's, which is how the model learns of words it has not seen.
    Samples with more words than ids of 21 bits are refused, not cut.

    Kind 0: discounted trigram share; 1: mass a context of two frees; 2: probability of a seen
    pair; 3: mass a context of one frees.
    """
    counted = trusted.select(F.explode(words_of(F.col("text"))).alias("w")).groupBy("w").count()
    own = counted.where((F.col("count") >= min_count) & (F.length("w") <= 64))
    most = (1 << ID_BITS) - FIRST_WORD
    words = [r.w for r in own.orderBy(F.desc("count"), "w").limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"the training sample has over {most} words; draw fewer rows")
    size = FIRST_WORD + len(words)
    tri = written(
        trusted.select(F.col("text").cast("binary")).mapInArrow(_trigrams(words), "t long, c long")
        .groupBy("t").agg(F.sum("c").alias("c")),
        "trigrams",
    )
    pair = F.col("t").bitwiseAND(F.lit((1 << 2 * ID_BITS) - 1))
    pairs = written(tri.groupBy(pair.alias("t")).agg(F.count("*").alias("c")), "pairs")
    last_word = F.col("t").bitwiseAND(F.lit(ID)).cast("int")
    ends = pairs.groupBy(last_word.alias("w3")).agg(F.count("*").alias("c"))
    d3, d2, d1 = _discounts(tri, "c"), _discounts(pairs, "c"), _discounts(ends, "c")
    # One number per word of the sample's vocabulary.
    p1, last = np.zeros(size), ends.toArrow()
    w, c = (last[x].to_numpy() for x in ("w3", "c"))
    off = np.array(d1)[np.minimum(c, 3) - 1]
    p1[w], free, total = c - off, off.sum(), c.sum()
    p1 = (p1 + free / size) / total if total else np.full(size, 1 / size)

    lower = trusted.sparkSession.createDataFrame(pa.table({"w3": np.arange(size, dtype=np.int32), "p1": p1}))
    of_two = _in_context(tri, d3)
    before = F.col("before")
    threes = _rows(of_two, 0, F.shiftright("before", ID_BITS).cast("int"), before.bitwiseAND(F.lit(ID)).cast("int"), F.col("share"))
    # What hangs on the middle word alone goes to each of the shards that word is spread over.
    of_one = _in_context(pairs, d2).withColumn("w3", last_word).join(lower, "w3")
    twos = _rows(of_one, 2, F.lit(-1), before.cast("int"), F.col("share") + F.col("free") * F.col("p1"))
    return words, p1, threes.unionByName(twos)


MODEL = "shard int, tables array<binary>"


def _squeezed(column: np.ndarray) -> bytes:
    """Eight-byte numbers by byte planes, compressed: a shard's tables go to each of its salts."""
    return zstandard.ZstdCompressor(level=3).compress(column.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueezed(block: bytes) -> bytes:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return planes.reshape(8, -1).T.tobytes()


def _packed(kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> list[bytes]:
    """Of each kind the sorted keys, by their differences, and their values."""
    out = []
    for k in range(4):
        keys, at = np.unique(key[kind == k], return_index=True)
        out += [_squeezed(np.diff(keys, prepend=0).astype("<i8")), _squeezed(value[kind == k][at].astype("<f8"))]
    return out


def _unpacked(tables: list[bytes]) -> list[np.ndarray]:
    """Keys and values of each kind in turn."""
    got = [np.frombuffer(_unsqueezed(x), "<f8" if i % 2 else "<i8") for i, x in enumerate(tables)]
    return [x if i % 2 else np.cumsum(x) for i, x in enumerate(got)]


def _tables(table: pa.Table) -> pa.Table:
    """A shard's packed tables as one."""
    parts = [_unpacked(x.as_py()) for x in table["tables"]]
    kind = np.concatenate([np.repeat(np.arange(4), [len(x) for x in p[::2]]) for p in parts])
    key, value = (np.concatenate([np.concatenate(p[i::2]) for p in parts]) for i in (0, 1))
    out = _packed(kind, key, value)
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "tables": pa.array([out], pa.list_(pa.binary()))})


def _shards(shards: int):
    """Rows as packed tables per shard, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            kind, first, middle, key, value = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "first", "middle", "key", "value")
            )
            to, tables = [], []
            for sub in range(SUB):
                own = np.flatnonzero((first < 0) | (first % SUB == sub))
                shard = shard_of(np.full(len(own), sub), middle[own], shards)
                for s in np.unique(shard):
                    at = own[shard == s]
                    to.append(s)
                    tables.append(_packed(kind[at], key[at], value[at]))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(tables, pa.list_(pa.binary()))], ["shard", "tables"])
        give_back()

    return run


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id plus one, less its leading one."""
    return (np.frexp(ids + 1.0)[1] - 1).astype(np.uint8)


def _rests(ids: np.ndarray, widths: np.ndarray) -> bytes:
    """What the widths leave open, by width: whole low bytes, then the other bits."""
    out = []
    for k in range(1, ID_BITS + 1):
        rest = (ids[widths == k] + 1 - (1 << k)).astype("<u4")
        out += [rest.view(np.uint8).reshape(-1, 4)[:, b].tobytes() for b in range(k // 8)]
        high = (rest >> k // 8 * 8).astype(np.uint8)
        out.append(np.packbits(high[:, None] >> np.arange(k % 8, dtype=np.uint8) & 1).tobytes())
    return b"".join(out)


def _ids(raw: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of these widths from what ``_rests`` wrote, and the bytes after it."""
    out = np.zeros(len(widths), np.int64)
    for k in range(1, ID_BITS + 1):
        at = np.flatnonzero(widths == k)
        n, rest = len(at), np.zeros(len(at), np.int64)
        for b in range(k // 8):
            rest += raw[:n].astype(np.int64) << 8 * b
            raw = raw[n:]
        bits = np.unpackbits(raw[: -(-n * (k % 8) // 8)])[: n * (k % 8)].reshape(n, k % 8)
        rest += (bits.astype(np.int64) << np.arange(k % 8)).sum(axis=1) << k // 8 * 8
        raw = raw[-(-n * (k % 8) // 8) :]
        out[at] = rest + (1 << k) - 1
    return out, raw


def pack_trigrams(doc: np.ndarray, w: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Trigrams (three rows of ids) of ascending documents, each document's in an order of our own.

    Ids fall with a word's frequency, so widths hold nearly all there is to compress; sorted within
    a document they take little. A document's sum does not depend on the order of its trigrams.
    """
    widths = np.stack([_widths(x) for x in w])
    order = np.argsort((doc << 10) + (widths[1].astype(np.int64) << 5) + widths[0], kind="stable")
    w, widths = w[:, order], widths[:, order]
    n = np.unique(doc, return_counts=True)[1].astype("<u4")
    head = squeeze.compress(np.array([len(n)], "<u4").tobytes() + n.tobytes() + widths.tobytes())
    return len(head).to_bytes(4, "little") + head + b"".join(_rests(x, k) for x, k in zip(w, widths))


def unpack_trigrams(block: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams per document, and the trigrams."""
    size = int.from_bytes(block[:4], "little")
    head = unpack.decompress(block[4 : 4 + size])
    docs = int(np.frombuffer(head, "<u4", 1)[0])
    n = np.frombuffer(head, "<u4", docs, 4).astype(np.int64)
    widths = np.frombuffer(head, np.uint8, offset=4 + 4 * docs).reshape(3, -1)
    raw, w = np.frombuffer(block, np.uint8, offset=4 + size), []
    for k in widths:
        ids, raw = _ids(raw, k)
        w.append(ids)
    return n, np.stack(w)


class Known:
    """What a task knows of the model by itself: a Bloom filter of its pairs, and per word its
    probability and the mass it frees. Both are bounded by the training sample."""

    def __init__(self, pairs: np.ndarray, back: np.ndarray, p1: np.ndarray):
        self.back, self.p1 = back, p1
        self.shift = 61 - max(10, (2 * len(pairs)).bit_length())
        self.bits = np.zeros(1 << 61 - self.shift, np.uint8)
        for at in self._places(pairs):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        mixed = [keys.astype(np.uint64) * np.uint64(m) >> np.uint64(self.shift) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        return [x.astype(np.int64) for x in mixed]

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        one, two = (self.bits[at >> 3] >> (at & 7) & 1 for at in self._places((first.astype(np.int64) << ID_BITS) + second))
        return (one & two).astype(bool)

    def alone(self, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        """log10 P(w3 | w1 w2) where neither w1 w2 nor w2 w3 is a pair of the model."""
        return np.log10(self.back[w2] * self.p1[w3])


def _known(model: DataFrame, p1: np.ndarray) -> Known:
    pairs, back = [np.zeros(0, np.int64)], np.ones(len(p1))
    for row in model.select(*[F.get("tables", F.lit(i)).alias(f"t{i}") for i in (4, 6, 7)]).collect():
        keys, words, freed = (_unsqueezed(x) for x in row)
        pairs.append(np.cumsum(np.frombuffer(keys, "<i8")))
        back[np.cumsum(np.frombuffer(words, "<i8"))] = np.frombuffer(freed, "<f8")
    return Known(np.unique(np.concatenate(pairs)), back, p1)


BLOCK = "shard int, salt int, keys binary, block binary, local binary"


def _requests(words: list[str], known: Known, shards: int, salts: int):
    def packed(keys, ids, squeeze, salt):
        doc = np.repeat(np.arange(len(ids)), [len(x) + 1 for x in ids])
        seqs = [np.concatenate([[EDGE, EDGE], x, [EDGE]]).astype("<u4") for x in ids]
        w1, w2, w3 = (np.concatenate([s[k : len(s) - 2 + k] for s in seqs]) for k in range(3))
        # A trigram without a pair of the model is answered here; a text's first one always goes, with that sum.
        start = (w1 == EDGE) & (w2 == EDGE)
        goes = start | known.has(w1, w2) | known.has(w2, w3)
        stays = ~goes
        sums = np.bincount(doc[stays], known.alone(w2[stays], w3[stays]), len(ids))
        local = sums.astype("<f8").tobytes() + np.bincount(doc[stays], minlength=len(ids)).astype("<u4").tobytes()
        doc, w = doc[goes], np.stack([x[goes] for x in (w1, w2, w3)])
        shard, first = shard_of(w[0], w[1], shards), shard_of(np.array([EDGE]), np.array([EDGE]), shards)[0]
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            block = pack_trigrams(doc[own], w[:, own], squeeze)
            yield int(s), salt, keys[np.unique(doc[own])].tobytes(), block, local if s == first else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vocabulary, squeeze = Vocabulary(words), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")], axis=1)
            held, first, size = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                held.append(vocabulary.ids(text.as_py()))
                size += len(held[-1]) + 1
                if size >= CHUNK_TOKENS or i == batch.num_rows - 1:
                    # Which salt a chunk goes to follows from its texts alone.
                    salt = int(keys[first, 0] % salts)
                    rows = list(zip(*packed(keys[first : i + 1], held, squeeze, salt)))
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["shard", "salt", "keys", "block", "local"])
                    held, first, size = [], i + 1, 0
        del vocabulary
        give_back()

    return run


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float | None = None) -> np.ndarray:
    """Values of the wanted keys, ``otherwise`` (or nan) where there is none."""
    out = np.full(len(wanted), np.nan if otherwise is None else otherwise)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        out[hit] = values[at[hit]]
    return out


def log_probability(tables: list[np.ndarray], p1: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
    """log10 P(w3 | w1 w2) from one shard's tables."""
    t = tables
    w1, w2, w3 = (w.astype(np.int64) for w in (w1, w2, w3))
    pair = _find(t[4], t[5], (w2 << ID_BITS) + w3)
    unseen = np.isnan(pair)
    pair[unseen] = _find(t[6], t[7], w2[unseen], 1.0) * p1[w3[unseen]]
    share = _find(t[0], t[1], (w1 << 2 * ID_BITS) + (w2 << ID_BITS) + w3, 0.0)
    return np.log10(share + _find(t[2], t[3], (w1 << ID_BITS) + w2, 1.0) * pair)


SUMS = "k1 long, k2 long, log_p double, n long"


def _answer(p1: np.ndarray):
    def run(requests: pa.Table, model: pa.Table) -> pa.Table:
        forget()
        tables = _unpacked(model["tables"][0].as_py()) if len(model) else [np.zeros(0)] * 8
        unpack, keys, sums, counts = zstandard.ZstdDecompressor(), [], [], []
        for key, block, local in zip(requests["keys"], requests["block"], requests["local"]):
            own = np.frombuffer(key.as_py(), "<i8").reshape(-1, 2)
            n, w = unpack_trigrams(block.as_py(), unpack)
            keys.append(own)
            total = np.add.reduceat(log_probability(tables, p1, *w), np.cumsum(n) - n)
            if len(local.as_py()):
                total += np.frombuffer(local.as_py(), "<f8", len(n))
                n += np.frombuffer(local.as_py(), "<u4", len(n), 8 * len(n))
            sums.append(total)
            counts.append(n)
        k = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
        del tables
        give_back()
        return pa.table({"k1": k[:, 0], "k2": k[:, 1], "log_p": np.concatenate(sums or [np.zeros(0)]), "n": np.concatenate(counts or [np.zeros(0, np.int64)])})

    return run


def perplexities(
    docs: DataFrame, trusted: DataFrame, shards: int = 4, group_tokens: int = 1 << 24, text_col: str = "text",
) -> DataFrame:
    """(k1, k2, perplexity, n_tokens) for every distinct text; ``trusted`` has the column ``text``."""
    small_batches(docs.sparkSession)
    words, p1, model = train(trusted)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    salts = max(1, math.ceil(size / 6 / shards / group_tokens))
    packed = written(model.mapInArrow(_shards(shards), MODEL).groupBy("shard").applyInArrow(_tables, MODEL), "model")
    held = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    asked = docs.select(F.col(text_col).cast("binary").alias("text"), *text_key(F.col(text_col))).mapInArrow(
        _requests(words, _known(packed, p1), shards, salts), BLOCK
    )
    answered = asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(_answer(p1), SUMS)
    sums = answered.groupBy("k1", "k2").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))
    # Copies of a text were counted together; its perplexity is the same.
    return written(
        sums.select("k1", "k2", F.pow(F.lit(10.0), -F.col("log_p") / F.col("n")).alias("perplexity")), "perplexity"
    )


def _level(counts: DataFrame, most: int) -> float:
    """Training rows a language has at most, so that with half of what smaller ones have there are ``most``.

    Only how many languages have each count reaches the driver. Counts that differ add up to the
    trusted rows, so there are fewer of them than the root of twice those rows.
    """
    left, level = float(most), float(most)
    sizes = sorted((r["count"], r.langs) for r in counts.groupBy("count").agg(F.count("*").alias("langs")).collect())
    langs = sum(n for _, n in sizes)
    for count, n in sizes:
        level = left / langs
        if count / 2 > level:
            break
        left, langs = left - n * count / 2, langs - n
    else:
        level = float(most)
    return level


def classify(
    docs: DataFrame, labels: DataFrame, max_trusted: int = 8192, quantile: float = 0.99,
    min_language: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept, k1, k2) of every row.

    Trusted are the well labelled documents, less those labelled toxic where there is such a column.
    About half of ``max_trusted`` of them at most, by hash, train the model: as many of each language,
    but no more than half of what it has. All others set the thresholds, the ``quantile`` of their
    perplexities per language. A language with fewer than ``min_language`` of them, or null, takes the threshold
    over all. A null or empty text has no words and is not kept. Without trusted documents there
    is no threshold and every text with a word is kept. Repeated rows are judged alike; a null
    id stays null.
    """
    good = labels.where(f"`{label_col}` = 1 and `{id_col}` is not null")
    if toxic_col in labels.columns:
        good = good.where(~F.coalesce(F.col(toxic_col) == 1, F.lit(False)))
    good = good.select(F.col(id_col).alias("label_id")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Texts stay where they are: what is joined by id or language has their keys only.
    keyed = written(
        texts.select("doc_id", "lang", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), *text_key(F.col("text"))),
        "keyed",
    )
    trusted = written(keyed.join(good, F.col("doc_id") == F.col("label_id")).select("label_id", "lang", "k1", "k2"), "trusted-keys")
    counts = written(trusted.groupBy("lang").count(), "languages")
    share = F.least(F.lit(0.5), F.lit(_level(counts, max_trusted // 2)) / F.col("count"))
    shares = counts.select(F.col("lang").alias("own_lang"), share.alias("share"))
    draw = F.pmod(F.xxhash64("label_id", F.lit("half")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = written(
        trusted.join(shares, F.col("lang").eqNullSafe(F.col("own_lang"))).where(draw < F.col("share"))
        .select("label_id", "own_lang", "k1", "k2").distinct(),
        "drawn",
    )
    same = (F.col("doc_id") == F.col("label_id")) & F.col("lang").eqNullSafe(F.col("own_lang"))
    picked = F.broadcast(drawn.select("label_id", "own_lang").distinct())
    trains = written(texts.join(picked, same, "left_semi").select("text"), "trusted")
    scores = perplexities(texts, trains, text_col="text")
    # Copies are counted before the join; a copy of a text that was trained on sets no threshold.
    held = (
        trusted.groupBy("lang", "k1", "k2").agg(F.count("*").alias("n"))
        .join(drawn.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
    )
    rest = written(held.join(scores, ["k1", "k2"]).select("lang", "n", "perplexity"), "held")
    cut = F.percentile("perplexity", quantile, F.col("n")).alias("cut")
    own = rest.where("lang is not null").groupBy("lang").agg(cut, F.sum("n").alias("n")).where(F.col("n") >= min_language)
    limits = written(own.select(F.col("lang").alias("own_lang"), "cut"), "thresholds")
    whole = rest.agg(cut).first().cut
    judged = keyed.join(scores, ["k1", "k2"], "left").join(limits, F.col("lang") == F.col("own_lang"), "left").withColumn(
        "threshold", F.coalesce("cut", F.lit(whole if whole is not None else math.inf))
    )
    return judged.select(
        "doc_id", "lang", "n_words", "perplexity", "threshold",
        ((F.col("n_words") > 0) & (F.col("perplexity") <= F.col("threshold"))).alias("kept"), "k1", "k2",
    )


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their own columns."""
    one, two, lang = (spare_name(docs, c) for c in ("k1", "k2", "k_lang"))
    judged = classify(docs, labels, text_col=text_col, lang_col=lang_col, **options)
    kept = written(judged.where("kept").select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("lang").alias(lang)).distinct(), "kept-texts")
    k1, k2 = text_key(F.col(text_col))
    same = (F.col(one) == k1) & (F.col(two) == k2) & F.col(lang).eqNullSafe(docs[lang_col])
    return docs.join(kept, same, "left_semi")
