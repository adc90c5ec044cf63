"""Language-model scores from a log-frequency Bloom filter of word pairs.

Three passes over the texts: word counts, counts of all pairs of words, scores. A pair's count c is
kept as its level 1 + floor(log_b c): the filter holds (pair, 1) .. (pair, level), so probing level
after level until the first miss gives the count back, rounded down. The filter is built in shards
and broadcast to the workers, which probe it in numpy.

Probability of a word w after v (the end of a text counts as a word, and stands before the first):

    P(w | v) = max(c'(v, w) - d, 0) / c(v) + r(v) * U(w),    U(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

with c' the count read back from the filter and r(v) exactly the mass that v's discounted pairs
leave, so that the probabilities of all words after v add up to one (but for filter errors).

Scale. Frequent words (``head`` of them, a bound) travel with the task, under their rank. Every
other word goes by a 63-bit hash. The filter holds its count and its r(v) c(v) too, each as
exponent levels and ten bits below the leading one, so probes alone score a known pair of any words
(numbers above 2047 are read back rounded down, by 0.1 % at most). The exact counts of such words,
which the unigram score needs, are joined by shuffle as pre-aggregated (row, word, count); that adds
log U(w) and, as it stands before the next word, log r(w). A filter larger than ``max_filter_mb``
is probed in several passes, a group of shards each. A pair lies in the shard of its rare word (the
first, if both are); only of two rare words that lie in different passes does a row move.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

#: The end of a text. Words hold no white space, so no word is equal to it.
END = b" "
LONGEST_HEAD_WORD = 64
DISCOUNT = 0.5
#: Bits of an entry, four to each 64-bit block it lies in.
HASHES = 8
BITS_PER_ENTRY = 12.5
LEVEL_BASE = math.sqrt(2)
#: A word's numbers are read with few errors: a few probes in a million.
WORD_HASHES = 20
WORD_BITS_PER_ENTRY = 30
MANTISSA = 10
FLUSH = 200_000
#: Bytes of text that are split into words at a time; a longer text is one chunk.
CHUNK_BYTES = 4 << 20
#: Keys that the filter looks up at a time.
RUN = 1 << 15
#: Tokens to a shard of the pair counts, which one task merges in memory.
SHARD_TOKENS = 1 << 20
#: The part of a word's hash that deals it to a shard.
HASH_PART = (1 << 62) - 1


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.ceil(LEVEL_BASE ** (np.asarray(level, float) - 1) - 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of the SplitMix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(pairs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    one = _mix(pairs + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return one, _mix(one ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _places(one: np.ndarray, step: np.ndarray, k: int, size) -> tuple[np.ndarray, np.ndarray]:
    """An entry's k-th block among ``size``, by the upper half of a hash, and the hash, whose lower
    24 bits name four bits there."""
    x = one + np.uint64(k) * step
    return (x >> np.uint64(32)) * size >> np.uint64(32), x


def _filled(entries: list[tuple[np.ndarray, int]], bits_per_entry: float, hashes: int) -> np.ndarray:
    """Filter of keys with their levels, as bytes; the last eight tell the number of blocks."""
    size = max(1, math.ceil(sum(len(keys) for keys, _ in entries) * bits_per_entry / 64))
    if size >> 32:
        raise ValueError("a shard of the filter holds at most 2^32 blocks")
    bits = np.zeros(64 * size, bool)
    for keys, level in entries:
        one, step = _hashes(keys, level)
        for k in range(hashes // 4):
            block, x = _places(one, step, k, np.uint64(size))
            for b in range(4):
                bits[block << np.uint64(6) | x >> np.uint64(6 * b) & np.uint64(63)] = True
    return np.append(np.packbits(bits, bitorder="little"), np.frombuffer(size.to_bytes(8, "little"), np.uint8))


def fill(pairs: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Filter of one shard as bytes."""
    entries = [(pairs[levels >= level], level) for level in range(1, int(levels.max(initial=0)) + 1)]
    return _filled(entries, BITS_PER_ENTRY, HASHES)


def _marks(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What stands for a positive number in the filter: its exponent's levels, and set bits below."""
    top = np.frexp(x.astype(float))[1].astype(np.int64)
    for level in range(1, int(top.max(initial=0)) + 1):
        yield level, top >= level
    for j in range(MANTISSA):
        shift = top - 2 - j
        yield 64 + j, (shift >= 0) & (x >> np.maximum(shift, 0) & 1 == 1)


def share_keys(words: np.ndarray) -> np.ndarray:
    return _mix(words ^ np.uint64(0xA24BAED4963EE407))


def fill_words(words: np.ndarray, counts: np.ndarray, left: np.ndarray, certain: int) -> np.ndarray:
    """Filter of one shard's words as bytes: counts, and what is left of words seen twice or more.

    What is left of a word seen once is ``certain`` and is not held.
    """
    often = counts > 1
    kinds = [(words, counts), (share_keys(words[often]), left[often])]
    return _filled([(keys[mask], mark) for keys, x in kinds for mark, mask in _marks(x)], WORD_BITS_PER_ENTRY, WORD_HASHES)


class Filter:
    """Shards side by side; ``first`` and ``size`` in blocks, size 0 where a shard is not held."""

    def __init__(self, shards: dict[int, bytes], n_shards: int):
        self.first, self.size = np.zeros(n_shards, np.uint64), np.zeros(n_shards, np.uint64)
        parts, at = [], 0
        for shard, blob in sorted(shards.items()):
            parts.append(np.frombuffer(blob, "<u8", len(blob) // 8 - 1))
            self.first[shard], self.size[shard] = at, len(parts[-1])
            at += len(parts[-1])
        self.blocks = np.concatenate(parts) if parts else np.zeros(1, np.uint64)

    @classmethod
    def over(cls, first: np.ndarray, size: np.ndarray, blocks: np.ndarray) -> Filter:
        """A filter of arrays, which travel to workers that lack this module."""
        out = cls.__new__(cls)
        out.first, out.size, out.blocks = first, size, blocks
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.first, self.size, self.blocks

    def _runs(self, keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Keys that may be held: where they stand, the key, its shard's first block and size. Shard by
        shard, a short run at a time, so that blocks and what is worked out of keys stay in the cache."""
        at = np.flatnonzero(self.size[shard])
        at = at[by_shard(shard[at], len(self.size))]
        for k in range(0, len(at), RUN):
            own = at[k : k + RUN]
            yield own, keys[own], self.first[shard[own]], self.size[shard[own]]

    def _hits(self, keys: np.ndarray, first: np.ndarray, size: np.ndarray, level: int, hashes: int) -> np.ndarray:
        """Where the keys stand that the filter holds at a level."""
        one, step = _hashes(keys, level)
        at = None
        for k in range(hashes // 4):
            block, x = _places(one, step, k, size)
            block += first
            # Signed places are gathered faster.
            found = self.blocks.take(block.view(np.int64))
            hit = found >> (x & np.uint64(63))
            for b in range(1, 4):
                hit &= found >> (x >> np.uint64(6 * b) & np.uint64(63))
            hit &= np.uint64(1)
            hit = np.flatnonzero(hit == 1)
            at = hit if at is None else at.take(hit)
            if len(hit) < len(one):
                one, step, first, size = (y.take(hit) for y in (one, step, first, size))
        return at

    def _top(self, keys: np.ndarray, first: np.ndarray, size: np.ndarray, hashes: int) -> np.ndarray:
        """The levels of one run."""
        out, at, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(at) and level < 63:
            level += 1
            hit = self._hits(keys, first, size, level, hashes)
            if len(hit) < len(at):
                at, keys, first, size = (y.take(hit) for y in (at, keys, first, size))
            out[at] = level
        return out

    def levels(self, pairs: np.ndarray, shard: np.ndarray, hashes: int = HASHES) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        for own, keys, first, size in self._runs(pairs, shard):
            out[own] = self._top(keys, first, size, hashes)
        return out

    def numbers(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Numbers as ``_marks`` wrote them; 0 for a key that is not held."""
        out = np.zeros(len(keys), np.int64)
        for own, key, first, size in self._runs(keys, shard):
            top = self._top(key, first, size, WORD_HASHES)
            x = np.where(top > 0, 1 << np.maximum(top - 1, 0), 0)
            for j in range(MANTISSA):
                at = np.flatnonzero(top >= j + 2)
                at = at[self._hits(key[at], first[at], size[at], 64 + j, WORD_HASHES)]
                x[at] |= 1 << (top[at] - 2 - j)
            out[own] = x
        return out


class RareWords:
    """Counts of words outside of the frequent ones, and the shares their pairs leave, from the filter.

    What was read is kept, in a bounded memory. A word that the filter does not know counts 0.
    """

    def __init__(self, words: Filter, n_shards: int, certain: int):
        self.words, self.n_shards, self.certain = words, n_shards, certain
        self._keep(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _keep(self, h: np.ndarray, count: np.ndarray, rest: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.count, self.rest = h[order], count[order], rest[order]

    def _read(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shard = word_shards(h, self.n_shards)
        count = self.words.numbers(h.astype(np.uint64), shard)
        left = np.full(len(h), self.certain)
        often = np.flatnonzero(count > 1)
        left[often] = self.words.numbers(share_keys(h[often].astype(np.uint64)), shard[often])
        return h, count, np.clip(left / 2 / np.maximum(count, 1), 1e-12, 1)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, back = np.unique(h, return_inverse=True)
        new = own[~np.isin(own, self.h)]
        if len(self.h) + len(new) > FLUSH:
            self._keep(*self._read(own))
        elif len(new):
            self._keep(*map(np.concatenate, zip((self.h, self.count, self.rest), self._read(new))))
        at = np.searchsorted(self.h, own)[back]
        return self.count[at], self.rest[at]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows with at most ``most`` bytes of text in the last column, or a single row, at a
    time. A row counts as 16 bytes more, so that empty texts fill a chunk too."""
    held, room = [], most
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
        used, at = np.append(0, np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 16)), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(used, used[at] + room, "right")) - 1
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                room -= used[to] - used[at]
                at = to
            if at < batch.num_rows or room <= 0:
                yield pa.concat_batches(held)
                held, room = [], most
    if held:
        yield pa.concat_batches(held)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts, with A-Z in lower case; for each token its number among them, the
    count of words for a text's end; and where, among the tokens, each text's end stands."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    words = lists.flatten()
    found = words.dictionary_encode()
    codes, sizes = found.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # White space at either end of a text, or a text without a word, leaves an empty string.
    empty = pc.index(found.dictionary, pa.scalar("")).as_py()
    if empty >= 0:
        none = codes == empty
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[none], minlength=len(sizes))
        codes = codes[~none]
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(codes) + len(ends), len(found.dictionary), np.int64)
    stands = np.ones(len(out), bool)
    stands[ends] = False
    out[stands] = codes
    return found.dictionary.view(pa.binary()), out, ends


def word_hash(word: bytes) -> int:
    """A negative number that stands for a word outside of the frequent ones, as ``hashed`` has it."""
    return (xxhash.xxh64_intdigest(word, 42) & (1 << 63) - 1) - (1 << 63)


def hashed(word: str) -> Column:
    return F.xxhash64(word).bitwiseOR(F.lit(-(1 << 63)))


class Ids:
    """Word to id: the rank of a frequent word, the hash of another."""

    def __init__(self, head: dict[bytes, int]):
        self.head, self.end = pa.array(head, pa.binary()), head[END]
        self.ranks = np.fromiter(head.values(), np.int64, len(head))

    def of(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, value_set=self.head)
        rare = at.is_null().to_numpy(zero_copy_only=False)
        out = self.ranks[at.fill_null(0).to_numpy()]
        out[rare] = np.fromiter(map(word_hash, words.filter(pa.array(rare)).to_pylist()), np.int64, at.null_count)
        return out

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different ids of texts' tokens, ascending; for each token its number among them; the ends."""
        words, codes, ends = _split(texts)
        ids, back = np.unique(np.append(self.of(words), self.end), return_inverse=True)
        return ids, back[codes], ends


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair of ids: both ranks, or a hash."""
    v, w, rare = v.astype(np.uint64), w.astype(np.uint64), (v < 0) | (w < 0)
    keys = v << np.uint64(32) | w
    keys[rare] = _mix(v[rare] * np.uint64(0x9E3779B97F4A7C15) + _mix(w[rare] ^ np.uint64(0xD1B54A32D192ED03)))
    return keys


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``x``, and where in it another value begins."""
    order = np.argsort(x)
    own = x[order]
    return order, np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])


def by_shard(shard: np.ndarray, n_shards: int) -> np.ndarray:
    """An order of rows by shard, stable; numbers of 16 bits are not compared but dealt."""
    return np.argsort(shard.astype(np.uint16) if n_shards <= 1 << 16 else shard, kind="stable")


def word_shards(h: np.ndarray, n_shards: int) -> np.ndarray:
    return (h & HASH_PART) % n_shards


def pair_shards(keys: np.ndarray, v: np.ndarray, w: np.ndarray, n_shards: int) -> np.ndarray:
    """A rare word's pairs lie with it; pairs of ranks are dealt in short runs, whatever their first."""
    runs = (_mix(keys >> np.uint64(8)) % np.uint64(n_shards)).astype(np.int64)
    return np.where(v < 0, word_shards(v, n_shards), np.where(w < 0, word_shards(w, n_shards), runs))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches, 2 * CHUNK_BYTES):
        words, codes, _ = _split(chunk.column(0))
        counts = np.bincount(codes, minlength=len(words) + 1)
        own = pa.concat_arrays([words, pa.array([END], pa.binary())])
        # An empty string is no word.
        used = pa.array(counts > 0)
        yield pa.RecordBatch.from_arrays([own.filter(used), pa.array(counts).filter(used)], ["word", "n"])
    give_back()


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<u8").ravel()


def _count_pairs(head: dict[bytes, int], n_pair: int | None, n_shards: int):
    """Per shard, a batch's pairs and their counts, packed: those of ranks, then those with a hash."""
    end = head[END]

    def packed(ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Ids of texts one after the other; a text's end stands before its first word as well."""
        w = np.concatenate(ids)
        ids.clear()
        v = np.append(end, w[:-1])
        if n_pair is not None:
            good = _held(v, w, n_pair)
            v, w = v[good], w[good]
        keys = pair_keys(v, w)
        order, begins = distinct(keys)
        at, counts = order[begins], np.diff(begins, append=len(order))
        keys, v, w = keys[at], v[at], w[at]
        del order, begins, at
        shard, rare = pair_shards(keys, v, w, n_shards), (v < 0) | (w < 0)
        order = by_shard(shard, n_shards)
        found, begins = np.unique(shard[order], return_index=True)
        rows = []
        for s, own in zip(found, np.split(order, begins[1:])):
            often, other, blobs = own[~rare[own]], own[rare[own]], []
            other = other[np.argsort(v[other])]
            blobs.append(_planes(np.diff(keys[often], prepend=np.uint64(0))) + counts[often].astype("<u4").tobytes())
            firsts = np.diff(v[other].astype(np.uint64), prepend=np.uint64(0))
            blobs.append(_planes(firsts) + counts[other].astype("<u4").tobytes() + keys[other].tobytes())
            rows.append((int(s), *(zlib.compress(blob, 1) for blob in blobs)))
        if rows:
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "pairs", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, Ids(head)
        for chunk in _chunks(batches, CHUNK_BYTES):
            ids, codes, _ = known.tokens(chunk.column(0))
            held.append(ids[codes])
            size += len(codes)
            if size > 4_000_000:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)
        del known
        give_back()

    return run


def _held(v: np.ndarray, w: np.ndarray, n_pair: int | None) -> np.ndarray:
    """Which pairs the model holds: all, or those of the first ``n_pair`` words."""
    return np.ones(len(v), bool) if n_pair is None else (v >= 0) & (v < n_pair) & (w >= 0) & (w < n_pair)


def _merge(min_count: int):
    """One shard's filter, and what its pairs take from their first words."""

    def summed(keys: list[np.ndarray], counts: list[np.ndarray], firsts: list[np.ndarray] | None):
        key = np.concatenate(keys)
        keys.clear()
        order, begins = distinct(key)
        count = np.concatenate(counts).astype(np.int64)[order]
        counts.clear()
        count = np.add.reduceat(count, begins) if len(begins) else count
        at = order[begins]
        del order, begins
        key = key[at]
        first = key >> np.uint64(32) if firsts is None else np.concatenate(firsts)[at]
        often = count >= min_count
        return key[often], level_of(count[often]), first[often].astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for blob in table["pairs"]:
            raw = zlib.decompress(blob.as_py())
            n = len(raw) // 12
            keys.append(np.cumsum(_unplaned(raw, n, 0), dtype=np.uint64))
            counts.append(np.frombuffer(raw, "<u4", n, 8 * n))
        frequent = summed(keys, counts, None)
        keys, counts, firsts = [], [], []
        for blob in table["others"]:
            raw = zlib.decompress(blob.as_py())
            n = len(raw) // 20
            firsts.append(np.cumsum(_unplaned(raw, n, 0), dtype=np.uint64))
            counts.append(np.frombuffer(raw, "<u4", n, 8 * n))
            keys.append(np.frombuffer(raw, "<u8", n, 12 * n))
        key, levels, first = (np.concatenate(x) for x in zip(frequent, summed(keys, counts, firsts)))
        own, at = np.unique(first, return_inverse=True)
        taken = np.bincount(at, count_of(levels) - DISCOUNT, len(own))
        give_back()
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "filter": pa.array([fill(key, levels).tobytes()], pa.binary()),
                "word": pa.array([own], pa.list_(pa.int64())),
                "taken": pa.array([taken], pa.list_(pa.float64())),
            }
        )

    return run


def _merge_words(certain: int):
    """The filter of one shard's rare words."""

    def run(table: pa.Table) -> pa.Table:
        h, c, left = (table[x].combine_chunks().to_numpy(zero_copy_only=False) for x in ("h", "c", "left"))
        blob = fill_words(h.astype(np.uint64), c, left, certain).tobytes()
        return pa.table({"shard": table["shard"][:1], "filter": pa.array([blob], pa.binary())})

    return run


ROW = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "h long, n long, w long, own double, v_rest double"
)
ROW_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def certain_of(min_count: int) -> int:
    """Twice what the pairs of a word seen once leave of it."""
    return 1 if min_count <= 1 else 2


def _rows(size: int, **columns) -> pa.RecordBatch:
    """Rows of ``ROW``; a column that is not given is null."""
    fields = [c.split() for c in ROW.split(", ")]
    columns = {c: x if isinstance(x, pa.Array) else pa.array(x) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays(
        [columns[c].cast(ROW_KINDS[k]) if c in columns else pa.nulls(size, ROW_KINDS[k]) for c, k in fields],
        [c for c, _ in fields],
    )


def _score(
    head: dict[bytes, int], log_u: np.ndarray, n_pair: int | None, n_shards: int, shared, part: int, group: list[int],
    min_count: int, denominator: float,
):
    """Rows of documents, in the first part of their rare words (with ``h``) and, where there are
    several parts, of known pairs whose second word is read in another one (with ``w``).

    The first part adds all that does not need the filter: log U and the back-off's share.
    """
    least = int(level_of(np.array([min_count]))[0])

    def scored(first: int, chunk: pa.RecordBatch, numbers: Ids, tools: tuple) -> Iterator[pa.RecordBatch]:
        """A chunk of texts, whose rows are numbered from ``first``."""
        pairs, words, counts, rest = tools
        ids, w_code, ends = numbers.tokens(chunk.column(2))
        n, lengths = chunk.num_rows, np.diff(ends, prepend=-1)
        doc = np.repeat(np.arange(n), lengths)
        # A text's end stands before its first word.
        v_code = np.append(w_code[-1], w_code[:-1])
        v, w = ids[v_code], ids[w_code]
        known, after = w >= 0, v >= 0
        base, total = np.zeros(n), np.zeros(n)
        if part == 0:
            base = np.bincount(doc[known], log_u[w[known]], n)
            # Every word is U(w), after a word less what its pairs take.
            total = base + np.bincount(doc[after], np.log10(rest)[v[after]], n)
        held = np.flatnonzero(_held(v, w, n_pair))
        # Each different pair is read once, however often it stands in the chunk.
        different, pair = np.unique(v_code[held] * len(ids) + w_code[held], return_inverse=True)
        at = np.empty(len(different), np.int64)
        at[pair] = held
        a, b = v[at], w[at]
        keys = pair_keys(a, b)
        level = pairs.levels(keys, pair_shards(keys, a, b, n_shards))
        # A pair the filter holds has the level of ``min_count``; less is a filter error.
        read = np.flatnonzero(level >= least)
        a, b, level = a[read], b[read], level[read]
        v_count, v_rest = counts[np.maximum(a, 0)], rest[np.maximum(a, 0)]
        here = b >= 0
        here[~here] = np.isin(word_shards(b[~here], n_shards), group)
        w_u, rare = 10.0 ** log_u[np.maximum(b, 0)], here & (b < 0)
        count, left = words.of(np.concatenate([a[a < 0], b[rare]]))
        firsts = len(count) - rare.sum()
        v_count[a < 0], v_rest[a < 0], w_count = count[:firsts], left[:firsts], count[firsts:]
        w_u[rare] = np.where(w_count > 0, (w_count + 0.5) / (denominator or 1), 0)
        # A filter error can name a word that was never learnt; it has no numbers and adds nothing.
        good = (v_count > 0) & (w_u > 0)
        own = (count_of(level) - DISCOUNT) / np.maximum(v_count, 1)
        at = np.flatnonzero(good & here)
        back, gain = v_rest[at] * w_u[at], np.zeros(len(keys))
        gain[read[at]] = np.log10(np.minimum(1.0, own[at] + back)) - np.log10(back)
        total += np.bincount(doc[held], gain[pair], n)
        row = first + np.arange(n)
        yield _rows(
            n, row=row, doc_id=chunk.column(0), held_out=chunk.column(1), n_tokens=lengths,
            n_known=np.bincount(doc[known], minlength=n), base_score=base, score=total,
        )
        if part == 0 and not known.all():
            at, times = np.unique(doc[~known] * len(ids) + w_code[~known], return_counts=True)
            yield _rows(len(at), row=row[at // len(ids)], h=ids[at % len(ids)], n=times)
        at, away = np.flatnonzero(good & ~here), np.full(len(keys), -1)
        if len(at):
            away[read[at]] = at
            at = away[pair]
            stands = np.flatnonzero(at >= 0)
            at = at[stands]
            yield _rows(len(at), row=row[doc[held[stands]]], w=b[at], own=own[at], v_rest=v_rest[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words, counts, rest = shared.value
        tools = Filter.over(*pairs), RareWords(Filter.over(*words), n_shards, certain_of(min_count)), counts, rest
        row, known = TaskContext.get().partitionId() << 40, Ids(head)
        for chunk in _chunks(batches, CHUNK_BYTES):
            yield from scored(row, chunk, known, tools)
            row += chunk.num_rows
        del known, tools, pairs, words
        give_back()

    return run


def score(
    docs: DataFrame, held_out: Column, head: int = 65_536, pair_head: int | None = None, min_count: int = 2,
    max_filter_mb: int = 256, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: unigram score and model score; the model learns where not ``held_out``.

    ``head`` most frequent words have their counts with the task. All pairs of words are counted,
    and held in the filter if they occurred ``min_count`` times; a caller who wants a smaller model
    can hold it to pairs of the ``pair_head`` most frequent words. A null or empty text is one token, its end. A null
    ``held_out`` counts as false. Repeated rows are learnt and scored as often as they occur; a
    null id stays null, other columns are not read. Without training rows every word is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    train = rows.where("not held_out").select("text")
    counted = written(
        train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words",
    )
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    denominator = total + 0.5 * (distinct + 1)
    # At most ``head`` words of at most 64 bytes. The end is always one of them.
    frequent = (
        counted.where((F.octet_length("word") <= LONGEST_HEAD_WORD) & (F.col("word") != F.lit(END)))
        .orderBy(F.desc("c"), "word").limit(head - 1).collect()
    )
    ends = counted.where(F.col("word") == F.lit(END)).first()
    ids = {END: 0} | {bytes(r.word): i for i, r in enumerate(frequent, 1)}
    head_counts = np.array([ends.c if ends else 0, *(r.c for r in frequent)], float)
    log_u = np.log10((head_counts + 0.5) / denominator) if denominator else np.zeros(len(ids))
    n_pair = None if pair_head is None else min(pair_head, len(ids))
    n_shards = max(16, math.ceil(total / SHARD_TOKENS))

    pairs = train.mapInArrow(_count_pairs(ids, n_pair, n_shards), "shard int, pairs binary, others binary")
    merged = written(
        pairs.groupBy("shard").applyInArrow(
            _merge(min_count), "shard int, filter binary, word array<long>, taken array<double>"
        ),
        "filters",
    )
    taken = (
        merged.select(F.explode(F.arrays_zip("word", "taken")).alias("x"))
        .groupBy(F.col("x.word").alias("v")).agg(F.sum("x.taken").alias("taken"))
    )
    rest = np.ones(len(ids))
    # At most ``head`` rows; what is taken from other words is joined to their counts.
    for r in taken.where("v >= 0").collect():
        rest[r.v] = 1 - r.taken / head_counts[r.v]
    rest = np.maximum(rest, 1e-12)
    travels = F.col("word") == F.lit(END)
    if frequent:
        last = frequent[-1]
        travels |= (F.octet_length("word") <= LONGEST_HEAD_WORD) & (
            (F.col("c") > last.c) | (F.col("c") == last.c) & (F.col("word") <= F.lit(bytes(last.word)))
        )
    # Words of one hash, should there be any, count as one.
    facts = written(
        counted.where(~travels).groupBy(hashed("word").alias("h")).agg(F.sum("c").alias("c"))
        .join(taken.where("v < 0"), F.col("h") == F.col("v"), "left").select(
            "h", "c", F.greatest(F.lit(1e-12), 1 - F.coalesce("taken", F.lit(0.0)) / F.col("c")).alias("rest"),
            # A whole number: pairs take a count less one half.
            F.greatest(F.lit(1), F.round(2 * (F.col("c") - F.coalesce("taken", F.lit(0.0))))).cast("long").alias("left"),
        ),
        "facts",
    )
    rare_filters = written(
        facts.select((F.col("h").bitwiseAND(F.lit(HASH_PART)) % n_shards).cast("int").alias("shard"), "h", "c", "left")
        .groupBy("shard").applyInArrow(_merge_words(certain_of(min_count)), "shard int, filter binary"),
        "word-filters",
    )
    sizes: dict[int, int] = {}
    for shard, size in merged.select("shard", F.octet_length("filter")).union(rare_filters.select("shard", F.octet_length("filter"))).collect():
        sizes[shard] = sizes.get(shard, 0) + size
    groups: list[list[int]] = [[]]
    room = max_filter_mb << 20
    for shard, size in sorted(sizes.items()):
        if size > room and groups[-1]:
            groups.append([])
            room = max_filter_mb << 20
        groups[-1].append(shard)
        room -= size

    def filter_of(shards: DataFrame, group: list[int]) -> tuple:
        held = shards.select("shard", "filter").where(F.col("shard").isin(group)).toLocalIterator() if group else ()
        return Filter({r.shard: bytes(r["filter"]) for r in held}, n_shards).arrays()

    out = None
    for part, group in enumerate(groups):
        tools = filter_of(merged, group), filter_of(rare_filters, group), head_counts, rest
        shared = spark.sparkContext.broadcast(tools)
        run = _score(ids, log_u, n_pair, n_shards, shared, part, group, min_count, denominator)
        scored = written(rows.mapInArrow(run, ROW), "scored")
        out = scored if out is None else out.union(scored)
    if len(groups) > 1:
        kept = out.where("n_tokens is null")
        out = out.where("n_tokens is not null").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            F.max("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
        ).unionByName(kept, allowMissingColumns=True)
    c = F.coalesce("c", F.lit(0))
    log_u_of = F.log10((c + 0.5) / F.lit(float(denominator)))
    words = out.where("h is not null").select("row", "h", "n").join(facts, "h", "left").select(
        "row", F.when(c > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * log_u_of).alias("base"),
        (F.col("n") * (log_u_of + F.log10(F.coalesce("rest", F.lit(1.0))))).alias("full"),
    )
    if len(groups) > 1:
        back = F.col("v_rest") * F.pow(F.lit(10.0), "w_u")
        words = words.unionByName(
            out.where("w is not null").select("row", "w", "own", "v_rest")
            .join(facts.select(F.col("h").alias("w"), log_u_of.alias("w_u")), "w")
            .select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.log10(F.least(F.lit(1.0), F.col("own") + back)) - F.log10(back)).alias("full"))
        )
    rare = words.groupBy("row").agg(
        F.sum("known").alias("rare_known"), F.sum("base").alias("rare_base"), F.sum("full").alias("rare_score")
    )
    nothing = F.lit(0.0)
    return (
        out.where("n_tokens is not null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
        .join(rare, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.when(F.lit(total > 0), F.col("n_known")).otherwise(0) + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("rare_base", nothing)).alias("base_score"),
            (F.col("score") + F.coalesce("rare_score", nothing)).alias("score"),
        )
    )
