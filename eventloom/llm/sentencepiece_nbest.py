"""SentencePiece encoding with the N best segmentations, and decoding.

The pieces of a model span a lattice over a text's characters. Forward Viterbi gives every
position the score of the best segmentation before it; that score is the exact heuristic of an
A* search which walks the lattice backward and pops whole segmentations in order of score.

No piece crosses the start of a word, so the lattice falls apart into words, and a corpus repeats
words. Viterbi runs once over all distinct words of a chunk, vectorised over words. A backward
pass gives each word the gap to its second-best segmentation. The N best segmentations of a text
differ from the best one only in the N - 1 words of least gap (each such word alone gives a
better alternative than any other word), so A* searches those words' lattices, joined.

Rows are independent: no shuffle; memory is one chunk of texts.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_worker

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# A literal mark in a text is not a space. It stands as a lone surrogate, which no text holds and
# which is no piece, and so goes by its own bytes.
NO_PIECE = "\ud800"
NORMAL, BYTE, UNIGRAM = 1, 6, 1
UNKNOWN_PENALTY = 10.0
PRIME = np.uint64(0x9E3779B97F4A7C15)
LEAD_SHIFT = np.uint64(46)
CHUNK_CHARS = 4_000_000


def load_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, their log scores and kinds.

    A unigram model has log probabilities. The scores of a BPE model are merge ranks; the Zipf
    estimate -ln(rank) stands in for the probability there.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or not model.trainer_spec.byte_fallback:
        raise ValueError("a model with identity normalisation and byte fallback is needed")
    pieces, kinds = [p.piece for p in model.pieces], [p.type for p in model.pieces]
    first = kinds.index(NORMAL)
    if model.trainer_spec.model_type == UNIGRAM:
        return pieces, [p.score for p in model.pieces], kinds
    return pieces, [-math.log(max(i - first, 0) + 2) for i in range(len(pieces))], kinds


def _hash_step(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    h = (h ^ chars.astype(np.uint64)) * PRIME
    return h ^ (h >> np.uint64(29))


class Words:
    """Lattices of distinct words side by side, the longest word first.

    Nodes are the places between characters, numbered by depth (characters before them) and then
    by word. Edges are grouped by the node they end at, the longest first; as an edge is known by
    its two nodes, each length has at most one per node, and no sort is needed to group them.
    """

    def __init__(self, model: Model, words: list[str]):
        self.model = model
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        depths = np.arange(int(lengths[0]) + 1)
        self.width = np.searchsorted(-lengths, -depths, side="right")
        self.level = np.concatenate([[0], np.cumsum(self.width)])
        n = int(self.level[-1])
        sizes = lengths + 1
        place = np.arange(n)  # word by word, as the characters come
        depth = place - np.repeat(np.cumsum(sizes) - sizes, sizes)
        node = self.level[depth] + np.repeat(np.arange(len(words)), sizes)
        self.last = self.level[lengths] + np.arange(len(words))
        room = np.repeat(lengths, sizes) - depth
        alive = place[room > 0]
        chars = np.zeros(n, np.uint32)
        chars[alive] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.char = np.zeros(n, np.uint32)
        self.char[node] = chars
        edges = []
        into = np.zeros(n + 1, np.int64)
        for length, whole, ids, alive in model.matches(chars, alive, room):
            begin, end = node[whole], node[whole + length]
            into[end + 1] += 1
            edges.append((begin, end, ids))
        self.bounds = np.cumsum(into)
        free = self.bounds[:-1].copy()
        self.start, self.end, self.id = (np.empty(int(self.bounds[-1]), np.int64) for _ in range(3))
        for begin, end, ids in reversed(edges):
            at = free[end]
            self.start[at], self.end[at], self.id[at] = begin, end, ids
            free[end] = at + 1
        self.score = model.scores[self.id]
        self.n = n
        self._forward()

    def _levels(self) -> list[tuple[int, int, int, int]]:
        """Per depth from 1 on: its first node and the next depth's, its first edge and the next's."""
        nodes = self.level[1:].tolist()
        edges = self.bounds[nodes].tolist()
        return list(zip(nodes, nodes[1:], edges, edges[1:]))

    def _forward(self) -> None:
        self.alpha, self.best = np.zeros(self.n), np.full(self.n, -1, np.int64)
        for lo, hi, a, b in self._levels():
            total = self.alpha[self.start[a:b]] + self.score[a:b]
            top = np.maximum.reduceat(total, self.bounds[lo:hi] - a)
            self.alpha[lo:hi] = top
            # On a tie the longest last piece: of a node's edges the first is assigned last.
            at = a + np.flatnonzero(total == self.alpha[self.end[a:b]])[::-1]
            self.best[self.end[at]] = at
        self.on_best = np.zeros(len(self.id), bool)
        word, at = np.arange(len(self.last)), self.last
        n_edges = np.zeros(len(self.last), np.int64)
        steps = []
        while len(at):
            edge = self.best[at]
            n_edges[word] += 1
            steps.append((word, edge))
            at = self.start[edge]
            on = at >= len(self.last)
            word, at = word[on], at[on]
        stop = np.cumsum(n_edges)
        path = np.empty(int(n_edges.sum()), np.int64)
        for k, (word, edge) in enumerate(steps, 1):
            path[stop[word] - k] = edge
        self.on_best[path] = True
        self.path, sizes = self.ids_of(path)
        self.path_size = np.add.reduceat(sizes, stop - n_edges)
        self.path_first = np.cumsum(self.path_size) - self.path_size

    def ids_of(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a path's edges, an unknown character as its bytes; and how many each edge gives."""
        ids = self.id[edges].astype(np.int32)
        sizes = np.ones(len(ids), np.int64)
        unknown = ids == self.model.unknown
        if not unknown.any():
            return ids, sizes
        chars = self.char[self.start[edges[unknown]]]
        chars[chars == ord(NO_PIECE)] = ord(SPACE)
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        sizes[unknown] += (chars >= 1 << 7).astype(np.int64) + (chars >= 1 << 11) + (chars >= 1 << 16)
        ids = np.repeat(ids, sizes)
        ids[ids == self.model.unknown] = self.model.byte_ids[raw]
        return ids, sizes

    @cached_property
    def gap(self) -> np.ndarray:
        """Per word, how much its second-best segmentation scores below the best (inf: none)."""
        beta = np.full(self.n, -np.inf)
        beta[self.last] = 0.0
        for _, _, a, b in reversed(self._levels()):  # at most one edge of a level leaves a node
            start = self.start[a:b]
            beta[start] = np.maximum(beta[start], self.score[a:b] + beta[self.end[a:b]])
        through = self.alpha[self.start] + self.score + beta[self.end]
        through[self.on_best] = -np.inf
        second = np.full(len(self.last), -np.inf)
        for (lo, hi, a, b), width in zip(self._levels(), self.width[1:]):
            top = np.maximum.reduceat(through[a:b], self.bounds[lo:hi] - a)
            second[:width] = np.maximum(second[:width], top)
        return np.maximum(self.alpha[self.last] - second, 0.0)

    def n_best(self, words: list[int], n: int) -> list[tuple[float, list[list[int]]]]:
        """The ``n`` best segmentations of these words in a row: score, edges per word.

        A* from the end backward. A state is (word, node); its estimate is the score so far plus
        the Viterbi score of all that is left, which is exact, so states come in order.
        """
        ahead = np.concatenate([[0.0], np.cumsum([self.alpha[self.last[w]] for w in words])])
        into: dict[int, list[tuple[int, int, float]]] = {}
        found, count = [], 0
        # (negative estimate, order of entry, words left, node, score so far, path)
        heap = [(-ahead[-1], 0, len(words), -1, 0.0, None)]
        while heap and len(found) < n:
            _, _, left, node, so_far, path = heapq.heappop(heap)
            if node < len(self.last):  # the start of a word, or the end of all
                if left == 0:
                    out: list[list[int]] = [[] for _ in words]
                    while path is not None:
                        k, edge, path = path
                        out[k].append(edge)
                    found.append((so_far, out))
                    continue
                left -= 1
                node = int(self.last[words[left]])
            if node not in into:
                a, b = int(self.bounds[node]), int(self.bounds[node + 1])
                into[node] = list(zip(range(a, b), self.start[a:b].tolist(), self.score[a:b].tolist()))
            for edge, start, score in into[node]:
                count += 1
                total = so_far + score
                estimate = total + self.alpha[start] + ahead[left]
                heapq.heappush(heap, (-estimate, count, left, start, total, (left, edge, path)))
        return found


class Model:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.pieces, self.unknown = pieces, len(pieces)
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        # An unknown character costs more than any piece.
        self.scores = np.array([*scores, min(scores[i] for i in normal.values()) - UNKNOWN_PENALTY])
        self.longest = max(map(len, normal))
        self.raw = [p.replace(SPACE, " ").encode("utf-8") for p in pieces]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        # Hashes of all prefixes by length, with the piece's id where the prefix is a piece.
        whole: list[dict[int, int]] = [{} for _ in range(self.longest)]
        by_length: dict[int, list[str]] = {}
        for p in normal:
            by_length.setdefault(len(p), []).append(p)
        for length, group in by_length.items():
            chars = np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(-1, length)
            h = np.full(len(group), 7, np.uint64)
            for k in range(length):
                h = _hash_step(h, chars[:, k])
                for x in h.tolist():
                    whole[k].setdefault(x, -1)
            whole[length - 1].update(zip(h.tolist(), (normal[p] for p in group)))
        # First characters by code point; longer prefixes in order of hash, with a table of where
        # each value of a hash's leading bits begins.
        self.first_id = np.full(sys.maxunicode + 1, self.unknown, np.int32)
        self.begins = np.zeros(sys.maxunicode + 1, bool)
        for p, i in normal.items():
            self.begins[ord(p[0])] |= len(p) > 1
            if len(p) == 1:
                self.first_id[ord(p)] = i
        self.prefixes = []
        for table in whole[1:]:
            keys = np.array(sorted(table), np.uint64)
            bits, counts = np.unique(keys >> LEAD_SHIFT, return_counts=True)
            begin = np.full(1 << (64 - int(LEAD_SHIFT)), -1, np.int32)
            begin[bits] = np.cumsum(counts) - counts
            ids = np.array([*(table[int(k)] for k in keys), -1], np.int32)
            self.prefixes.append((np.append(keys, ~np.uint64(0)), ids, begin, int(counts.max()) - 1))

    def matches(self, chars: np.ndarray, alive: np.ndarray, room: np.ndarray):
        """Per length: it, the places of ``alive`` where a piece of it starts, the pieces, and
        the places where a longer one may. A character that is no piece goes by its bytes."""
        here = chars[alive]
        yield 1, alive, self.first_id[here], alive
        goes_on = self.begins[here] & (room[alive] > 1)
        alive = alive[goes_on]
        h = _hash_step(np.full(len(alive), 7, np.uint64), here[goes_on])
        for length, (keys, ids, begin, steps) in enumerate(self.prefixes, 2):
            if not len(alive):
                break
            h = _hash_step(h, chars[alive + (length - 1)])
            at = begin[h >> LEAD_SHIFT]
            some = np.flatnonzero(at >= 0)  # most strings that begin no piece go here
            alive, h, at = alive[some], h[some], at[some]
            for _ in range(steps):
                at += keys[at] < h
            hit = np.flatnonzero(keys[at] == h)
            alive, h, found = alive[hit], h[hit], ids[at[hit]]
            whole = found >= 0
            yield length, alive[whole], found[whole], alive
            goes_on = room[alive] > length
            alive, h = alive[goes_on], h[goes_on]

    def encode(self, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """Per text its ``n`` best segmentations (score, ids), best first; an empty text has one, empty."""
        split = [WORD.findall(_marked(t)) for t in texts]
        index = dict.fromkeys(sorted(set(chain.from_iterable(split)), key=len, reverse=True))
        if not index:
            yield from ([(0.0, np.zeros(0, np.int32))] for _ in texts)
            return
        words = Words(self, list(index))
        index.update(zip(index, range(len(index))))
        places = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64)
        best_score = words.alpha[words.last][places]
        gap = words.gap[places] if n > 1 else None
        sizes = words.path_size[places]
        stops = np.cumsum(sizes)
        all_ids = words.path[np.repeat(words.path_first[places] - stops + sizes, sizes) + np.arange(int(stops[-1]))]
        bounds = np.concatenate([[0], stops])
        done = 0
        for text_words in split:
            a, b = done, done + len(text_words)
            done = b
            ids = all_ids[bounds[a] : bounds[b]]
            total = float(best_score[a:b].sum())
            out = [(total, ids)]
            if n > 1 and a < b:
                chosen = a + np.sort(np.argsort(gap[a:b], kind="stable")[: n - 1])
                chosen = chosen[np.isfinite(gap[chosen])]
                if len(chosen):
                    rest = total - float(best_score[chosen].sum())
                    for score, paths in words.n_best(places[chosen].tolist(), n)[1:]:
                        pieces, at = [], bounds[a]
                        for c, path in zip(chosen.tolist(), paths):
                            pieces += [all_ids[at : bounds[c]], words.ids_of(np.array(path))[0]]
                            at = bounds[c + 1]
                        out.append((rest + score, np.concatenate([*pieces, all_ids[at : bounds[b]]])))
            yield out

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _marked(text: str) -> str:
    """Spaces as marks, after a first one."""
    return SPACE + text.replace(SPACE, NO_PIECE).replace(" ", SPACE) if text else ""


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc_id)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _worker_model(spec: tuple) -> Model:
    return per_worker(f"pieces:{hash(tuple(map(tuple, spec)))}", lambda: Model(*spec))


ENCODED = "doc_id long, score double, ids array<int>, others array<struct<score:double,ids:array<int>>>"


def encode(docs: DataFrame, model_path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best segmentation and the next ``n`` - 1 of every text, in order of score.

    A null or empty text has no ids, score 0 and no others; a text with fewer than ``n``
    segmentations has as many others as there are. Repeated rows repeat, a null id stays null,
    other columns are not read.
    """
    spec = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker_model(spec)
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))]
        for batch in batches:
            for doc_ids, texts in _chunks(batch):
                found = list(model.encode(texts, n))
                columns = [
                    doc_ids, [f[0][0] for f in found], [f[0][1].tolist() for f in found],
                    [[{"score": s, "ids": i.tolist()} for s, i in f[1:]] for f in found],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "score", "ids", "others"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENCODED)


DIGEST = "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"


def digest(docs: DataFrame, model_path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``encode``, with checksums of the ids, and whether decoding gives the text back."""
    spec = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker_model(spec)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
        for batch in batches:
            for doc_ids, texts in _chunks(batch):
                rows = []
                for doc_id, text, found in zip(doc_ids, texts, model.encode(texts, n)):
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found]
                    whole = model.decode(found[0][1].tolist()) == text
                    rows.append((doc_id, len(found[0][1]), crcs[0], found[0][0], [s for s, _ in found], crcs, whole))
                names = [c.split()[0] for c in DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, DIGEST)


def decode(ids: Column, model_path: str) -> Column:
    """The texts of a column of id arrays; null stays null."""
    spec = load_model(model_path)

    @F.pandas_udf("string")
    def texts(column):
        model = _worker_model(spec)
        return column.map(lambda x: None if x is None else model.decode(x))

    return texts(ids)
