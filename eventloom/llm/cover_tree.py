"""All pairs of vectors within a cosine threshold: cover trees and their dual traversal.

On unit vectors, cosine >= c is Euclidean distance <= t = sqrt(2 - 2c), so the triangle
inequality prunes. The top of the tree is a bounded set of centres; vectors with the same two
nearest ones lie together, in blocks of bounded size, and a page holds a few blocks. Every block
builds its own nested levels with halving radii, once. Two pages, and then two of their blocks,
meet only where their ranges of distance to every centre come within t of each other, and then
the blocks' trees are walked together: a pair of nodes is dropped when the distance of its centres
exceeds both covering radii plus t. What survives is checked by the exact cosine.

A vector is moved once, to its page. Pages are stored, and tasks that pair them read them from
there, so disk grows with the vectors and not with the meetings, however little is pruned.

Equal vectors are collapsed on the way. Meetings yield each vector's number of links and a spanning
forest, not the pairs. Vectors that fit no ball better than another (random directions) prune
little; then every block meets every other, by products of matrices over a few directions first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, written
from .components import components

#: Radii of the nested levels below a block's root; unit vectors lie within 2 of each other.
LEVELS = (1.0, 0.5, 0.25)
#: A node of fewer vectors is opened: each of them is a node of its own.
LEAST = 16
#: Directions of the first bound on a cosine; with the length of the rest, one column more.
DIRECTIONS = 15
#: Bytes of a page's vectors and of a stored file of pages; pages there are at least, where blocks
#: suffice; rows collapsed at once on the way to a page.
PAGE_BYTES, FILE_BYTES, LEAST_PAGES, BUFFER_ROWS = 2 << 20, 16 << 20, 32, 1 << 15
SLACK = 1e-9
#: Rows of both sides of a product of matrices.
TILE, WIDE = 128, 256
#: By how much bounds out of 32-bit numbers are loosened.
ROUGH = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first, so that nothing overflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def build(x: np.ndarray) -> np.ndarray:
    """Cover tree of a block: for each vector its centre's index at every level (one row each).

    Every vector is within a level's radius of its centre, within its parent, and a centre is its
    own centre on all deeper levels. Vectors that no ball of ``LEAST`` or more takes are nodes of
    their own, on that level and all deeper ones.
    """
    path = np.repeat(np.arange(len(x), dtype=np.int32)[:, None], len(LEVELS), axis=1)
    gap = distances(x, x)
    groups = [np.arange(len(x))]
    for k, radius in enumerate(LEVELS):
        below = []
        for group in groups:
            inside = (gap[np.ix_(group, group)] if k else gap) <= radius
            np.fill_diagonal(inside, True)
            free, enough = np.ones(len(group), bool), inside.sum(axis=1) >= LEAST
            free[0] = enough[0] or not k
            for at in np.flatnonzero(enough):
                near = inside[at] & free
                if free[at] and near.sum() >= LEAST:
                    free[near] = False
                    path[group[near], k] = group[at]
                    # The centre comes first, and on the next level it is one again, or alone.
                    below.append(np.concatenate([group[[at]], group[near & (np.arange(len(group)) != at)]]))
        groups = below
    return path


class Tree:
    """A block's nodes level by level: centre, covering radius, range of its vectors.

    ``x`` and ``path`` are in the tree's order, where a node's vectors stand together.
    """

    def __init__(self, x: np.ndarray, path: np.ndarray, directions: np.ndarray):
        self.x, self.short = x, x.astype(np.float32)
        # More than a product of two of these may be off.
        self.band = 1e-7 * (x.shape[1] + 16)
        # On each level, where in this order the nodes begin.
        changed = np.zeros(len(x), bool)
        self.begin, self.cover, self.centre = [], [], []
        for k in range(path.shape[1]):
            changed[1:] |= path[1:, k] != path[:-1, k]
            begin = np.concatenate([[0], np.flatnonzero(changed[1:]) + 1])
            size = np.diff(begin, append=len(x))
            cover = np.zeros(len(begin))
            for node in np.flatnonzero(size > 1):
                own = self.x[begin[node] : begin[node] + size[node]]
                gap = 2 - 2 * (own @ self.x[path[begin[node], k]])
                cover[node] = math.sqrt(max(0.0, gap.max())) + SLACK
            self.begin.append(np.append(begin, len(x)))
            self.cover.append(cover)
            self.centre.append(path[begin, k])
        size = np.diff(self.begin[0])
        self.points, self.balls = self.begin[0][:-1][size == 1], np.flatnonzero(size > 1)
        # A cosine is at most the product over the directions plus that of what is left of both.
        low = self.x[self.points] @ directions
        turn = np.argsort(low[:, 0], kind="stable")
        self.points, low = self.points[turn], low[turn]
        rest = np.sqrt(np.maximum(0, 1 - (low * low).sum(axis=1)) + ROUGH / 10)
        self.low = np.zeros((-(-len(low) // WIDE) * WIDE, low.shape[1] + 1), np.float32)
        self.low[: len(low)] = np.column_stack([low, rest])
        # Memory that is new for every product would cost more than the product.
        self.room = [np.empty((len(self.low) // WIDE, TILE, WIDE), kind) for kind in (np.float32, bool)]

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of ``level`` the range of its nodes on the next one."""
        first = np.searchsorted(self.begin[level + 1], self.begin[level])
        return first[:-1], first[1:]


def _product(a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """All pairs out of each pair of ranges."""
    na, nb = a_hi - a_lo, b_hi - b_lo
    which = np.repeat(np.arange(len(na)), na * nb)
    k = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    return a_lo[which] + k // nb[which], b_lo[which] + k % nb[which]


def _parts(size: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of ``size``, cut where the sum has grown by ``most``."""
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1)


def _within(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, cosine: float, dots: np.ndarray | None = None) -> np.ndarray:
    """Which pairs have the cosine: by 32-bit numbers where their error leaves no doubt, else exactly."""
    hit = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        d = np.einsum("ij,ij->i", a.short[i[s]], b.short[j[s]]) if dots is None else dots[s]
        hit[s] = d >= cosine + a.band
        doubt = at + np.flatnonzero((d >= cosine - a.band) & ~hit[s])
        hit[doubt] = np.einsum("ij,ij->i", a.x[i[doubt]], b.x[j[doubt]]) >= cosine
    return hit


def _over(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and y whose product is ``least`` or more, and the product."""
    g = (x @ y.T).ravel()
    found = np.flatnonzero(g >= least)
    return *np.divmod(found, max(1, len(y))), g[found]


def _points(a: Tree, b: Tree, t: float, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs among the vectors that are nodes of their own, which stand in order of the first direction."""
    x, y, kept = a.short[a.points], b.short[b.points], []
    pieces, (bound, over) = b.low.reshape(-1, WIDE, b.low.shape[1]).transpose(0, 2, 1), b.room
    for at in range(0, len(x), TILE):
        end = min(at + TILE, len(x))
        lo, hi = np.searchsorted(b.low[: len(y), 0], [a.low[at, 0] - t - ROUGH, a.low[end - 1, 0] + t + ROUGH])
        lo, hi = max(lo, at if same else 0) // WIDE, -(-hi // WIDE)
        if lo >= hi:
            continue
        np.matmul(a.low[at:end], pieces[lo:hi], out=bound[: hi - lo, : end - at])
        some = np.greater_equal(bound[: hi - lo, : end - at], cosine - ROUGH, out=over[: hi - lo, : end - at])
        # Few are: eight at a time.
        words = np.flatnonzero(some.ravel().view(np.uint64))
        which, bit = np.nonzero(some.reshape(-1, 8)[words])
        dense = len(which) * 32 > some.size
        if dense:  # the bound says little: all of the tile
            i, j, dots = _over(x[at:end], y[lo * WIDE : hi * WIDE], cosine - a.band)
        else:
            piece, i, j = np.unravel_index(words[which] * 8 + bit, some.shape)
            j += piece * WIDE
        i, j = at + i, lo * WIDE + j
        real = (j > i) & (j < len(y)) if same else j < len(y)
        i, j = a.points[i[real]], b.points[j[real]]
        if dense:
            hit = _within(a, b, i, j, cosine, dots[real])
            yield i[hit], j[hit]
        else:
            kept.append((i, j))
    if kept:
        i, j = (np.concatenate(c) for c in zip(*kept, strict=True))
        hit = _within(a, b, i, j, cosine)
        yield i[hit], j[hit]


def _balls(a: Tree, b: Tree, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaf nodes within reach of each other, at least one of them below a ball."""
    if not len(a.balls) + len(b.balls):
        return (np.zeros(0, int),) * 2

    def near(k: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reach = np.minimum(2.0, a.cover[k][p] + b.cover[k][q] + t + SLACK)
        return a.short[a.centre[k][p]], b.short[b.centre[k][q]], 1 - reach * reach / 2 - a.band - ROUGH

    found = []
    for left, right in ((a.balls, np.arange(len(b.cover[0]))), (np.setdiff1d(np.arange(len(a.cover[0])), a.balls), b.balls)):
        for at in range(0, len(left) if len(right) else 0, 256):
            x, y, least = near(0, left[at : at + 256, None], right[None])
            p, q = np.nonzero(x[:, 0] @ y[0].T >= least)
            found.append((left[at + p], right[q]))
        if same:
            break
    p, q = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    if same:
        # Of two balls both orders were asked.
        p, q = np.minimum(p, q), np.maximum(p, q)
        p, q = np.divmod(np.unique(p * len(a.cover[0]) + q), len(a.cover[0]))
    for k in range(1, len(LEVELS)):
        (a_lo, a_hi), (b_lo, b_hi) = a.children(k - 1), b.children(k - 1)
        kept = []
        for part in _parts((a_hi - a_lo)[p] * (b_hi - b_lo)[q], 1 << 15):
            i, j = _product(a_lo[p[part]], a_hi[p[part]], b_lo[q[part]], b_hi[q[part]])
            if same:
                i, j = i[i <= j], j[i <= j]
            for at in range(0, len(i), 1 << 15):
                s = slice(at, at + (1 << 15))
                x, y, least = near(k, i[s], j[s])
                ok = np.einsum("ij,ij->i", x, y) >= least
                kept.append((i[s][ok], j[s][ok]))
        p, q = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, int),) * 2
    return p, q


def meet(a: Tree, b: Tree, t: float, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in a, index in b) with at least ``cosine``, in parts; each once if same."""
    yield from _points(a, b, t, cosine, same)
    p, q = _balls(a, b, t, same)
    at, to = a.begin[-1], b.begin[-1]
    size = np.diff(at)[p] * np.diff(to)[q]
    large = size >= 1024
    # Leaf against leaf: large ones by a product of matrices, whole rows of small ones at a time.
    for m, n in zip(p[large], q[large], strict=True):
        for k in range(at[m], at[m + 1], TILE):
            i, j, dots = _over(a.short[k : min(k + TILE, at[m + 1])], b.short[to[n] : to[n + 1]], cosine - a.band)
            i, j = k + i, to[n] + j
            if same:
                i, j, dots = i[i < j], j[i < j], dots[i < j]
            hit = _within(a, b, i, j, cosine, dots)
            yield i[hit], j[hit]
    p, q = p[~large], q[~large]
    for part in _parts(size[~large], 1 << 17):
        i, j = _product(at[p[part]], at[p[part] + 1], to[q[part]], to[q[part] + 1])
        if same:
            i, j = i[i < j], j[i < j]
        hit = _within(a, b, i, j, cosine)
        yield i[hit], j[hit]


def _labels(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least index reachable over the pairs and those before, whose labels are given."""
    label = label.copy()
    while len(p):
        one, two = label[p], label[q]
        open_ = one != two
        p, q, one, two = p[open_], q[open_], one[open_], two[open_]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    return label


def _centres(rows: DataFrame, count: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` centres, farthest first, out of a bounded sample taken by hash; the directions in
    which the sample varies most."""
    some = rows.orderBy(F.xxhash64("k1", "vec_id"), "k1", "vec_id").limit(sample).select("v").collect()
    x = unit(np.array([r.v for r in some], float))
    picked, gap = [0], distances(x[:1], x)[0]
    while len(picked) < min(count, len(x)) and gap.max() > SLACK:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x[picked[-1:]], x)[0])
    off = x - x.mean(axis=0)
    return x[picked], np.linalg.eigh(off.T @ off)[1][:, ::-1][:, :DIRECTIONS]


def _vectors(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    values = batch.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _slots(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centre is nearest, and which one next."""
    gap = distances(unit(x.astype(float)), centres)
    cell, at = gap.argmin(axis=1), np.arange(len(x))
    gap[at, cell] = np.inf
    return cell * len(centres) + (gap.argmin(axis=1) if len(centres) > 1 else 0)


def _collapse(table: pa.Table) -> pa.Table:
    """One row for each different vector: how often it comes, the least id."""
    at = table.append_column("at", pa.array(np.arange(len(table))))
    found = at.group_by(["k1", "k2"], use_threads=False).aggregate([("copies", "sum"), ("first", "min"), ("at", "min")])
    one = table.take(found["at_min"])
    for name, of in (("copies", "copies_sum"), ("first", "first_min")):
        one = one.set_column(one.schema.get_field_index(name), name, found[of])
    return one


def _buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, collapsed some at a time: a vector that comes often is sent seldom."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BUFFER_ROWS or size >= FILE_BYTES:
            yield _collapse(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0
    if rows:
        yield _collapse(pa.Table.from_batches(held))


def _slotted(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot = _slots(_vectors(batch, "v"), centres)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), batch.column("k1")], ["slot", "k1"])

    return run


def _deal(counts: np.ndarray, page_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each slot its first page and its number of pages; the number of all pages."""
    first, many = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    page, held = 0, 0
    for slot, n in enumerate(counts.tolist()):
        if held and held + n > page_rows:
            page, held = page + 1, 0
        first[slot], many[slot] = page, max(1, math.ceil(n / page_rows))
        if n > page_rows:
            page, n = page + many[slot], 0
        held += n
    return first, many, int(page) + 1


PLACED = "page long, slot long, k1 long, k2 long, copies long, first long, v {kind}"


def _place(centres: np.ndarray, first: np.ndarray, many: np.ndarray):
    """Each vector with its page; equal ones get the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffered(batches):
            slot = _slots(_vectors(table, "v"), centres)
            page = first[slot] + table["k2"].to_numpy() % many[slot]
            table = table.add_column(0, "slot", pa.array(slot)).add_column(0, "page", pa.array(page))
            yield from table.combine_chunks().to_batches(max_chunksize=1 << 13)

    return run


PAGE = (
    "page long, v binary, path binary, sizes array<int>, lo array<double>, hi array<double>, near array<double>, "
    "k1 array<long>, k2 array<long>, copies array<long>, first array<long>"
)


def _grow(centres: np.ndarray, block_rows: int):
    """One page: its vectors block by block, in the order of the block's cover tree, with their path
    through it; the ranges of distance to every centre."""

    def run(table: pa.Table) -> pa.Table:
        table = _collapse(table.combine_chunks()).sort_by([("slot", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
        x = unit(_vectors(table, "v").astype(float))
        away = distances(x, centres)
        order, paths, sizes, near = [], [], [], []
        cuts = np.arange(0, len(x), math.ceil(len(x) / math.ceil(len(x) / block_rows)))
        for at, own, far in zip(cuts, np.split(x, cuts[1:]), np.split(away, cuts[1:]), strict=True):
            path = build(own)
            turn = np.lexsort(path.T[::-1])
            place = np.empty(len(own), np.int32)
            place[turn] = np.arange(len(own))
            order.append(at + turn)
            paths.append(place[path[turn]])
            sizes.append(len(own))
            near.append([far.min(axis=0), far.max(axis=0)])
        near = np.array(near)
        table = table.take(np.concatenate(order)).combine_chunks()
        page = {
            "page": table["page"][0].as_py(), "v": _vectors(table, "v").tobytes(), "path": np.concatenate(paths).tobytes(),
            "sizes": sizes, "lo": near[:, 0].min(axis=0), "hi": near[:, 1].max(axis=0), "near": near.ravel(),
        }
        kinds = {"page": pa.int64(), "v": pa.binary(), "path": pa.binary(), "sizes": pa.list_(pa.int32())}
        made = {k: pa.array([v], kinds.get(k, pa.list_(pa.float64()))) for k, v in page.items()}
        for name in ("k1", "k2", "copies", "first"):
            made[name] = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[name].combine_chunks())
        return pa.table(made)

    return run


class _Page:
    """A stored page, ready to meet others."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str, kind: str, directions: np.ndarray, cells: int):
        def numbers(name: str) -> np.ndarray:
            return batch.column(f"{side}_{name}")[at].values.to_numpy()

        def packed(name: str, dtype: str) -> np.ndarray:
            return np.frombuffer(batch.column(f"{side}_{name}")[at].as_buffer(), dtype)

        self.copies, sizes = numbers("copies"), numbers("sizes")
        x = unit(packed("v", kind).reshape(len(self.copies), -1).astype(float))
        path = packed("path", "i4").reshape(len(x), -1)
        self.node = (batch.column(f"{side}_page")[at].as_py() << 32) + np.arange(len(x))
        self.begin = np.cumsum(sizes) - sizes
        self.near = numbers("near").reshape(len(sizes), 2, cells)
        self.trees = [Tree(x[b : b + n], path[b : b + n], directions) for b, n in zip(self.begin, sizes, strict=True)]


def _near(one: _Page, two: _Page, cosine: float, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in two pages; in one page, each pair once."""
    for m, (a, (a_lo, a_hi)) in enumerate(zip(one.trees, one.near, strict=True)):
        for n, (b, (b_lo, b_hi)) in enumerate(zip(two.trees, two.near, strict=True)):
            if one is two and n < m or max((a_lo - b_hi).max(), (b_lo - a_hi).max()) > t + ROUGH:
                continue
            for p, q in meet(a, b, t, cosine, one is two and m == n):
                yield one.begin[m] + p, two.begin[n] + q


def _met(one: _Page, two: _Page, cosine: float, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What two pages link: each linked node, the least one it is connected with, its links."""
    both = (one,) if one is two else (one, two)
    node, copies = (np.concatenate([getattr(x, name) for x in both]) for name in ("node", "copies"))
    label, total, held, size = np.arange(len(node)), np.zeros(len(node)), [], 0

    def add() -> None:
        nonlocal label, total
        p, q = (np.concatenate(c) for c in zip(*held, strict=True))
        q = q + len(node) - len(two.node)
        total += np.bincount(p, copies[q], len(node)) + np.bincount(q, copies[p], len(node))
        label = _labels(label, p, q)

    for pair in _near(one, two, cosine, t):
        held.append(pair)
        size += len(pair[0])
        if size > 1 << 18:
            add()
            held, size = [], 0
    if size:
        add()
    some = np.flatnonzero(total)
    return node[some], node[label[some]], total[some].astype(np.int64)


def _fold(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node once: the least one it is connected with, and its links."""
    node, peer, links = (np.concatenate(c) for c in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate([node, peer]), return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, at[: len(node)], links)
    return names, names[_labels(np.arange(len(names)), at[: len(node)], at[len(node) :])], total


def _meet(cosine: float, t: float, kind: str, directions: np.ndarray, cells: int):
    """Pairs of pages to what a task has found in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, most, left, at = [], 0, 1 << 19, None, None
        for batch in batches:
            for i, (first, second) in enumerate(zip(batch.column("one_page").to_pylist(), batch.column("two_page").to_pylist(), strict=True)):
                if first != at:
                    left, at = _Page(batch, i, "one", kind, directions, cells), first
                right = left if second == first else _Page(batch, i, "two", kind, directions, cells)
                found.append(_met(left, right, cosine, t))
                held += len(found[-1][0])
                if held > most:
                    found = [_fold(found)]
                    held = len(found[0][0])
                    most = max(1 << 19, 2 * held)
        give_back()
        if held:
            node, peer, links = _fold(found)
            for k in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in (node, peer, links)], ["node", "peer", "links"])

    return run


def links(
    vectors: DataFrame, cosine: float = 0.95, block_rows: int = 2048, max_cells: int = 64, sample: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing
    and are their own component. Vectors of different length link with nothing of another length.
    Equal vectors link with each other. A null id stays null: it counts as a link of others, its
    component takes the least id that is not null, and it is kept only where no id is there at
    all. Repeated rows are vectors of their own. Other columns are not read.

    ``sample`` bounds the vectors from which centres are taken; every vector is compared. Equal
    vectors are told by 128-bit hashes. ``page_bytes`` bounds the blocks that are stored together.
    """
    small_batches(vectors.sparkSession)
    kind = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    fine = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    # Adding zero makes the two zeros one.
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0).cast(kind))))
    keyed = rows.where("v is not null").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    t = math.sqrt(2 - 2 * cosine)
    pages, met, begin = None, None, 0
    for r in sorted(keyed.groupBy(F.size("v").alias("n")).agg(F.approx_count_distinct("k1").alias("vectors")).collect()):
        own, there, begin = _pages(keyed.where(F.size("v") == r["n"]), r["n"], r["vectors"], kind, block_rows, max_cells, sample, page_bytes, begin)
        found = own.transform(_meetings, cosine, t, kind, *there)
        own = own.select("page", "k1", "k2", "copies", "first")
        pages, met = (own, found) if met is None else (pages.union(own), met.union(found))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if met is not None:
        alone = alone.union(_judged(keyed.select("vec_id", "k1", "k2"), pages, written(met, "met")))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _judged(keyed: DataFrame, pages: DataFrame, met: DataFrame) -> DataFrame:
    each = F.posexplode(F.arrays_zip("k1", "k2", "copies", "first")).alias("at", "x")
    nodes = pages.select("page", each).select((F.shiftleft("page", 32) + F.col("at")).alias("node"), "x.*")
    degree = met.groupBy("node").agg(F.sum("links").alias("others"))
    roots = components(met.select("node", "peer")).withColumnRenamed("node", "member")
    # Few vectors have links; only these are joined with their components.
    linked = degree.join(roots, F.col("node") == F.col("member")).select("node", "others", "root")
    least = linked.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("node", "others", "least", F.lit(True).alias("linked"))
    known = nodes.join(linked, "node", "left").select(
        "k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"),
    )
    # One row for each vector, should rounding ever have put equal ones on two pages.
    known = known.groupBy("k1", "k2").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return keyed.join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")


def _pages(
    rows: DataFrame, n: int, count: int, kind: str, block_rows: int, max_cells: int, sample: int, page_bytes: int, begin: int
) -> tuple[DataFrame, tuple[np.ndarray, int], int]:
    """The stored pages of vectors of one length; directions and number of centres; the next page's number."""
    centres, directions = _centres(rows, max(1, min(max_cells, math.ceil(count / block_rows))), sample)
    block_bytes = block_rows * n * (4 if kind == "float" else 8)
    blocks = max(1, min(page_bytes // block_bytes, count // (block_rows * LEAST_PAGES)))
    sent = rows.select("k1", "k2", F.lit(1).cast("long").alias("copies"), F.col("vec_id").alias("first"), "v")
    counts = np.zeros(len(centres) ** 2, np.int64)
    # About how many different vectors; repeated rows need no room.
    slotted = rows.select("k1", "v").mapInArrow(_slotted(centres), "slot long, k1 long")
    for r in slotted.groupBy("slot").agg(F.approx_count_distinct("k1").alias("vectors")).collect():
        counts[r["slot"]] = r["vectors"]
    first, many, pages = _deal(counts, block_rows * blocks)
    placed = sent.mapInArrow(_place(centres, begin + first, many), PLACED.format(kind=f"array<{kind}>"))
    grown = placed.groupBy("page").applyInArrow(_grow(centres, block_rows), PAGE)
    stored = written(grown, "pages", maxRecordsPerFile=max(1, FILE_BYTES // (block_bytes * blocks)))
    return stored, (directions, len(centres)), begin + pages


def _meetings(pages: DataFrame, cosine: float, t: float, kind: str, directions: np.ndarray, cells: int) -> DataFrame:
    """What each task finds in the pairs of pages that can reach each other.

    Pages are paired without a key, a pair in one order only; tasks read both sides from the stored
    table, and nothing is moved or sent.
    """
    one, two = (
        pages.select(*(F.col(c).alias(f"{side}_{c}") for c in ("page", "v", "path", "sizes", "lo", "hi", "near", "copies")))
        for side in ("one", "two")
    )
    a, b = F.col("one_page"), F.col("two_page")
    near = lambda x, y: F.forall(F.zip_with(f"{x}_lo", f"{y}_hi", lambda lo, hi: lo - hi <= t + ROUGH), lambda ok: ok)
    turn = (a == b) | ((a != b) & ((a < b) == ((a + b) % 2 == 0)))
    pairs = one.join(two, turn & near("one", "two") & near("two", "one")).drop("one_lo", "one_hi", "two_lo", "two_hi")
    return pairs.mapInArrow(_meet(cosine, t, "f4" if kind == "float" else "f8", directions, cells), "node long, peer long, links long")
