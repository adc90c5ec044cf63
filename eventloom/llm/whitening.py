"""Embedding whitening: leading components of the vectors' covariance by spectrum slicing.

Spark does what grows with the rows: distinct integer vectors, exact sums, the covariance of
centred vectors, the projection of every row. What is left for the driver has the size of the
dimension: a symmetric matrix, whose leading eigenvalues are told apart by counts of negative
pivots of shifted LDL^T factors (inertia), refined by Rayleigh quotient iteration, and whose
numbers the same counts then certify.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 64, 1_000_000
# Entries from here on have no long x.
LARGEST = float(2**56)
LONG = 2**62


# --- the spectrum of a symmetric matrix ------------------------------------------------------


def negatives(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` below ``shift``: negative pivots of LDL^T with symmetric pivoting."""
    m = a - shift * np.eye(len(a))
    alpha = (1 + 17**0.5) / 8
    k, below, size = 0, 0, len(m)

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < size:
        two = False
        if k + 1 < size:
            column = np.abs(m[k + 1 :, k])
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if abs(m[k, k]) < alpha * most:
                row = np.abs(m[k:, r])
                row[r - k] = 0
                other = row.max()
                if abs(m[k, k]) * other < alpha * most * most:
                    if abs(m[r, r]) >= alpha * other:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        two = True
        if two:
            # Such a block has a negative determinant: one eigenvalue on each side.
            below += 1
            block, c = m[k : k + 2, k : k + 2].copy(), m[k + 2 :, k : k + 2].copy()
            m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            k += 2
        else:
            pivot, c = m[k, k], m[k + 1 :, k].copy()
            below += pivot < 0
            if pivot != 0:
                m[k + 1 :, k + 1 :] -= np.outer(c, c / pivot)
            k += 1
    return int(below)


def _refine(a: np.ndarray, at: float, found: list[np.ndarray], tol: float, seed: int) -> tuple[float, np.ndarray]:
    """Two steps of inverse iteration at ``at``, then Rayleigh quotient iteration, beside ``found``."""
    basis = np.array(found) if found else np.zeros((0, len(a)))
    one = np.eye(len(a))

    def beside(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
            v = v / np.linalg.norm(v)
        return v

    v = beside(np.random.default_rng(seed).normal(size=len(a)))
    shift, best = at, (np.inf, at, v)
    for step in range(30):
        try:
            w = np.linalg.solve(a - shift * one, v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (shift + tol) * one, v)
        if not np.isfinite(w).all():
            break
        v = beside(w / np.abs(w).max())
        value = v @ a @ v
        rest = np.linalg.norm(a @ v - value * v)
        if rest < best[0]:
            best = (rest, value, v)
        elif step > 3:
            break
        if step >= 1:
            shift = value
    return best[1], best[2]


def leading(a: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` greatest eigenvalues of a symmetric matrix with unit eigenvectors, falling.

    Each eigenvalue's interval is halved until inertia counts say that it holds this one alone, or
    is as narrow as rounding; a result outside of its interval halves it further. At the end a
    count on either side certifies the number. Equal eigenvalues give an orthonormal basis.
    """
    size = len(a)
    radius = float(np.abs(a).sum(axis=1).max()) if size else 0.0
    if radius == 0.0:
        return [(0.0, row) for row in np.eye(size)[:count]]
    a = a / radius
    tol = 4 * size * np.finfo(float).eps
    marks: dict[float, int] = {-1.5: size, 1.5: 0}

    def above(x: float) -> int:
        if x not in marks:
            marks[x] = size - negatives(a, x)
        return marks[x]

    out: list[tuple[float, np.ndarray]] = []
    for k in range(1, min(count, size) + 1):
        lo = max(x for x, n in marks.items() if n >= k)
        hi = min(x for x, n in marks.items() if n < k and x > lo)
        alone = False
        while True:
            while hi - lo > tol and not alone:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if above(mid) >= k else (lo, mid)
                alone = above(lo) == k and above(hi) == k - 1
            value, vector = _refine(a, (lo + hi) / 2, [v for _, v in out], tol, k)
            if hi - lo <= tol or lo - tol <= value <= hi + tol:
                break
            alone = False
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) >= k else (lo, mid)
        vector = vector * np.sign(vector[np.abs(vector).argmax()])
        out.append((float(value), vector))
    for k, (value, _) in enumerate(out, 1):
        edge = 16 * tol
        if above(value - edge) < k or above(value + edge) >= k:
            raise ArithmeticError(f"eigenvalue {k} is not certified by its counts")
    out.sort(key=lambda x: -x[0])
    return [(value * radius, vector) for value, vector in out]


# --- passes over the rows --------------------------------------------------------------------


def integers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry; null for a vector that has none."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    return F.when(fine, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def _grid(column: pa.Array, size: int) -> np.ndarray:
    """x - OFFSET of a batch as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - OFFSET


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs while they fit, Python integers beyond. ``x``, ``sums`` less OFFSET."""
    wide = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if wide < LONG // 2:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sum_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            x = _grid(batch.column(0), size)
            n += len(x)
            small = int(np.abs(x).max(initial=0)) * max(len(x), 1) < LONG
            part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            sums = [s + int(p) for s, p in zip(sums, part)]
        exact = [decimal.Decimal(s) for s in (n, *sums)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, size), pa.int32()), pa.array(exact, pa.decimal128(38, 0))], ["i", "s"]
        )

    return run


def _product_rows(size: int, n: int, sums: list[int], onto: np.ndarray | None):
    """Upper triangle of each task's sum of products of centred vectors (or of projections)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            z = _centred(_grid(batch.column(0), size), n, sums).astype(np.float64) / n
            if onto is not None:
                z = z @ onto
            total = total + z.T @ z
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"]
            )

    return run


def _covariance(fit: DataFrame, size: int, n: int, sums: list[int], onto: np.ndarray | None = None) -> np.ndarray:
    rows = fit.mapInArrow(_product_rows(size, n, sums, onto), "i int, j int, s double")
    width = size if onto is None else onto.shape[1]
    out = np.zeros((width, width))
    for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def _project(size: int, n: int, sums: list[int], onto: np.ndarray, variance: np.ndarray, explained: np.ndarray, error: float):
    """Rows (vec_id, component, ...) of a batch of (vec_id, x)."""
    width = onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _centred(_grid(batch.column(1), size), n, sums)
            rows = len(y)
            if int(np.abs(y).max(initial=0)) ** 2 * size < LONG:
                deviation = pa.array((y.astype(np.int64) ** 2).sum(axis=1)).take(pa.array(np.repeat(np.arange(rows), width)))
            else:
                squares = [sum(int(v) ** 2 for v in row) for row in y]
                fits = [v if v < 2**63 else None for v in squares]
                deviation = pa.array([v for v in fits for _ in range(width)], pa.int64())
            w = (y.astype(np.float64) / n) @ onto
            flat = variance <= 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * width, n, np.int64)),
                    deviation,
                    pa.array(w.ravel(), mask=np.tile(flat, rows)),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * width, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    x = floor(64 c) + 1000000 per entry; means and covariances are over the distinct x vectors.
    Left out are rows whose vector is null or holds null or non-finite entries, or entries of 2^56
    and more, whose x is no long; and rows of another length than most distinct vectors have (the
    longer one on a tie), as no covariance spans two lengths. An empty vector counts as a
    vector of length 0 and gives no rows. Repeated rows and null or repeated ids each give their
    rows. A vector shorter than ``components`` gives as many components as it has entries. A
    component without variance (one distinct vector, fewer vectors than components) has null
    whitened and explained 0; it takes no part in identity_error. A deviation beyond a long is
    null. An empty table gives no rows. Other columns are not read.
    """
    named = vectors.select(F.col(id_col).alias("vec_id"), integers(F.col(vector_col)).alias("x")).where("x is not null")
    fit = written(named.select("x").distinct(), "fit")
    sizes = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = sizes["size"] if sizes else 0
    if not size:
        return vectors.sparkSession.createDataFrame([], schema)
    fit, named = fit.where(F.size("x") == size), named.where(F.size("x") == size)
    found = fit.mapInArrow(_sum_rows(size), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    exact = {r.i: int(r.s) for r in found}
    n, sums = exact[-1], [exact[i] for i in range(size)]
    cov = _covariance(fit, size, n, sums)
    pairs = leading(cov, min(components, size))
    trace = float(np.trace(cov))
    # Below rounding there is no variance.
    least = 16 * size * np.finfo(float).eps * trace
    variance = np.array([e if e > least else 0.0 for e, _ in pairs])
    onto = np.column_stack([v / np.sqrt(e) if e > 0 else v * 0 for e, (_, v) in zip(variance, pairs)])
    real = variance > 0
    error = 0.0
    if real.any():
        seen = _covariance(fit, size, n, sums, onto[:, real])
        error = float(np.abs(seen - np.eye(int(real.sum()))).max())
    explained = variance / trace if trace > 0 else variance
    return named.mapInArrow(_project(size, n, sums, onto, variance, explained, error), schema)
