"""Embedding whitening: distributed centred covariance, eigenvectors by tridiagonalisation.

Entries c become fixed-point longs x = floor(64 c) + 1,000,000. The statistics are over the fit list,
each distinct x vector once: its size n, the sums S a dimension, and the covariance V (divisor n) of
x - S/n, centred before anything is multiplied. Partial sums are made in the tasks; what reaches the
driver is d sums and d x d products, d being the dimension.

On the driver V is brought to tridiagonal form by Householder reflections; the leading eigenvalues
come from bisection on Sturm counts, their vectors from inverse iteration, where the vectors of
eigenvalues that lie close together are orthogonalised against each other, and are carried back
through the reflections. Each row is then projected by a broadcast d x 16 matrix.

Centring is exact: with S = n q + r, x - S/n is (x - q) - r/n, of which x - q is an integer.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor
those with an entry beyond 2^52 / 64 in size, which has no exact long. Vectors must have one length to be
compared: those of another length than the commonest (of equally common ones the greatest) take no part.
Repeated rows are all returned; a null id stays null. Components whose eigenvalue is zero up to
rounding can't be whitened and are not returned (all vectors equal: no rows). A deviation beyond
a long is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlap.llm.common import staged

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 52) / SCALE
CLUSTER = 1e-3  # eigenvalues nearer than this share of the norm are one cluster
BATCH = 1 << 22  # entries of vectors turned at a time
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def _lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (nulls as NaN or 0), their validity, and each list's offsets; the array has no null lists."""
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    valid = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
    return values, valid, offsets.astype(np.int64)


def fixed_point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and x of the rows that take part."""
    for batch in batches:
        batch = batch.filter(batch.column("v").is_valid())
        values, valid, at = _lists(batch.column("v"), np.float64)
        with np.errstate(invalid="ignore"):
            good = valid & (np.abs(values) <= LARGEST)
        x = np.floor(np.where(good, values, 0.0) * SCALE).astype(np.int64) + SHIFT
        bad = np.concatenate([[0], np.cumsum(~good)])
        keep = (bad[at[1:]] == bad[at[:-1]]) & (at[1:] > at[:-1])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "x"]).filter(pa.array(keep))


def _matrices(batch: pa.RecordBatch, d: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The x vectors of a batch, some rows at a time."""
    step = max(1, BATCH // max(1, d))
    for lo in range(0, batch.num_rows, step):
        part = batch.column("x").slice(lo, step)
        yield slice(lo, lo + len(part)), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _sums(d: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            for _, x in _matrices(batch, d):
                total += x.sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(d), pa.int32()), "s": pa.array(total),
                                              "n": pa.array(np.full(d, n))})
    return made


def _centred(x: np.ndarray, q: np.ndarray, f: np.ndarray) -> np.ndarray:
    return (x - q).astype(np.float64) - f


def _products(d: int, q: np.ndarray, f: np.ndarray, project: np.ndarray | None = None):
    """Sums over all vectors of the products of their centred (and projected) entries."""
    k = d if project is None else project.shape[1]
    upper = np.triu_indices(k)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((k, k)), False
        for batch in batches:
            for _, x in _matrices(batch, d):
                z = _centred(x, q, f)
                z = z if project is None else z @ project
                total += z.T @ z
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()),
                                              "v": pa.array(total[upper])})
    return made


def _matrix(fit: DataFrame, made, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for r in fit.mapInArrow(made, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]  # k x k cells
    return out


# ---- symmetric eigenproblem ------------------------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal, and the Householder vectors that bring ``a`` to them."""
    a, d = a.copy(), len(a)
    steps = []
    for k in range(d - 2):
        col = a[k + 1:, k]
        size = np.abs(col).max()
        if size == 0.0 or not np.abs(col[1:]).max():
            continue
        v = col / size
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2.0 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        head = a[k + 1:, k] - 2.0 * v * (v @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = head
        steps.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), steps


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of the points ``at``."""
    tiny = np.finfo(float).tiny
    q = diag[0] - at
    below = (q < 0).astype(np.int64)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        with np.errstate(over="ignore"):
            q = diag[i] - at - off[i - 1] ** 2 / q
        below += q < 0
    return below


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection."""
    d = len(diag)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    lo = np.full(k, (diag - reach).min())
    hi = np.full(k, (diag + reach).max() + 1e-300)
    wanted = d - 1 - np.arange(k)  # so many lie below the value sought
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        above = sturm_counts(diag, off, mid) > wanted
        hi, lo = np.where(above, mid, hi), np.where(above, lo, mid)


def _solved(diag: np.ndarray, off: np.ndarray, value: float, rhs: np.ndarray, small: float) -> np.ndarray:
    """(T - value) y = rhs by elimination with row exchanges; vanishing pivots become ``small``."""
    d = len(diag)
    one, two, three = (diag - value).tolist(), [*off.tolist(), 0.0], [0.0] * d
    y, low = rhs.tolist(), off.tolist()
    for i in range(d - 1):
        if abs(low[i]) > abs(one[i]):
            one[i], low[i] = low[i], one[i]
            two[i], one[i + 1] = one[i + 1], two[i]
            three[i], two[i + 1] = two[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(one[i]) < small:
            one[i] = small
        m = low[i] / one[i]
        one[i + 1] -= m * two[i]
        two[i + 1] -= m * three[i]
        y[i + 1] -= m * y[i]
    if abs(one[-1]) < small:
        one[-1] = small
    for i in range(d - 1, -1, -1):
        t = y[i] - (two[i] * y[i + 1] if i + 1 < d else 0.0) - (three[i] * y[i + 2] if i + 2 < d else 0.0)
        y[i] = t / one[i]
        if abs(y[i]) > 1e250:  # only the direction matters
            y = [c * 1e-250 for c in y]
    return np.array(y)


def leading_eigenvectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of the symmetric ``a`` and their unit vectors (columns)."""
    d = len(a)
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(k), np.eye(d)[:, :k]
    diag, off, steps = tridiagonal(a / scale)
    values = leading_eigenvalues(diag, off, k)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0))
    small = np.finfo(float).eps * norm
    rng, vectors, first, used = np.random.default_rng(13), np.zeros((d, k)), 0, np.inf
    for m in range(k):
        if m and values[m - 1] - values[m] > CLUSTER * norm:
            first = m
        # equal values are moved apart, so that the same system isn't solved twice
        used = min(values[m], used - 4 * small) if m > first else values[m]
        y = rng.standard_normal(d)
        for _ in range(4):
            y = _solved(diag, off, used, y, small)
            y /= np.abs(y).max()
            for c in range(first, m):
                y -= (vectors[:, c] @ y) * vectors[:, c]
            for c in range(first, m):  # once more: the first pass loses digits where much is removed
                y -= (vectors[:, c] @ y) * vectors[:, c]
            y /= np.sqrt(y @ y)
        vectors[:, m] = y
    for start, v in reversed(steps):
        part = vectors[start:]
        part -= 2.0 * np.outer(v, v @ part)
    return values * scale, vectors / np.sqrt((vectors ** 2).sum(axis=0))


def _deviations(x: np.ndarray, n: int, q: np.ndarray, r: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    off = x - q
    size = float(np.abs(off).max(initial=0) + 1) * n
    if x.shape[1] * size * size < 2.0 ** 62:
        return ((off * n - r) ** 2).sum(axis=1).tolist()
    exact = ((off.astype(object) * n - r.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The contract's rows for a table with ``vec_id`` and ``embedding``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"))
    rows = staged(rows.mapInArrow(fixed_point, "vec_id long, x array<long>"), "fixed-vectors")
    common = (rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.desc("d")).first())
    if common is None:
        return spark.createDataFrame([], _OUT)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    fit = staged(rows.select("x").distinct(), "fit-list")
    sums = fit.mapInArrow(_sums(d), "at int, s long, n long").groupBy("at").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()  # d rows
    n, total = sums[0]["n"], [r["s"] for r in sums]
    q = np.array([s // n for s in total], dtype=np.int64)
    r = np.array([s % n for s in total], dtype=np.int64)
    f = r / n
    cov = _matrix(fit, _products(d, q, f), d) / n
    values, basis = leading_eigenvectors(cov, min(components, d))
    trace = float(np.trace(cov))
    whole = values > max(8 * d * np.finfo(float).eps * max(values.max(initial=0.0), 0.0), 0.0)
    values, basis = values[whole], basis[:, whole]
    k = len(values)
    if not k:
        return spark.createDataFrame([], _OUT)
    project = basis / np.sqrt(values)  # d x k: of the size of the dimension
    error = float(np.abs(_matrix(fit, _products(d, q, f, project), k) / n - np.eye(k)).max())
    explained = values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch, d):
                m = len(x)
                ids = batch.column("vec_id").slice(part.start, m)
                z = _centred(x, q, f) @ project
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, n), pa.int64()),
                    "deviation": pa.array(_deviations(x, n, q, r), pa.int64()).take(
                        pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(z.ravel()),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error))})

    return rows.mapInArrow(projected, _OUT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
