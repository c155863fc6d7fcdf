"""Embedding whitening (operator 13).

The covariance of the distinct vectors is gathered in two passes, sums first and
then centred products, each task adding up its rows before anything is shuffled.
The matrix has as many rows as a vector has components, whatever the number of
vectors, and its leading eigenvectors are found on the driver: Householder
reflections make it tridiagonal, counts of sign changes (Sturm) bisect for each
of the largest eigenvalues, and inverse iteration gives their vectors, those of
one cluster of eigenvalues being made orthogonal to each other in every step.
The few components then go to all tasks, which project their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import is_sound, matrix, whole

#: Eigenvalues nearer to each other than this part of the largest are a cluster.
CLUSTER = 1e-3
#: Components of less than this part of the trace are rounding of no variance.
NO_VARIANCE = 1e-12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix."""
    a, n, reflections = a.astype(np.float64).copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) > 0:
            v[0] += size if v[0] >= 0 else -size
            v /= np.linalg.norm(v)
            sub = a[k + 1:, k + 1:]
            w = sub @ v
            w -= (v @ w) * v
            sub -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
            a[k, k + 1:] = a[k + 1:, k]
        else:
            v = np.zeros(n - k - 1)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_below(diagonal: np.ndarray, squares: np.ndarray, x: float, tiny: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are less than x: the negative
    pivots of its factors (Sturm); ``squares`` are those of the off-diagonal."""
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - x - (squares[i - 1] / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, largest first, by bisection."""
    n = len(diagonal)
    around = np.zeros(n)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    low, high = (diagonal - around).min(), (diagonal + around).max()
    squares, scale = off ** 2, max(abs(low), abs(high), 1e-300)
    tiny, out = np.finfo(float).eps * scale * 1e-3, []
    for j in range(k):
        a, b = low, out[-1] if out else high + tiny
        b = max(b, a) + 2 * np.finfo(float).eps * scale
        while b - a > 2 * np.finfo(float).eps * scale:
            mid = a + (b - a) / 2
            if mid in (a, b):
                break
            if count_below(diagonal, squares, mid, tiny) >= n - j:      # the j-th from above is below mid
                b = mid
            else:
                a = mid
        out.append(a + (b - a) / 2)
    return np.array(out)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - shift) x = b with rows exchanged where the pivot is smaller."""
    n = len(diagonal)
    d, u, uu, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    low = np.append(off, 0.0)
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            d[i] = d[i] if abs(d[i]) > tiny else tiny
            f = low[i] / d[i]
            d[i + 1] -= f * u[i]
            x[i + 1] -= f * x[i]
        else:
            f = d[i] / low[i]
            d[i], u[i], d[i + 1] = low[i], d[i + 1], u[i] - f * d[i + 1]
            if i + 1 < n - 1:
                uu[i], u[i + 1] = u[i + 1], -f * u[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        right = x[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (uu[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = right / (d[i] if abs(d[i]) > tiny else tiny)
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, largest first, and their
    unit eigenvectors as columns."""
    n, k, scale = len(a), min(k, len(a)), float(np.abs(a).max())
    if scale == 0:
        return np.zeros(k), np.eye(n, k)
    a = a / scale
    diagonal, off, reflections = tridiagonal(a)
    values = leading_eigenvalues(diagonal, off, k)
    tiny, vectors = np.finfo(float).eps, np.zeros((n, k))
    rng = np.random.default_rng(13)
    first = 0                       # of the cluster that a value is in
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * abs(values[0]):
            first = j
        x = rng.normal(size=n)
        for _ in range(6):
            # equal values get shifts of their own
            x = _solve(diagonal, off, values[j] - (j - first) * 4 * tiny, x, tiny)
            for _ in range(2):
                x -= vectors[:, first:j] @ (vectors[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    # the vector's own quotient is nearer than the end of the bisection
    return np.einsum("ij,ij->j", vectors, a @ vectors) * scale, vectors


def _summed(rows: DataFrame, task, width: int) -> np.ndarray:
    """Sum of the float64 vectors that ``task`` makes of each task's batches."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            total += task(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["at", "part"])
    parts = rows.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part"))
    out = np.zeros(width)
    for r in parts.collect():           # one row for each entry of the matrix
        out[r["at"]] = r["part"]
    return out


def covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of the vectors in column x, centred first."""
    d = len(mean)
    upper = np.triu_indices(d)

    def task(batch):
        c = matrix(batch.column(0), d) - mean
        return (c.T @ c)[upper]
    out = np.zeros((d, d))
    out[upper] = _summed(fit.select("x"), task, len(upper[0])) / n
    return np.triu(out) + np.triu(out, 1).T


def fit(vectors: DataFrame, k: int):
    """n, the sums S, the eigenvalues, the components (columns), the trace, and
    how far the whitened vectors' covariance is from the identity, of a table
    whose column x has whole components.  None if it is empty."""
    distinct = materialize(vectors.select("x").distinct(), "fit")
    head = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = head["n"], head["d"] or 0
    if not n or not d:
        return None
    # whole numbers: the sum of longs is exact in any order
    sums = np.zeros(d, object)
    for r in distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
            F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["at"]] = int(r["s"])
    mean = np.array([float(s) / n for s in sums])
    v = covariance(distinct, mean, n)
    trace = float(np.trace(v))
    values, components = leading(v, k)
    some = values > NO_VARIANCE * trace
    values, components = values[some], components[:, some]
    k = len(values)
    if not k:
        return n, sums, mean, values, components, trace, 0.0

    def task(batch):
        w = (matrix(batch.column(0), d) - mean) @ components / np.sqrt(values)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])
    moments = _summed(distinct.select("x"), task, k + k * k) / n
    centre, square = moments[:k], moments[k:].reshape(k, k)
    error = float(np.abs(square - np.outer(centre, centre) - np.eye(k)).max())
    return n, sums, mean, values, components, trace, error


def whiten(table: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each sound vector and component (from 1, by falling variance):
    vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold nulls or values that are not finite, are left
    out; one that is shorter than the longest ends in zeros.  The covariance is
    of the distinct vectors, so copies weigh nothing; equal eigenvalues (ties)
    give some orthogonal components of their space, the same for all rows.
    Components without variance do not exist: one distinct vector, an empty
    table, or vectors without entries give an empty result.  Repeated rows and
    null ids come out as they come in; a deviation beyond 64 bits is null; other
    columns are not read.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(is_sound(F.col("v"))) \
        .select("id", whole(F.col("v")).alias("x"))
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    found = fit(rows, k)
    if found is None or not len(found[3]):
        return table.sparkSession.createDataFrame([], schema)
    n, sums, mean, values, components, trace, error = found
    d, k = components.shape
    scaled = components / np.sqrt(values)
    square = sum(int(s) * int(s) for s in sums)
    wide = float(n) * max(abs(s) for s in sums) > 2.0 ** 40       # beyond what doubles add up exactly
    float_sums = np.array([float(s) for s in sums])

    def project(batches):
        for batch in batches:
            x, m = matrix(batch.column(1), d), batch.num_rows
            # sum of (n x - S)^2 = n^2 x.x - 2 n x.S + S.S in whole numbers
            own = (x * x).sum(1)
            if wide:
                along = [sum(int(a) * b for a, b in zip(r, sums)) for r in x]
            else:
                along = (x @ float_sums).tolist()
            deviation = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(own, along)]
            deviation = [v if v < 1 << 63 else None for v in deviation]
            w = (x - mean) @ scaled
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column(0).to_pylist(), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()),
                pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, schema)
