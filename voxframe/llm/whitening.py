"""Embedding whitening: leading eigenvectors of the covariance by spectrum slicing.

Spark sums counts, means and centred products over all distinct vectors; what reaches the driver is one square matrix
of the vectors' length. There, the factorisation LDLᵀ of the shifted matrix has as many negative pivots as there are
eigenvalues under the shift. These counts shut each leading eigenvalue in an interval, Rayleigh quotient iteration
closes in on it, and two last counts certify that it is the one of that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stored

#: Steps of a bounded double beyond which nothing is told apart.
EPS = float(np.finfo(float).eps)
#: Partial matrices are added up in so many groups before the last sum.
GROUPS = 64


# --- spectrum of a symmetric matrix ------------------------------------------------------------


def negative_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative: the negative blocks of LDLᵀ with blocks of one and two rows."""
    a, negative = a.copy(), 0
    while len(a):
        off = np.abs(a - np.diag(np.diag(a)))
        p = int(np.argmax(np.abs(np.diag(a))))
        r, s = divmod(int(np.argmax(off)), len(a))
        if abs(a[p, p]) >= 0.6404 * off[r, s]:  # the bound of growth for either kind of block is the same there
            d = a[p, p]
            negative += bool(d < 0)
            if d == 0:
                break  # nothing but zeros is left
            rest = np.delete(np.arange(len(a)), p)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[rest, p]) / d
        else:
            two, rest = [r, s], np.delete(np.arange(len(a)), [r, s])
            negative += 1  # its determinant is negative
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, two)] @ np.linalg.solve(a[np.ix_(two, two)], a[np.ix_(two, rest)])
        a = (a + a.T) / 2
    return negative


class Spectrum:
    """Leading eigenpairs of a symmetric positive semidefinite matrix, each certified by counts."""

    def __init__(self, v: np.ndarray):
        self.v, self.counts = v, {}
        self.norm = float(np.abs(v).sum(1).max()) if len(v) else 0.0
        self.least = len(v) * EPS * self.norm  # eigenvalues are known to this

    def above(self, shift: float) -> int:
        """How many eigenvalues are at the shift or above it."""
        if shift not in self.counts:
            self.counts[shift] = len(self.v) - negative_pivots(self.v - shift * np.eye(len(self.v)))
        return self.counts[shift]

    def isolate(self, k: int, width: float, lo: float, hi: float) -> tuple[float, float]:
        """An interval, narrower than ``width`` of its upper end, that holds the k-th eigenvalue from above; no other if that can be told."""
        while hi - lo > self.least and (hi - lo > width * hi or self.above(lo) - self.above(hi) > 1):
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            lo, hi = (mid, hi) if self.above(mid) >= k else (lo, mid)
        return lo, hi

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and unit vectors (rows) of the ``most`` largest eigenvalues, falling; no more than the matrix has rows."""
        most, d = min(most, len(self.v)), len(self.v)
        if not self.norm:
            return np.zeros(most), np.eye(d)[:most]
        values, vectors, start = np.zeros(most), np.zeros((most, d)), np.random.default_rng(11)
        for k in range(1, most + 1):
            found = vectors[: k - 1]
            free = lambda y: y - found.T @ (found @ y)  # noqa: E731, B023  apart from those found before, which may share the eigenvalue
            lo, hi, width = -2 * self.least, self.norm + 2 * self.least, 0.1
            while True:
                lo, hi = self.isolate(k, width, lo, hi)
                y = free(free(start.normal(size=d)))
                y, shift = y / max(np.linalg.norm(y), 1e-300), (lo + hi) / 2
                for turn in range(30):
                    y = free(free(self._solve(shift, y)))
                    y /= max(np.linalg.norm(y), 1e-300)
                    if turn:  # the first steps stay at the middle of the interval
                        shift = float(y @ self.v @ y)
                    if turn > 2 and np.linalg.norm(self.v @ y - shift * y) <= self.least:
                        break
                tolerance = 8 * self.least
                inside = lo - tolerance <= shift <= hi + tolerance
                certain = self.above(shift - tolerance) >= k and self.above(shift + tolerance) < k
                if inside and (certain or hi - lo <= self.least) or width < EPS:
                    break
                width /= 16
            big = int(np.argmax(np.abs(y)))
            values[k - 1], vectors[k - 1] = shift, y * (1 if y[big] >= 0 else -1)
        return values, vectors

    def _solve(self, shift: float, y: np.ndarray) -> np.ndarray:
        while True:
            try:
                x = np.linalg.solve(self.v - shift * np.eye(len(y)), y)
                if np.isfinite(x).all():
                    return x
            except np.linalg.LinAlgError:
                pass
            shift += max(self.least, 1e-300)


# --- the table -------------------------------------------------------------------------------


class Fit(NamedTuple):
    """What whitening needs of the fit list: its size, sums of each dimension, and the components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def usable(self) -> np.ndarray:
        """Which components have a variance above rounding."""
        return self.values > len(self.sums) * EPS * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, NaN where a component has no variance."""
        scale = np.where(self.usable(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (x - self.mean()) @ self.vectors.T / scale


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            safe = len(x) and float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
            total = [t + int(s) for t, s in zip(total, (x if safe else x.astype(object)).sum(0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    return run


def _products(mean: np.ndarray):
    """Sums of centred products over a task's rows, by row and column of the matrix."""
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            c = _matrix(batch.column("x"), dims) - mean
            total += c.T @ c
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


def _whitened(fit: Fit):
    names = [f"w{k}" for k in range(len(fit.values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = fit.project(_matrix(batch.column("x"), len(fit.sums)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names=names)

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sum of (n x - S)² of each row; null where that does not fit in 64 bits."""
    bound = n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums))
    if bound * bound * len(sums) < 2.0**62:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(1))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def _components(fit: Fit, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column("x"), len(fit.sums)), len(fit.values)
            w, rows = fit.project(x), np.repeat(np.arange(len(x)), m)
            number = np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(number), pa.array(np.full(len(rows), fit.n, np.int64)), _deviations(x, fit.n, fit.sums).take(pa.array(rows)), pa.array(w.ravel(), mask=np.isnan(w.ravel()))],
                names=[id_col, "component", "n", "deviation", "whitened"],
            )

    return run


def fit_components(distinct: DataFrame, dims: int, components: int) -> Fit | None:
    """Sums, covariance (divisor n, centred before multiplying) and leading eigenpairs of a table of distinct x; None if it is empty."""
    sums = distinct.mapInArrow(_sums(dims), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("s")).orderBy("i").collect()
    if not sums:
        return None
    n, s = sums[0].n, [int(r.s) for r in sums]
    mean = np.array([v / n for v in s])
    parts = distinct.mapInArrow(_products(mean), "i int, j int, s double").withColumn("part", F.spark_partition_id() % GROUPS)
    cells = parts.groupBy("i", "j", "part").agg(F.sum("s").alias("s")).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    v = np.zeros((dims, dims))
    for c in cells:
        v[c.i, c.j] = c.s / n
    v = (v + v.T) / 2
    return Fit(n, s, *Spectrum(v).pairs(components), float(np.trace(v)))


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each row on the leading principal components of ``x = floor(256 * entry)``.

    The fit list is each distinct x once; covariances are over it, with its length as divisor. Returns, for each row
    and each component up to ``components`` (or the vectors' length, if less): id, ``component`` (from 1, by falling eigenvalue), ``n``
    (length of the fit list), ``deviation`` (sum over dimensions of (n x - S)², exact), ``whitened``, ``explained`` (eigenvalue over trace) and
    ``identity_error`` (the largest absolute entry of the whitened fit list's covariance minus the identity, measured on it).

    Rows are left out whose vector is null or empty, of another length than most (of equally frequent lengths, the shortest counts), or holds nulls or
    numbers that are not finite or whose x does not fit in 64 bits. Rows with a null or repeated id are each in the result; columns besides
    these two are not looked at. Components without variance above rounding have a null ``whitened`` and take no part in
    ``identity_error``; ``explained`` is null if the trace is zero. ``deviation`` is null where it does not fit in 64 bits. An empty table gives an empty result.

    The driver holds one matrix of length x length numbers, whatever the number of rows.
    """
    spark, vec = vectors.sparkSession, F.col(vec_col)
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fine = F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double") * 256) < float(1 << 63)) & ~F.isnan(c))
    rows = vectors.where(vec.isNotNull() & (F.size(vec) > 0) & fine).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    usual = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], schema)
    dims = usual[0].dims
    rows = rows.where(F.size("vec") == dims).select("id", F.transform("vec", lambda c: F.floor(c.cast("double") * 256)).alias("x"))
    distinct = stored(rows.select("x").distinct(), "whitening-fit")
    fit = fit_components(distinct, dims, components)
    if fit is None:
        return spark.createDataFrame([], schema)
    good = [k for k in range(len(fit.values)) if fit.usable()[k]]
    whitened = distinct.mapInArrow(_whitened(fit), ", ".join(f"w{k} double" for k in range(len(fit.values))))
    error = None
    if good:
        error = max(abs(c - (a == b)) for (a, b), c in zip([(a, b) for a in good for b in good if a <= b], whitened.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in good for b in good if a <= b]).first()))
    out = rows.mapInArrow(_components(fit, id_col), f"{id_col} long, component int, n long, deviation long, whitened double")
    explained = F.lit(None).cast("double")
    if fit.trace > 0:
        explained = F.element_at(F.array(*[F.lit(float(max(e, 0.0) / fit.trace)) for e in fit.values]), F.col("component"))
    return out.withColumns({"explained": explained, "identity_error": F.lit(error).cast("double")})
