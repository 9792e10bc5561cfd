"""Whitening of embeddings by a compensated covariance.

Vectors become integers, so sums are exact and the centred values, times their number n, are integers too. Each task splits
them without error into short parts whose products and sums of a block are exact in doubles, and adds the blocks' outer
products to a matrix in double-double by error-free sums; tasks' high and low parts are merged row by row of the matrix in
the same way. The eigenproblem of the merged matrix (its side is the vectors' length) is solved by reduction to tridiagonal
form and divide and conquer (LAPACK's syevd), then refined once with the low parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_table

#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block and bits of a part: 2 * 20 + 12 bits and a sign fit a double exactly.
BLOCK, BITS = 4096, 20


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as its rounded value and the exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of hi + lo and more + low."""
    s, e = two_sum(hi, more)
    t, f = two_sum(lo, np.broadcast_to(low, lo.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def split(d: np.ndarray) -> list[np.ndarray]:
    """Integers as doubles that sum to them, each a multiple of a power of two with at most BITS bits and a sign."""
    parts, rest, shift = [], d, 0
    while True:
        low = ((rest + (1 << (BITS - 1))) & ((1 << BITS) - 1)) - (1 << (BITS - 1))
        parts.append(low.astype(np.float64) * 2.0**shift)
        rest, shift = (rest - low) >> BITS, shift + BITS
        if not rest.any():
            return parts


def outer_sum(d: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hi + lo plus the outer products of the rows of integers d: each block's part products are exact, smallest first."""
    for at in range(0, len(d), BLOCK):
        parts = split(d[at : at + BLOCK])
        for k in range(2 * len(parts) - 1):
            for i in range(max(0, k - len(parts) + 1), min(k, len(parts) - 1) + 1):
                hi, lo = dd_add(hi, lo, parts[i].T @ parts[k - i])
    return hi, lo


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with x, an array of integers, in place of the vector, without rows whose vector is null, empty or holds an entry
    that is null or not finite."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(v, lambda e: F.floor(e.cast("double") * SCALE) + SHIFT)
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(fine).withColumn("__x", x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


@dataclass
class Whitening:
    """n fitted vectors with sums per dimension; unit components in rows by falling eigenvalue, eigenvalues and their trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(whitened values, exact deviations) of rows of x."""
        d = self.n * x - self.sums  # n times the centred value, exact
        top = int(np.abs(d).max(initial=0))
        size = (d * d).sum(axis=1).tolist() if top * top * d.shape[1] < 1 << 63 else [sum(v * v for v in row) for row in d.tolist()]
        return d.astype(np.float64) @ self.components.T / self.n / np.sqrt(self.values), size


def _sums(fit: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number and sums of the vectors; tasks' sums are added up by dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for b in batches:
            if len(b):
                n, total = n + len(b), total + _matrix(b.column(0)).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array([-1, *range(size)], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["i", "s"])

    rows = fit.mapInArrow(each, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one more than dimensions
    got = {r.i: r.s for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(size)], np.int64)


def _merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("task")
    hi = lo = np.zeros(len(part["hi"].iloc[0]))
    for a, b in zip(part["hi"], part["lo"]):
        hi, lo = dd_add(hi, lo, np.asarray(a), np.asarray(b))
    return pd.DataFrame({"i": [key[0]], "task": [int(part["task"].iloc[0])], "hi": [hi], "lo": [lo]})


ROW = "i int, task int, hi array<double>, lo array<double>"


def outer_products(fit: DataFrame, size: int, rows_of, fan: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of outer products of rows_of(x), integers, over all rows of fit.

    Each task gives its matrix as `size` rows; a row's parts meet in two steps, first those of `fan` tasks each.
    """
    from pyspark import TaskContext

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi = lo = None
        for b in batches:
            if len(b):
                d = rows_of(_matrix(b.column(0)))
                if hi is None:
                    hi = lo = np.zeros((d.shape[1], d.shape[1]))
                hi, lo = outer_sum(d, hi, lo)
        if hi is not None:
            task = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(range(len(hi)), pa.int32()), pa.array([task] * len(hi), pa.int32()), pa.array(list(hi)), pa.array(list(lo))], names=["i", "task", "hi", "lo"])

    parts = fit.mapInArrow(each, ROW)
    once = parts.withColumn("f", F.floor(F.col("task") / fan)).groupBy("i", "f").applyInPandas(lambda key, p: _merged(key, p), ROW)
    rows = sorted(once.groupBy("i").applyInPandas(lambda key, p: _merged(key, p), ROW).collect(), key=lambda r: r.i)
    return (np.array([r.hi for r in rows]).reshape(len(rows), -1), np.array([r.lo for r in rows]).reshape(len(rows), -1))


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in rows of the symmetric matrix hi + lo.

    Divide and conquer on the tridiagonal form in doubles, then a step of Ogita and Aishima's refinement in long doubles,
    which see the low parts.
    """
    first, vectors = np.linalg.eigh((hi + hi.T) / 2)  # LAPACK's syevd
    v, x = hi.astype(np.longdouble) + lo.astype(np.longdouble), vectors.astype(np.longdouble)
    v = (v + v.T) / 2
    r = np.eye(len(v), dtype=np.longdouble) - x.T @ x
    s = x.T @ (v @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    near = 2 * (np.abs(s - np.diag(values)).max(initial=0) + np.abs(v).max(initial=0) * np.abs(r).max(initial=0))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    better = (x + x @ step).T
    better /= np.sqrt((better * better).sum(axis=1, keepdims=True))
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), better[order].astype(np.float64)


def fit_whitening(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors __x (all of one length); None if there are none.

    Components whose eigenvalue is no more than rounding (d * 2**-52 of the largest) are left out: nothing varies along them.
    """
    fit = vectors.select("__x")
    first = fit.limit(1).collect()
    if not first:
        return None
    size = len(first[0][0])
    n, sums = _sums(fit, size)
    hi, lo = outer_products(fit, size, lambda x: n * x - sums)
    values, rows = eigen(hi, lo)
    values = values / float(n) / float(n) / float(n)
    hold = values[:components] > size * 2.0**-52 * max(values[0], 0.0)
    return Whitening(n, sums, rows[:components][hold], values[:components][hold], float(np.trace(hi) + np.trace(lo)) / float(n) ** 3)


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry, in absolute terms, of the whitened fit list's covariance minus the identity.

    A pass over the fit list: whitened values are taken as integers of 2**-40, which changes them by less than 1e-12.
    """
    if not len(w.values):
        return 0.0
    grid = float(1 << 40)
    hi, lo = outer_products(vectors.select("__x"), len(w.values), lambda x: np.round(w.project(x)[0] * grid).astype(np.int64))
    return float(np.abs((hi + lo) / grid / grid / w.n - np.eye(len(w.values))).max())


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 16) -> DataFrame:
    """(keep, component, n, deviation, whitened, explained, identity_error) of each row with a usable vector and each component.

    Vectors that are null or empty or hold a null or an entry that is not finite take no part; of vectors of several lengths
    only those of the most frequent length (of equals the longest) do. Repeated vectors count once in the fit, and each row is
    projected. Without a vector, or without variation, there are no rows. Entries must stay below 2**40 in size; a deviation
    beyond 64 bits is null. Columns that are not in `keep` are not read.
    """
    spark = df.sparkSession
    named = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{vector}`").alias("v"))
    rows = integers(named, "v").drop("v")
    lengths = rows.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    spec = ", ".join(f"{c} {t}" for c, t in named.dtypes[:-1]) + ", component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    names = [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if lengths:
        rows = rows.where(F.size("__x") == lengths[0].d)
    distinct = cut_table(rows.select("__x").distinct())
    w = fit_whitening(distinct, components)
    if w is None or not len(w.values):
        return spark.createDataFrame([], spec).toDF(*names)
    off = identity_error(distinct, w)
    count = len(w.values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            white, deviation = w.project(_matrix(b.column(len(keep))))
            at = pa.array(np.repeat(np.arange(len(b)), count))
            far = [x if x < 1 << 63 else None for x in deviation]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(len(keep))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(b))), pa.array(np.full(len(at), w.n)), pa.array(far, pa.int64()).take(at),
                 pa.array(white.ravel()), pa.array(np.tile(w.values / w.trace, len(b))), pa.array(np.full(len(at), off))], names=[c.split()[0] for c in spec.split(", ")],
            )

    return rows.mapInArrow(each, spec).toDF(*names)
