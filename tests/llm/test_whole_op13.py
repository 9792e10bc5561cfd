"""Whitening against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from titrelake.llm import whitening


def covariance(vectors):
    """Exact covariance of distinct integer vectors, divisor n."""
    n, d = len(vectors), len(vectors[0])
    mean = [Fraction(sum(v[i] for v in vectors), n) for i in range(d)]
    return [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in vectors) / n for j in range(d)] for i in range(d)]


def check(rows, vectors, components=16):
    """rows of the result by vec_id and component, against vectors {vec_id: floats}."""
    x = {k: tuple(math.floor(64 * c) + 1_000_000 for c in v) for k, v in vectors.items()}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    v = covariance(fit)
    s = [sum(col) for col in zip(*fit)]
    values, w = np.linalg.eigh(np.array(v, dtype=float))
    values, w = values[::-1][:components], w.T[::-1][:components]
    hold = values > 1e-12 * values[0]
    assert len(rows) == len(x) * int(hold.sum())
    got = {(r.vec_id, r.component): r for r in rows}
    for k, e in enumerate(values[hold]):
        column = np.array([got[i, k + 1].whitened for i in sorted(x)])
        want = (np.array([x[i] for i in sorted(x)]) - np.array(s) / n) @ w[k] / math.sqrt(e)
        assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-6
    for r in rows:
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.identity_error < 1e-9 and abs(r.explained / float(values[r.component - 1] / sum(v[i][i] for i in range(d))) - 1) < 1e-9


def test_split_and_sums_are_exact():
    r = np.random.default_rng(0)
    d = r.integers(-(1 << 52), 1 << 52, (5000, 3))
    assert (sum(p.astype(object) for p in whitening.split(d)) == d).all()
    hi = lo = np.zeros((3, 3))
    hi, lo = whitening.outer_sum(d, hi, lo)
    exact = d.astype(object).T @ d.astype(object)
    off = [[abs(Fraction(float(hi[i, j])) + Fraction(float(lo[i, j])) - exact[i, j]) for j in range(3)] for i in range(3)]
    assert max(map(max, off)) <= Fraction(int(abs(exact).max()), 1 << 100)


def test_against_fractions(spark):
    r = np.random.default_rng(1)
    vectors = {i: (r.normal(size=20) * np.linspace(1, 6, 20)).tolist() for i in range(120)}
    vectors |= {i: vectors[7] for i in range(120, 160)}  # copies count once in the fit
    d = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(7)
    exact = {k: [float(np.float32(c)) for c in v] for k, v in vectors.items()}
    check(whitening.whiten(d).collect(), exact)


def test_query_over_embeddings(spark, sf):
    from titrelake.llm.queries import QUERIES

    e = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    out = QUERIES["op13_whitening"](spark, sf).collect()
    assert len(out) == 16 * len(e) and max(r.identity_error for r in out) < 1e-4
    n = len({tuple(math.floor(64 * c) for c in v) for v in e.values()})
    assert {r.n for r in out} == {n}


@pytest.mark.parametrize("gap", [1e-3, 1e-9])
def test_close_eigenvalues(gap):
    r = np.random.default_rng(2)
    q, _ = np.linalg.qr(r.normal(size=(12, 12)))
    values = np.array([5 + gap, 5, *np.linspace(4, 1, 10)])
    v = (q * values) @ q.T
    got, rows = whitening.eigen(v, np.zeros_like(v))
    assert np.abs(got - values).max() < 1e-13 and np.abs(rows @ v @ rows.T - np.diag(got)).max() < 1e-13 and np.abs(rows @ rows.T - np.eye(12)).max() < 1e-14


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, -1.0], 0), (3, [0.0, 0.5], 1), (3, [0.0, 0.5], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0], 1), (None, [2.0, 2.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int").withColumnRenamed("component", "n")
    got = whitening.whiten(d).collect()
    assert len(got) == 10 and {r.vec_id for r in got} == {1, 2, 3, None} and {r.n for r in got} == {4}
    assert whitening.whiten(d.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    flat = whitening.whiten(line).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
