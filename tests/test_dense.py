"""The k largest cosines against all pairs."""

import numpy as np
import pytest

from titrelake.operators import search


@pytest.mark.parametrize("a_pass, vectors", [(4096, 2048), (7, 10)])
def test_same_as_all_pairs(spark, monkeypatch, a_pass, vectors):
    monkeypatch.setattr(search, "QUERIES_A_PASS", a_pass)
    monkeypatch.setattr(search, "VECTORS", vectors)
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0]) for i in range(3)]
    bad = [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6)]
    d = spark.createDataFrame(rows + bad, "id long, embedding array<double>").repartition(5)
    q = d.where("id < 30 OR id >= 300").withColumnRenamed("id", "qid")
    got = {}
    for x in search.dense_top(q, d, "qid", "id", 10).collect():
        got.setdefault(x.qid, {})[x["rank"]] = (x.id, x.score)
    of = {i: np.array(v) for i, v in rows}
    want = {}
    for i, v in rows[:30] + rows[300:]:
        if not np.any(v):
            continue
        s = [(-round(float(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))), 9), j) for j, w in of.items() if len(w) == len(v) and np.any(w)]
        want[i] = {k + 1: (j, -x) for k, (x, j) in enumerate(sorted(s)[:10])}
    assert got == want


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert search.dense_top(d.limit(0).withColumnRenamed("id", "q"), d, "q", "id", 3).count() == 0
    assert search.dense_top(d.withColumnRenamed("id", "q"), d.limit(0), "q", "id", 3).count() == 0
