"""The pivot index leaves out what its bounds allow, and nothing else."""

import duckdb
import numpy as np
import pytest

from titrelake.llm import topk


def test_bounds_leave_out_far_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.02 * rng.normal(size=(100, 8)) for c in centres])
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    scored = []
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), pivots=24, cell=16, block=8, scored=scored).collect()
    v = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    for q in range(0, len(v), 20):
        want = sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted((g for g in got if g.query_id == q), key=lambda r: r.rank)] == want
    assert sum(scored) < 0.6 * 60 * len(v)


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "cell": 40, "block": 3, "growth": 2}])
def test_query_equals_sql(spark, sf, options):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE})").fetchall()
    got = topk.search(spark.read.parquet(f"{sf}/embeddings.parquet"), **options).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hot_vector_and_large_components(spark):
    rows = [(i, [0.5, 0.5, 0.0]) for i in range(300)] + [(i, [1e4 * (i % 7), float(i), -1.0]) for i in range(300, 340)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=16, block=4).collect()
    v = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    for q in range(0, 340, 20):
        want = sorted((-int(v[q] @ v[i]), i) for i in range(340) if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted((g for g in got if g.query_id == q), key=lambda r: r.rank)] == want
