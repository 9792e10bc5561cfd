"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more component, sqrt(M - |v|^2) with M the largest squared norm, so that all have the same norm
and the largest inner product is the least distance to the query (whose extra component is 0). Each vector is
keyed by its nearest pivot and its distance to it; a cell is a ring (annulus) around a pivot, or a part of a ring
with many rows. For a query q and a ring [lo, hi] around p, the triangle inequality bounds the distance to all of
the ring by the gap between d(q, p) and [lo, hi]; the ring's least and largest distances from some other pivots give
bounds of the same kind. Rings are visited in the order of their bounds, in rounds; the k-th distance found so far stops
the expansion.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantise(df: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<bigint>) with floor(scale * x) for each component; rows with a null id, vector or component
    or a component that is not finite are left out."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles if no sum can pass 2**53, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return np.stack([(v * row).sum(axis=1) for row in q])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in order."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over = np.flatnonzero(score > least)
        even = np.flatnonzero(score == least)
        even = even[np.argsort(ids[even], kind="stable")][: k - len(over)]
        at = np.concatenate([over, even])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))]


def _found(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b, c = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of up to n rows."""
    if not len(sample):
        return sample[:0].astype(float)
    rows = sample.astype(float)
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def search(df: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", pivots: int | None = None, sample: int = 2048, cell: int = 1024, block: int = 512, growth: int = 4, scored: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with vec_id divisible by `every` its k best other rows.

    Ties go to the smaller vec_id; fewer rows than k give all. Shorter vectors count as padded with zeros. Rows
    that repeat a vec_id are candidates of their own, but never of a query with that id, and a repeated query id is
    one query (its first vector in order). Pivots come from `sample` rows (by hash of the id), a bounded sample, and grow
    with the rows (a quarter of their root, 32 to 512); every row is indexed and every result is exact. Scores are exact
    within 64-bit integers. Columns other than vec_id and the vector are not read; an empty table gives an empty result.

    Each query visits the annuli in the order of their bounds, first two, then `growth` times as many as before, as long
    as a bound is within the distance of its k-th score so far. scored: a list that gets, for each round, the number of
    (query, row) pairs in the visited annuli.
    """
    spark = df.sparkSession
    rows = cut(quantise(df, vector))
    most = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: F.greatest(a, F.abs(e)))), F.count(F.lit(1))).first()
    if most[0] is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim, top, pivots = max(1, most[0]), float(most[1] or 0), pivots or min(512, max(32, isqrt(most[3]) // 4))
    kind = next(t for t in (np.int16, np.int32, np.int64) if (most[2] or 0) <= np.iinfo(t).max)  # of what moves
    wide = rows.select("vec_id", F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0).cast("long"), dim - F.size("v")))).otherwise(F.col("v")).alias("v"))
    seed = np.array([r.v for r in wide.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()], dtype=np.int64).reshape(-1, dim)

    def lift(v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x**2).sum(axis=1)))])

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T))

    around = pick_pivots(lift(seed), pivots)
    marks = min(16, len(around))  # pivots whose distances bound every annulus, besides its own
    width = max(1e-9, 2 * np.sqrt(top) / 64)  # of a ring; distances are at most twice the norm

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            if len(part):
                x = lift(np.array(part["v"].tolist(), dtype=np.int64).reshape(-1, dim))
                d = apart(x, around)
                near = d.argmin(axis=1)
                far = d[np.arange(len(d)), near]
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "pivot": near, "ring": (far / width).astype(int)})

    keyed = cut(wide.mapInPandas(place, "vec_id bigint, v array<bigint>, pivot int, ring int"))
    # thin rings are few (pivots times 65 or so), so their sizes can be joined by broadcast whatever the input;
    # neighbouring thin rings join into annuli of about `cell` rows
    thin = keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pivot").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = thin.withColumn("annulus", F.floor(before / cell).cast("int")).withColumn("n", F.sum("n").over(Window.partitionBy("pivot", "annulus")))
    parts = keyed.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("ring", F.col("annulus")).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / (2 * cell))).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        v, own = np.array(part["v"].tolist(), dtype=np.int64), int(part["pivot"].iloc[0])
        d = apart(lift(v), np.vstack([around[:marks], around[own : own + 1]]))
        return pd.DataFrame([(own, int(part["ring"].iloc[0]), int(part["part"].iloc[0]), len(v), part["vec_id"].to_numpy(np.int64).tobytes(), v.astype(kind).tobytes(), d.min(axis=0).tolist(), d.max(axis=0).tolist())], columns=["pivot", "ring", "part", "n", "ids", "vs", "lo", "hi"])

    index = cut(parts.groupBy("pivot", "ring", "part").applyInPandas(pack, "pivot int, ring int, part int, n bigint, ids binary, vs binary, lo array<double>, hi array<double>"))
    ends = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(marks + 1)]
    shells = index.groupBy("pivot", "ring").agg(F.max("part").alias("last"), F.sum("n").alias("n"), *ends).orderBy("pivot", "ring").collect()  # at most pivots times 66 rows
    shell = np.array([tuple(r)[:4] for r in shells], dtype=np.int64)
    low, high = (np.array([tuple(r)[4 + i * (marks + 1) : 4 + (i + 1) * (marks + 1)] for r in shells], dtype=float) for i in (0, 1))

    first = keyed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "pivot")).alias("q")).select("vec_id", "q.v", "q.pivot")
    counts = first.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    split = cut(first.join(F.broadcast(counts), "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / block)).cast("int")))

    def bundle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        return pd.DataFrame([(int(part["pivot"].iloc[0]), int(part["block"].iloc[0]), part["vec_id"].to_numpy(np.int64).tobytes(), np.array(part["v"].tolist(), dtype=np.int64).astype(kind).tobytes())], columns=["pivot", "block", "qids", "qs"])

    blocks = cut(split.groupBy("pivot", "block").applyInPandas(bundle, "pivot int, block int, qids binary, qs binary"))

    def due(part: pd.DataFrame, start: int, end: int) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray]]:
        """For each block of queries: which query visits which annulus as one of its start-th to end-th nearest, and the
        queries' k-th scores so far (the least number where there are fewer)."""
        for row in part.itertuples():
            v = np.frombuffer(row.qs, kind).reshape(-1, dim).astype(float)
            least = {e["query_id"]: e["least"] for e in row.limits} if row.limits is not None else {}
            so_far = [least.get(int(q)) for q in np.frombuffer(row.qids, np.int64)]
            s = np.array([-np.inf if x is None else x for x in so_far])
            reach = np.sqrt(np.maximum(0.0, (v**2).sum(axis=1) + top - 2 * s)) * (1 + 1e-9) + 1e-6  # ties are not cut off
            on = []
            for i in range(0, len(v), 64):  # few at a time: rings are up to some ten thousand
                d = apart(np.column_stack([v[i : i + 64], np.zeros(len(v[i : i + 64]))]), around)
                bound = np.maximum(0.0, np.maximum(low[:, marks][None] - d[:, shell[:, 0]], d[:, shell[:, 0]] - high[:, marks][None]))
                for m in range(marks):
                    np.maximum(bound, np.maximum(low[:, m][None] - d[:, m, None], d[:, m, None] - high[:, m][None]), out=bound)
                place_of = bound.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                on.append((place_of >= start) & (place_of < end) & (bound <= reach[i : i + 64, None]))
            yield row, np.concatenate(on), np.array([np.iinfo(np.int64).min if x is None else x for x in so_far], dtype=np.int64)

    def visit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each (block of queries, cell): for each query what is no worse than its k-th score so far, the k best at most."""
        for part in it:
            out = []
            for qids, qs, least, ids, vs in zip(part["qids"], part["qs"], part["least"], part["ids"], part["vs"]):
                qids, ids = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                scores = _products(*(np.frombuffer(x, kind).reshape(-1, dim).astype(np.int64) for x in (qs, vs)))
                good = (scores >= np.frombuffer(least, np.int64)[:, None]) & (qids[:, None] != ids)
                many = good.sum(axis=1) > k
                rows, cols = np.nonzero(good & ~many[:, None])
                out.append((qids[rows], ids[cols], scores[rows, cols]))
                for i in np.flatnonzero(many):
                    on = np.flatnonzero(good[i])
                    on = on[_best(scores[i, on], ids[on], k)]
                    out.append((np.full(len(on), qids[i]), ids[on], scores[i, on]))
                if sum(len(x[0]) for x in out) >= 50_000:
                    yield _found(out)
                    out = []
            if out:
                yield _found(out)

    def kept(found: DataFrame) -> DataFrame:
        """The k best of what was found for each query, in order."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    visit_of = ["pivot", "ring", "part", "qids", "qs", "least"]
    best, start, end = None, 0, 2
    while start < len(shell):
        if best is None:
            todo = blocks.withColumn("limits", F.lit(None).cast("array<struct<query_id:bigint,least:bigint>>"))
        else:
            full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            limits = split.select(F.col("vec_id").alias("query_id"), "pivot", "block").join(full, "query_id").groupBy("pivot", "block").agg(F.collect_list(F.struct("query_id", "least")).alias("limits"))
            todo = blocks.join(limits, ["pivot", "block"], "left")

        def count(it: Iterator[pd.DataFrame], start: int = start, end: int = end) -> Iterator[pd.DataFrame]:
            for part in it:
                yield pd.DataFrame({"n": [int((on * shell[:, 3]).sum()) for _, on, _ in due(part, start, end)]}, dtype="int64")

        def expand(it: Iterator[pd.DataFrame], start: int = start, end: int = end) -> Iterator[pd.DataFrame]:
            for part in it:
                for row, on, least in due(part, start, end):
                    ids, v, out = np.frombuffer(row.qids, np.int64), np.frombuffer(row.qs, kind).reshape(-1, dim), []
                    for j in np.flatnonzero(on.any(axis=0)).tolist():
                        own = on[:, j]
                        queries = ids[own].tobytes(), v[own].tobytes(), least[own].tobytes()
                        out += [(int(shell[j, 0]), int(shell[j, 1]), p, *queries) for p in range(int(shell[j, 2]) + 1)]
                        if len(out) >= 64:  # a frame for each would cost more than the visits
                            yield pd.DataFrame(out, columns=visit_of)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=visit_of)

        pairs = todo.mapInPandas(count, "n bigint").agg(F.sum("n")).first()[0] or 0
        if not pairs:  # the next annuli are beyond every query's reach, so those after them are too
            break
        if scored is not None:
            scored.append(pairs)
        visits = todo.mapInPandas(expand, "pivot int, ring int, part int, qids binary, qs binary, least binary")
        found = visits.join(index, ["pivot", "ring", "part"]).select("qids", "qs", "least", "ids", "vs").mapInPandas(visit, FOUND)
        best = cut(kept(found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))))
        start, end = end, end + growth * (end - start)
    if best is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
