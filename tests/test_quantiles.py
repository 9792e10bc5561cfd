"""Exact quantiles of groups of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrelake.operators import quantiles as qs
from titrelake.operators.measurements import fold_quartiles, median_by_day

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def frame(spark):
    r = random.Random(0)
    rows = [(g, None, r.lognormvariate(0, 5)) for g in "ab" for _ in range(900)]
    rows += [("a", "x", r.choice([-1.0, 0.0, 2.5])) for _ in range(700)]  # few distinct values
    rows += [(None, "x", s * 10.0 ** r.uniform(-3, 300)) for s in (-1, 1) for _ in range(400)]
    rows += [("inf", "x", v) for v in [float("inf"), float("-inf"), *map(float, range(300))]]
    rows += [("same", "x", 7.25)] * 500 + [("one", "x", 1.0), ("none", "x", None), ("none", "x", float("nan")), ("a", "x", float("nan"))]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "g string, h string, v double").repartition(7)


def plain(df):
    out = {}
    for g, h, v in df.toPandas().itertuples(index=False):
        if v is not None and not np.isnan(v):
            out.setdefault((g, h), []).append(v)
    return out


@pytest.mark.parametrize("limit, bins, few", [(10**6, 4096, 10**5), (0, 64, 40), (600, 4096, 10)])
def test_same_as_sorting(spark, monkeypatch, limit, bins, few):
    monkeypatch.setattr(qs, "BINS", bins)
    monkeypatch.setattr(qs, "FEW", few)
    d = frame(spark)
    want = plain(d)
    got = {(r.g, r.h): r for r in qs.quantiles(d, ["g", "h"], "v", PROBS, limit=limit).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k].n == len(v)
        finite = k[0] != "inf"
        with np.errstate(invalid="ignore"):
            assert np.allclose(got[k].q[1:4], np.quantile(v, PROBS[1:4]), rtol=1e-12) or not finite
        assert got[k].q[0] == min(v) and got[k].q[-1] == max(v)


def test_same_bits_as_the_built_in(spark, monkeypatch):
    monkeypatch.setattr(qs, "FEW", 20)
    d = spark.range(5000).select((F.col("id") % 3).alias("g"), F.randn(1).alias("v"))
    q = lambda limit: sorted(map(tuple, qs.quantiles(d, ["g"], "v", PROBS, limit=limit).collect()))
    assert q(10) == q(10**6)


def test_a_huge_group_is_searched_in_rounds(spark):
    """Ten million distinct values in one group; no task holds more than a share of them."""
    d = spark.range(10_000_000).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7_368_787, F.lit(10_000_019)) / 8).alias("v"))
    r = qs.quantiles(d, ["g"], "v", [0.5], limit=1_000_000).first()
    values = np.sort(np.arange(10_000_000, dtype=np.int64) * 7_368_787 % 10_000_019) / 8
    assert r.n == 10_000_000 and r.q[0] == np.median(values)


def test_summaries_do_not_depend_on_the_limit(spark, sf, monkeypatch):
    from titrelake.queries import measurements

    m = measurements(spark, sf)
    run = lambda: (sorted(map(str, fold_quartiles(m).collect())), sorted(map(str, median_by_day(m, ["compartment", "arm_id"]).collect())))
    plain_ = run()
    monkeypatch.setattr(qs.quantiles, "__defaults__", (5,))
    monkeypatch.setattr(qs, "FEW", 3)
    assert run() == plain_


def test_edges(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert qs.quantiles(empty, ["g"], "v", [0.5]).count() == 0 == qs.quantiles(empty, ["g"], "v", [0.5], limit=-1).count()
