"""Operators against golden values and DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from titrelake import queries as q
from titrelake.functions import text as tx
from titrelake.functions.quotes import verify
from titrelake.operators import comparability, kinetics, search
from titrelake.operators import measurements as ms
from titrelake.operators.design import optimal_days
from titrelake.plans import agent, evaluation, scenario
from titrelake.sources import synthetic
from titrelake.sources.sinks import schemas


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_oracle(spark, duck, sf, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab1 -É\n", max_size=12) | st.none(), max_size=8), st.lists(st.text("Ab1 -é\n", max_size=7) | st.none(), max_size=6))
def test_containing_equals_brute_force(spark, docs, passages):
    docs = [*docs, "One long word-list, ab 1 AB", "x"]
    passages = [*passages, "long word-list", "ab", None, "g word-list, ab 1"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = {(i, j) for i, a in enumerate(passages) for j, b in enumerate(docs) if a is not None and b is not None and a.lower() in b.lower()}
    got = [tuple(r) for r in search.containing(p, d, "item_id", "doc_id").collect()]
    assert sorted(got) == sorted(want)


def test_small_is_checked(spark):
    plan = lambda n: search.small(spark.range(5), n)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)


def test_golden_pairs_and_symmetry(spark):
    pairs = evaluation.golden_pairs(spark)
    assert comparability.compare(pairs).where("verdict <> expected").count() == 0
    swapped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "expected")
    assert comparability.compare(swapped).where("verdict <> expected").count() == 0


def test_demo_counts(spark):
    d = synthetic.demo(spark)
    assert d.count() == 2220 and d.select("subject_id").distinct().count() == 60
    v = comparability.verdicts(d).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in v} == {2: 14, 1: 1}


def test_fit_recovers_and_refuses(spark):
    s = (synthetic.Series("nasal_iga", "nasosorption", "nasal", "IgA", "elisa_binding", "ug_ml", synthetic.DENSE),)
    d = synthetic.arm(spark, "A", "laiv_like", s, n=40, seed=5)
    r = kinetics.fits(d, ["arm_id"], n_boot=30).first()
    assert r.identifiable and abs(r.peak_day - 14) / 14 < 0.4 and r.ci_peak_day.lo <= r.ci_peak_day.hi
    few = kinetics.fits(d.where("day in (0, 7, 28)"), ["arm_id"], n_boot=5).first()
    assert not few.identifiable and few.n_timepoints == 3


def test_fit_is_exact_on_noiseless_days():
    t = np.array([0, 3, 7, 14, 28, 60, 120, 180.0])
    theta = np.log([2.0, 9.0, 0.2, 0.02])
    y, _ = kinetics.model(theta, t)
    got = kinetics.fit(t, np.ones_like(t), y)
    assert np.allclose(kinetics.model(got, t)[0], y, atol=1e-3)


def test_fold_rise_needs_baseline(spark):
    d = spark.createDataFrame([("s", 0.0, 2.0), ("s", 0.0, 4.0), ("s", 7.0, 9.0), ("t", 7.0, 5.0), ("u", 0.0, None)], "subject_id string, day double, value double")
    got = {(r.subject_id, r.day, r.value): r.fold_rise for r in ms.fold_rise(d).collect()}
    assert got == {("s", 0.0, 2.0): 2 / 3, ("s", 0.0, 4.0): 4 / 3, ("s", 7.0, 9.0): 3.0}


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"[a-z]{2,18}", fullmatch=True))
def test_stem_is_idempotent(word):
    once = tx.stem_word(word)
    assert tx.stem_word(once) == once or len(word) > 15


def test_stem_column_equals_function(spark):
    words = ["comparability", "studies", "responses", "compare", "vaccinations", "peaks", "being", "as", "readily"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == {w: tx.stem_word(w) for w in words}


def test_quotes():
    source = "Nasal IgA did not rise — in most adults. Serum ﬁndings were similar."
    assert verify("nasal  IgA did not rise - in most adults.", source) == (True, 1.0)
    assert not verify("Nasal IgA did rise in most adults, as reported by everyone.", source)[0]
    assert not verify("", source)[0]
    assert verify("Serum findings were similar", source)[0]


def test_timeframes(spark):
    cases = {"Day 28": [28], "Days 0, 7 and 28": [0, 7, 28], "6 months post-vaccination": [180], "2 weeks after dose 2": [14], "no timepoint here": []}
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", tx.timeframe_days(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases


def test_scenario(spark):
    s = scenario.read(spark, "40 healthy adults, LAIV nasal spray against influenza versus injection, 5 visits, 12 months follow-up, durability")
    assert (s.n_participants, s.route, s.platform, s.pathogen, s.max_visits, s.follow_up_days, s.comparator_route) == (40, "intranasal", "live_attenuated", "influenza", 5, 360, "intramuscular")


def test_agent_repairs_once(spark):
    st_ = agent.run("LAIV given intranasally, 3 visits, 90 days follow-up, durability, influenza", q._studies(spark))
    assert st_.revisions == 1 and st_.plan.days == [0, 7, 28, 180] and st_.trace[-1] == "report"


def test_design_keeps_mandatory_days():
    days, value = optimal_days("intranasal", "live_attenuated", 180, 6, [0, 7])
    assert {0, 7} <= set(days) and len(days) == 6 and np.isfinite(value)


def test_contract_and_schemas(spark):
    with pytest.raises(ValueError):
        ms.with_contract(spark.createDataFrame([("a",)], "subject_id string"))
    assert len(schemas()) == 13
