"""What roadmap_with_fits does with each row of its measurements: once, and without sorting them."""

import numpy as np

from titrelake import queries as q
from titrelake.operators import comparability, kinetics
from titrelake.plans import agent, roadmap


def test_contexts_are_first_reduced_by_hash(spark, sf):
    plan = comparability.contexts(q.measurements(spark, sf))._jdf.queryExecution().sparkPlan().toString()
    assert plan.splitlines()[-1].count("FileScan") and "HashAggregate" in [line for line in plan.splitlines() if "Aggregate" in line][-1]


def test_context_is_of_first_row(spark):
    rows = [(3, "nasal", "HA", 1.0), (1, "nasal", "NA", 2.0), (2, "nasal", "HA", 3.0), (4, None, "", None)]
    got = comparability.contexts(spark.createDataFrame(rows, "row_ord long, compartment string, antigen string, lloq double"))
    assert {(r.series_ord, r.compartment, r.antigen, r.lloq) for r in got.collect()} == {(1, "nasal", "NA", 2.0), (4, None, "unspecified", None)}


def test_measurements_are_read_once(spark, sf):
    studies = q._studies(spark)
    none = spark.createDataFrame([], "compartment string, method string, half_life_days double, ci_half_life struct<lo: double, hi: double>")
    tasks = roadmap.build(agent.run(q._ROADMAP_SCENARIO, studies), studies, q.measurements(spark, sf), none)
    assert "events.parquet" not in tasks._jdf.queryExecution().optimizedPlan().toString()
    assert not any("events.parquet" in f for f in tasks.inputFiles())


def test_shares_of_all_buckets_add_up():
    sizes = np.array([5, 0, 7, 2048, 1])
    got = kinetics.shares(sizes, 9, 3)
    assert (got.sum(axis=0) == sizes.sum()).all() and not got[1].any()
    assert all((kinetics.draws(sizes, k, 9, 3) == got[k]).all() for k in range(5))


def test_fits_without_medians_are_the_same_fits(spark):
    rows = [(f"s{i}", float(d), 1.0 + 10 * (d / 14) * 2.718 ** (1 - d / 14) + i / 50, "x") for i in range(12) for d in (0, 3, 7, 14, 28, 60)] + [("s0", 0.0, 4.0, "y")]
    m = spark.createDataFrame(rows, "subject_id string, day double, value double, a string")
    whole, bare = ({r.a: r for r in kinetics.fits(m, ["a"], n_boot=30, raw=raw).collect()} for raw in (True, False))
    assert whole["x"] == bare["x"] and whole["y"].baseline == 4.0 and bare["y"].baseline is None
