"""Checks of what people and models hand in: designs, contexts, readings of a scenario; the evidence base as a resource."""

import json
from dataclasses import replace

import pytest

from titrelake import cli, tools
from titrelake.operators.comparability import unknown_values
from titrelake.plans import scenario, strategy
from titrelake.schema import TRIAL
from titrelake.sources.connectors import Model


def end(i, compartment, method):
    return (i, i, compartment, method, "IgA", "elisa_binding", "ug_ml", "none", "flu", False)


def test_faults_of_designs(spark):
    rows = [
        ("good", [0], 18, 64, 30, 6, 180, [(0, "serum", 0), (28, "serum", 1)], [end("a", "serum", "serum")]),
        ("bad", [0], 18, 64, 30, 6, 100, [(0, "serum", 0), (180, "serum", 3), (120, "saliva", 3), (180, "saliva", 3)], [end("a", "nasal", "nasal_wash"), end("b", "oral", "serum"), end("c", "oral", None)]),
        ("bare", None, None, None, None, None, None, None, None),
        ("open", None, None, None, None, None, None, [(9, "serum", 0)], [end("a", "serum", "serum")]),
    ]
    got = {r["name"]: r.faults for r in strategy.trial_faults(spark.createDataFrame(rows, TRIAL)).collect()}
    assert got == {"good": [], "bare": [], "open": [], "bad": ["endpoints never sampled: a, c", "endpoints in the wrong compartment: b", "sampling after follow-up on days 120, 180"]}
    assert strategy.trial_faults(spark.createDataFrame([], TRIAL)).count() == 0


def test_a_plan_becomes_a_design(spark):
    s = scenario.read(spark, cli.SCENARIO)
    plan = strategy.propose(s, cli._studies(spark, None), use_design=False)
    d = strategy.trial_design(plan, spark).first()
    assert d["name"] == f"candidate-{s.name}" and {v.day for v in d.sampling} == set(plan.days) and {v.method for v in d.sampling} == set(plan.methods)
    assert [e.endpoint_id for e in d.endpoints] == [e["endpoint_id"] for e in plan.endpoints]
    with pytest.raises(ValueError, match="never sampled: nasal_siga"):
        strategy.trial_design(replace(plan, methods=["serum"]), spark)
    with pytest.raises(ValueError, match="after follow-up"):
        strategy.trial_design(replace(plan, scenario=scenario.changed(s, follow_up_days=10)), spark)


def test_unknown_values(spark):
    rows = [("nasal", "nasosorption", ""), ("nose", "nasosorption", "none"), ("nose", None, "magic"), (None, "", None)]
    d = spark.createDataFrame(rows, "compartment string, method string, normalization string")
    assert {(r.field, r.value, r.n) for r in unknown_values(d).collect()} == {("compartment", "nose", 2), ("method", "", 1), ("normalization", "magic", 1)}
    assert unknown_values(spark.range(3).toDF("x")).count() == 0 and unknown_values(d.limit(0)).count() == 0


def test_tools_refuse_unknown_contexts_and_give_the_evidence(spark):
    kit = tools.Tools(cli._studies(spark, None))
    base = {"compartment": "nasal", "method": "nasosorption", "isotype": "IgA", "assay": "elisa_binding", "unit": "ug_ml"}
    with pytest.raises(ValueError, match="compartment=nose"):
        kit.call("check_comparability", context_a=base, context_b=base | {"compartment": "nose"})
    assert kit.call("check_comparability", context_a=base, context_b=base | {"lab": "elsewhere"})["level"] == 1
    whole = kit.resource("evidence://studies")
    assert [s["study_id"] for s in whole] == ["alpha", "beta", "gamma"] and json.loads(json.dumps(whole)) == whole
    with pytest.raises(ValueError, match="no resource"):
        kit.resource("evidence://other")


def test_both_readings_of_a_scenario(spark):
    text = "LAIV nasal spray, 20 adults, influenza"
    none = scenario.compare_readers(Model(), spark, text)
    assert (none["ran"], none["model"], none["error"], none["rules"]["n_participants"]) == (False, None, "no model", 20)
    got = scenario.compare_readers(Model(lambda p: '{"route": "inhaled", "n_participants": 20, "max_visits": 9}'), spark, text)
    assert got["ran"] and got["differences"] == ["route", "max_visits"] and got["model"]["route"] == "inhaled"
    assert scenario.compare_readers(Model(lambda p: "sorry"), spark, text)["error"] == "no usable answer"

    def gone(prompt):
        raise OSError("gone")

    assert scenario.compare_readers(Model(gone), spark, text)["error"] == "gone"
