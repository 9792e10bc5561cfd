"""The ten tools, the command line, published tables and gated metrics."""

import json

import pytest
from pyspark.sql import functions as F

from titrelake import cli, tools
from titrelake import queries as q
from titrelake.functions import text as tx
from titrelake.operators import cohorts, comparability, evidence, search
from titrelake.plans import agent, evaluation, strategy
from titrelake.sources import readers

TABLE = {
    "consortia": [
        {"name": "ONE", "registration": "N1", "study_design": "x", "upper_airway_verbatim": ["Swab A", "Strip"], "lower_airway_verbatim": ["Scope"], "assays_verbatim": ["IgG/IgA", "Cells"], "platforms_verbatim": [], "objectives_verbatim": ["a"]},
        {"name": "TWO", "study_design": "y", "upper_airway_verbatim": ["Strip"], "lower_airway_verbatim": [], "assays_verbatim": ["IgG/IgA", "Neut"], "platforms_verbatim": ["P"], "objectives_verbatim": []},
    ],
    "method_mapping": {"_comment": "a remark", "Swab A": "nasal_swab", "Strip": "nasosorption", "Scope": None},
    "method_mapping_notes": {"Scope": "no sample"},
    "assay_mapping": {"_comment": "a remark", "IgG/IgA": {"assay": "multiplex_binding", "isotype": "split_IgG_IgA"}, "Cells": None, "Neut": {"assay": "neutralization", "isotype": "na"}},
    "fields_the_table_does_not_record": ["unit", "lloq"],
}
CSV = "subject_id,day,value,compartment,method,isotype,assay,unit\n" + "\n".join(f"S{s},{d},{y},{c},{m},IgA,elisa_binding,ug_ml" for c, m in (("nasal", "nasosorption"), ("serum", "serum")) for s in range(8) for d, y in ((0, 1.0), (7, 2.5 + s / 10), (14, 4.0), (28, 3.0), (90, 1.6)))


@pytest.fixture(scope="module")
def kit(spark):
    return tools.Tools(q._studies(spark))


def test_published_table(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TABLE, indent=1))
    groups, methods, assays, fields = readers.methods_table(spark, f"{tmp_path}/t.json")
    contexts, lost = cohorts.expand(groups, methods, assays)
    assert sorted(r.label for r in contexts.collect()) == ["ONE / Strip / IgG/IgA / IgA", "ONE / Strip / IgG/IgA / IgG", "ONE / Swab A / IgG/IgA / IgA", "ONE / Swab A / IgG/IgA / IgG", "TWO / Strip / IgG/IgA / IgA", "TWO / Strip / IgG/IgA / IgG", "TWO / Strip / Neut / na"]
    assert sorted((r.cohort, r.cell, r.note) for r in lost.collect()) == [("ONE", "Cells", "no antibody quantity"), ("ONE", "Scope", "no sample")]
    s = cohorts.summary(cohorts.cross_pairs(contexts)).first()
    assert (s.n, s.undecided) == (12, 2) and "ASSAY" in s.ruled_out_by
    m = cohorts.matrix(contexts).collect()
    assert len(m) == 49 and sum(r.verdict == "self" for r in m) == 7
    assert [r.field for r in cohorts.gap_report(spark, fields).collect()] == ["unit", "lloq"]
    with pytest.raises(ValueError):
        cohorts.gap_report(spark, ["mood"])


def test_every_tool_answers_in_json(kit, spark):
    hits = kit.call("search_evidence", query="do nasal IgA responses persist")["hits"]
    assert hits and all(h["study_id"] in ("alpha", "beta") for h in hits)
    assert {s["study_id"] for s in kit.call("list_studies")} == {"alpha", "beta", "gamma"}
    assert kit.call("studies_by_tag", tag="kinetics") == {"tag": "kinetics", "studies": ["beta"]}
    assert ["inactivated", "serum"] in kit.call("evidence_gaps")["gaps"]
    base = {"compartment": "nasal", "method": "nasosorption", "isotype": "IgA", "assay": "elisa_binding", "unit": "ug_ml"}
    r = kit.call("check_comparability", context_a=base, context_b=base | {"unit": "ng_ml"})
    assert (r["verdict"], r["flags"][0]["code"]) == ("conditional", "UNIT_CONVERTIBLE")
    assert "Visits:" in kit.call("propose_strategy", scenario_text=cli.SCENARIO)
    tasks = kit.call("generate_roadmap", scenario_text=cli.SCENARIO)
    assert tasks[0]["task_id"].startswith("T") and {"lab lead", "biostatistician"} & {t["owner"] for t in tasks}
    fit = kit.call("fit_kinetic_curve", csv_text="subject_id,day,value\n" + "\n".join(x.split(",nasal")[0] for x in CSV.split("\n")[1:41]), n_boot=30)
    assert fit["identifiable"] and 5 < fit["peak_day"] < 40 and fit["n_subjects"] == 8
    report = kit.call("comparability_report", csv_text=CSV)
    assert len(report["matrix"]) == 2 and report["problems"][0]["flags"][0] == "COMPARTMENT"
    assert kit.call("synthetic_demo", n_per_arm=2).count("\n") == 2 * 2 * 37 + 1
    json.dumps([hits, tasks, fit, report, r])
    with pytest.raises(ValueError):
        kit.call("drop_everything")


def test_hybrid_search_uses_both_rankings(spark):
    docs = spark.createDataFrame([("a", "nasal swab recovery", "finding", ["t"], True), ("b", "serum titre", "finding", [], True), ("c", "nasal swab", "abstract", [], False)], "id string, text string, kind string, tags array<string>, citable boolean")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1])], "id string, embedding array<double>")
    ask = spark.createDataFrame([(0, "nasal swab", [0.0, 1.0])], "qid int, text string, embedding array<double>")
    only = search.hybrid(ask, docs, "qid", "id").collect()
    assert [r.id for r in only] == ["a"] and only[0].fused == pytest.approx(1 / 62)  # "c" is closer but may not be cited
    both = {r.id: r.fused for r in search.hybrid(ask, docs, "qid", "id", vectors=vectors).collect()}
    assert set(both) == {"a", "b"} and both["b"] == pytest.approx(1 / 61) and both["a"] > both["b"]
    every = {r.id for r in search.hybrid(ask, docs, "qid", "id", citable_only=False).collect()}
    assert every == {"a", "c"}


def test_gates_and_gold_set(spark, tmp_path):
    gold = {"cases": [{"query": "do responses persist", "relevant": ["sheikhmohamed2022_f2"]}, {"query": "absorptive strips recover more", "relevant": ["tsunetsugu2022_f1"]}]}
    (tmp_path / "g.json").write_text(json.dumps(gold))
    studies = q._studies(spark)
    rows = {r["name"]: r for r in evaluation.run_all(studies, readers.gold_set(spark, f"{tmp_path}/g.json"), fast=True).collect()}
    assert set(rows) == set(evaluation.THRESHOLDS)
    assert all(rows[k].passed for k in ("recall_at_5", "accepted", "fakes_rejected", "accuracy"))


def test_kept_and_dropped_quotes(spark):
    d = spark.createDataFrame([("a b c d e", "x a b c d e y"), ("not there", "x")], "quote string, source string")
    kept, dropped, rate = evidence.verified(d)
    assert kept.count() == 1 and dropped.first().score == 0.0 and rate.first().rate == 0.5
    assert evidence.verified(d.limit(0))[2].first().rate == 1.0


def test_folder_of_records(spark, tmp_path):
    for i, name in enumerate(("b.json", "a.json")):
        (tmp_path / name).write_text(json.dumps({"pmid": str(i), "pmcid": f"P{i}", "title": "T", "pubYear": "2020", "abstractText": "A."}))
    (tmp_path / "P0.xml").write_text("<article><body><sec><title>S</title><p>Text</p></sec></body></article>")
    docs = readers.literature_folder(spark, str(tmp_path)).collect()
    assert [r.file for r in docs] == ["a.json", "b.json"] and [s.text for s in docs[1].sections] == ["Text"]
    assert readers.literature_folder(spark, str(tmp_path), 1).count() == 1


def test_small_frames(spark, sf):
    m = q.measurements(spark, sf)
    levels = comparability.level_map(m).collect()
    n = len({r.key_a for r in levels})
    assert len(levels) == n * n and {r.level for r in levels if r.key_a == r.key_b} == {0}
    plan = agent.run(cli.SCENARIO, q._studies(spark)).plan
    shown = strategy.visit_schedule(spark, plan).collect()
    assert [r.day for r in shown] == plan.days and {r.kind for r in shown if r.day in plan.mandatory} == {"mandatory"}
    d = spark.createDataFrame([(["IgA", "IgX", None],)], "v array<string>")
    assert d.select(tx.known(F.col("v"), ["IgA"]).alias("k")).first().k == ["IgA"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "m.csv").write_text(CSV)
    out = ["--out", f"{tmp_path}/out"]
    cli.main([*out, "schema"])
    cli.main([*out, "synth", "--n", "2"])
    cli.main([*out, "audit", f"{tmp_path}/m.csv"])
    cli.main([*out, "search", "nasal IgA", "--k", "2"])
    cli.main([*out, "graph"])
    cli.main([*out, "tool", "list_studies"])
    cli.main([*out, "eval"])
    said = capsys.readouterr().out
    assert "13 schemas" in said and "148 synthetic rows" in said and "COMPARTMENT" in said and '"study_id": "alpha"' in said and "FAIL" not in said
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_models_only_add_what_holds(spark):
    from titrelake.plans import scenario
    from titrelake.sources.connectors import Model

    text = "LAIV nasal spray, 20 adults, influenza"
    plain = scenario.read(spark, text)
    assert scenario.read_with(Model(), spark, text) == (plain, "rules")
    assert scenario.read_with(Model(lambda p: "sorry"), spark, text) == (plain, "rules")
    got, mode = scenario.read_with(Model(lambda p: 'Sure: {"route": "inhaled", "platform": "magic", "max_visits": 9, "n_participants": "many", "dose_days": [28, 0]}'), spark, text)
    assert (got.route, got.platform, got.max_visits, got.n_participants, got.dose_days, mode) == ("inhaled", plain.platform, 9, 20, (0, 28), "model")
    docs = spark.createDataFrame([("d1", "c", 2020, None, None, None, "Nasal IgA peaked on day 14 in most of the adults.", ""), ("d2", "c", 2020, None, None, None, "Serum IgG antibody titres persisted for six months in adults.", "")], "doc_id string, citation string, year int, doi string, pmid string, url string, abstract string, full_text string").withColumn("full_text", F.col("abstract"))

    def answer(prompt):
        if "day 14" not in prompt:
            return "no"
        return json.dumps({"findings": [{"statement": "s", "quote": "Nasal IgA peaked on day 14", "tags": ["kinetics", "gossip"]}, {"statement": "t", "quote": "Serum rose tenfold", "tags": []}]})

    rows = {r.study_id: r for r in evidence.extract_with(Model(answer), docs).collect()}
    assert [(f.quote, f.tags, f.level) for f in rows["auto_d1"].findings] == [("Nasal IgA peaked on day 14", ["kinetics"], "llm_extracted")]
    assert [f.level for f in rows["auto_d2"].findings] == ["extractive_auto"]
    assert evidence.extract_with(Model(), docs).collect() == evidence.extract(docs).collect()
