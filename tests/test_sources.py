"""Readers, sinks, merging, generators and the functions that results depend on."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrelake.functions import text as tx
from titrelake.functions.math import shape_to_rates
from titrelake.functions.quotes import places, verify
from titrelake.operators import comparability, design, evidence, kinetics
from titrelake.sources import readers, sinks, synthetic


@pytest.fixture(scope="module")
def csv_file(spark, tmp_path_factory):
    """A plain measurement table, as a user would bring it: no row_ord, no optional columns."""
    path = tmp_path_factory.mktemp("csv") / "m.csv"
    lines = ["subject_id,day,value,compartment,method,isotype,assay,unit"]
    for k, (m, c) in enumerate([("nasosorption", "nasal"), ("saliva", "oral"), ("serum", "serum")]):
        for s in range(12):
            for d, y in zip((0, 7, 14, 28, 90), (1, 3, 4, 3.5, 2)):
                lines.append(f"S{s},{d},{'' if (s + d) % 31 == 30 else y * (1 + 0.05 * s)},{c},{m},IgA,elisa_binding,{'au_ml' if k else 'ug_ml'}")
    path.write_text("\n".join(lines))
    return str(path)


def test_csv_to_verdicts_to_fits(spark, csv_file):
    d = readers.measurements(spark, csv_file)
    v = comparability.verdicts(d).collect()
    assert [(r.key_a.split(" | ")[0], r.key_b.split(" | ")[0]) for r in sorted(v, key=lambda r: (r.ord_a, r.ord_b))] == [("nasal", "oral"), ("nasal", "serum"), ("oral", "serum")]
    assert {r.verdict for r in v} == {"not_comparable"}
    groups = comparability.comparable_groups(d).collect()
    assert sorted(r.grp for r in groups) == [0, 1, 2]
    f = kinetics.fits(d, ["compartment"], n_boot=30).collect()
    assert len(f) == 3 and all(r.identifiable and 5 < r.peak_day < 40 and r.n_timepoints == 5 for r in f)
    again = readers.measurements_text(spark, open(csv_file).read())
    assert comparability.verdicts(again).count() == 3


def test_csv_without_a_required_column_is_refused(spark, tmp_path):
    (tmp_path / "m.csv").write_text("subject_id,day\na,1\n")
    with pytest.raises(ValueError, match="value"):
        readers.measurements(spark, f"{tmp_path}/m.csv")


def test_registry_without_secondary_outcomes(spark, tmp_path):
    record = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "outcomesModule": {"primaryOutcomes": [{"measure": "IgA", "timeFrame": "Day 28"}]}}}
    (tmp_path / "t.json").write_text(json.dumps(record))
    out = readers.registry(spark.read.json(f"{tmp_path}/t.json")).collect()
    assert [(r.nct, r.kind, r.days, r.all_days) for r in out] == [("N1", "primary", [28], [28])]


def test_literature_and_articles(spark):
    rows = [("1", "P1", "A <i>title</i>", "Doe J, Roe R", "2020", "An abstract. "), (None, "P2", None, "", "x", None)]
    d = spark.createDataFrame([(p, p, c, None, t, a, y, b) for p, c, t, a, y, b in rows], "pmid string, id string, pmcid string, doi string, title string, authorString string, pubYear string, abstractText string")
    xml = "<article><body><sec><title>One</title><p>A <b>b</b></p><sec><p>c</p></sec></sec></body></article>"
    full = spark.createDataFrame([("P1", xml), ("P2", "<broken")], "pmcid string, xml string")
    got = {r.pmcid: r for r in readers.raw_documents(d, full).collect()}
    assert got["P1"].citation == "Doe J et al. (2020). A title" and [(s.name, s.text) for s in got["P1"].sections] == [("One", "A b c")]
    assert got["P2"].citation == "Anon et al. (n.d.). " and got["P2"].sections == []


def test_articles_of_a_large_file(spark, tmp_path):
    bodies = [f"<article id='{i}'><front><article-id pub-id-type='pmc'>{'PMC' if i % 2 else ''}{i}</article-id></front><body><sec><title>T &amp; {i}</title><p>a &lt;{i} <b>x</b></p><sec><p>y</p></sec></sec></body></article>" for i in range(300)]
    bodies[7] = "<article><body><sec></body></article>"
    bodies[8] = "<article><body><p>none</p></body></article>"
    (tmp_path / "all.xml").write_text("<?xml version='1.0'?>\n<articles>\n" + "\n".join(bodies) + "\n</articles>\n")
    (tmp_path / "one.xml").write_text("<!DOCTYPE article>" + bodies[3])
    (tmp_path / "empty.xml").write_text("")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # cut within articles
    try:
        d = readers.articles(spark, f"{tmp_path}/*.xml")
        assert d.rdd.getNumPartitions() > 5
        got = d.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(got) == 301
    by = {r.pmcid: r for r in got if r.pmcid}
    assert len(by) == 298 and [tuple(s) for s in by["PMC42"].sections] == [("T & 42", "a <42 x y")] and by["PMC42"].xml is None
    odd = [r for r in got if not r.pmcid]
    assert sorted((r.sections, r.fault is None, r.xml) for r in odd if r.fault is None) == [([], True, None)]
    assert [(r.sections, r.xml) for r in odd if r.fault] == [([], bodies[7])]


def test_figures(spark):
    axis = {"label": "d", "min": 0, "max": 4, "unit": "weeks", "log_scale": False}
    fig = {"x_axis": axis, "y_axis": axis | {"unit": "titer"}, "series": [{"name": "s", "compartment_guess": None, "points": [{"x": 0, "y": 1}, {"x": 1, "y": 2}, {"x": 2, "y": 3}]}], "readable": True, "caveats": []}
    bad = fig | {"readable": False, "series": [{"name": "s", "points": [{"x": 9, "y": 1}]}]}
    d = spark.createDataFrame([(json.dumps(f),) for f in (fig, bad)], "j string").select(readers.figure(F.col("j")).alias("figure"))
    assert [len(r.faults) for r in readers.figure_faults(d).collect()] == [0, 3]
    assert [(r.day, r.value, r.compartment) for r in readers.figure_rows(d).collect()] == [(0.0, 1.0, "serum"), (7.0, 2.0, "serum"), (14.0, 3.0, "serum")]


def test_figure_report(spark):
    axis = {"label": "d", "min": 0, "max": 4, "unit": "weeks", "log_scale": False}
    points = [{"x": 0, "y": 1}, {"x": 1, "y": 2}, {"x": 2, "y": 3}]
    fig = {"x_axis": axis, "y_axis": axis | {"unit": "titer", "log_scale": True}, "series": [{"name": "s|t", "compartment_guess": None, "points": points}], "readable": True, "caveats": ["faint"]}
    d = spark.createDataFrame([("f1", json.dumps(fig)), ("f2", json.dumps(fig | {"readable": False}))], "id string, j string").select("id", readers.figure(F.col("j")).alias("figure"))
    said = sinks.figure_report(readers.figure_faults(d), "id")
    assert "| f1 | s\\|t | serum | 3 | 0.0 to 4.0 weeks | 0.0 to 4.0 titer, log |" in said and "| f1 | faint |" in said and "| f2 | not readable |" in said
    assert sinks.figure_report(readers.figure_faults(d.limit(0)), "id").count("##") == 3


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"], None)], "i int, l array<string>, s string")
    sinks.to_csv(d, f"{tmp_path}/c", single=True)
    back = spark.read.csv(f"{tmp_path}/c", header=True, escape='"').first()
    assert json.loads(back.l) == ["a", "b"]
    sinks.to_json(d, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().l == ["a", "b"]
    assert "| 1 | ['a', 'b'] |  |" in sinks.markdown(d, "T")


def test_merge_takes_new_ids_and_replaces_placeholders(spark):
    kind = "study_id string, study_ord int, level string, x int"
    base = spark.createDataFrame([("a", 0, "verified_abstract", 1), ("b", 1, "to_verify", 2)], kind)
    extra = spark.createDataFrame([("b", 0, "llm_extracted", 3), ("a", 1, "llm_extracted", 4), ("c", 2, "to_verify", 5)], kind)
    got = evidence.merge(base, extra).orderBy("study_ord").collect()
    assert [(r.study_id, r.x) for r in got] == [("a", 1), ("b", 3), ("c", 5)]


def test_mutations_are_rejected_and_quotes_accepted(spark):
    quote = "The mucosal IgA response was low and did not persist in the nasal samples of most adults"
    d = spark.createDataFrame([(quote, "Before. " + quote + ". After."), ("Serum titres rose.", "Serum titres rose.")], "quote string, source string")
    r = evidence.quote_rates(d).first()
    assert (r.accepted, r.n_quotes, r.fakes_rejected) == (1.0, 2, 1.0) and r.n_fakes == 8
    made = d.select(tx.mutations(F.col("quote")).alias("m")).first().m
    assert made[0].startswith("The systemic IgA") and made[2] == "In a randomised controlled trial, a mucosal iga response was low and did not persist in a nasal samples of most adults"
    assert made[3] == quote.replace("low", "high").replace("not", "") and made[4] == " ".join(reversed(quote.split()))


def test_places_equal_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        q, s = (" ".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 4), rng.randint(0, 30)))
        w, n = s.split(), len(q.split())
        want = [(2 * i, 2 * (i + n) - 1) for i in range(len(w) - n + 1) if Counter(w[i : i + n]) == Counter(q.split())]
        assert list(places(q, s)) == want


def test_quotes_late_in_long_texts():
    late = "word nasal antibody " * 30_000 + "the nasal antibody response as measured, peaked on day 28 in healthy adults of any age " + "and more " * 100
    assert verify("The nasal antibody response, as measured, peaked on day 28 in healthy adults of any age", late)[0]
    assert not verify("The nasal antibody response, as measured, peaked on day 82 in healthy adults of any age", late)[0]
    assert verify("???", "what???") == (True, 1.0) and verify("???", "what") == (False, 0.0)


def test_rise_rates_agree_with_the_column(spark):
    peak, half = np.meshgrid([3.0, 7, 14, 28, 40], [30.0, 60, 150, 400])
    ke = np.log(2) / half.ravel()
    ka = design.rise_rate(peak.ravel(), ke)
    d = spark.createDataFrame([(float(p), float(h)) for p, h in zip(peak.ravel(), half.ravel())], "p double, h double").select("p", "h", shape_to_rates(F.col("p"), F.col("h"), F.lit(1.0), F.lit(4.0)).alias("s"))
    want = {(r.p, r.h): r.s.ka for r in d.collect()}
    assert np.allclose(ka, [want[p, h] for p, h in zip(peak.ravel(), half.ravel())], rtol=1e-6)


def test_greedy_design_equals_determinants():
    days = [0, 3, 7, 14, 28, 90, 180]
    info = design.Information("intranasal", "live_attenuated", days, 20, 0.12, 0)
    for at in (0, 4, 2, 6):
        info.add(at)
    g = info.g[:, [0, 4, 2, 6]]
    m = np.einsum("nti,ntk->nik", g, g) + design.RIDGE * np.eye(4)
    assert info.value == pytest.approx(np.linalg.slogdet(m)[1].mean())
    got = design.compare_designs("intranasal", "live_attenuated", {"few": [0, 7, 28, 180], "more": days})
    assert got["more"] > got["few"]


def test_generator_follows_its_profile(spark):
    s = (synthetic.Series("serum_igg", "serum", "serum", "IgG", "elisa_binding", "ug_ml", (0, 24, 180), lloq=5.0, missing=0.1),)
    d = synthetic.arm(spark, "B", "iiv_im_like", s, n=3000, seed=3)
    again = synthetic.arm(spark, "B", "iiv_im_like", s, n=3000, seed=3).repartition(3)
    assert d.exceptAll(again).isEmpty()
    p = d.toPandas()
    assert abs(p.responder.mean() - 0.85) < 0.02 and p[p.day == 0].value.notna().all() and 0.07 < p[p.day > 0].value.isna().mean() < 0.13
    up = p[p.responder].pivot(index="subject_id", columns="day", values="value")
    assert 15 < p[p.day == 0].value.median() < 25 and 4 < up[24.0].median() / up[0.0].median() < 8
    assert (p[p.below_lloq].value.dropna() == 2.5).all()


def test_owners(spark):
    d = spark.createDataFrame([("which Device?",), ("sample size and power",), ("primary endpoint?",), ("prior immunity",), ("anything",)], "q string")
    assert [r.o for r in d.select(tx.owner(F.col("q")).alias("o")).collect()] == ["lab lead", "biostatistician", "clinical trial expert", "mucosal immunologist", "project lead"]
