"""Extraction by rules: plan and results."""

from titrelake import queries as q
from titrelake.operators import evidence


def test_extract_moves_no_texts(spark, sf):
    plan = q.QUERIES["extract_rules"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan


def test_findings_are_quotes_of_the_full_text(spark):
    said = "Nasal IgA peaked on day 14 after the vaccine."
    rows = [("a", said + " Nothing else is in this text at all.", "Title. " + said), ("b", said, "Another text without it."), ("c", said, None), ("d", None, said), ("e", None, None), ("f", "", "No word of that kind here, day 3.")]
    d = spark.createDataFrame([(i, "c", None, None, None, None, a, t) for i, a, t in rows], "doc_id string, citation string, year int, doi string, pmid string, url string, abstract string, full_text string")
    got = {r.study_id: [(f.finding_id, f.quote) for f in r.findings] for r in evidence.extract(d).collect()}
    assert got == {"auto_a": [("a_r0", said)], "auto_b": [], "auto_c": [], "auto_d": [("d_r0", said)], "auto_e": [], "auto_f": []}
