"""Command line: python -m titrelake.cli COMMAND. Results go to standard output, tables to --out."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from datetime import date

from .session import session

SCENARIO = "LAIV given intranasally to 40 healthy adults, influenza, 7 visits over 180 days, peak and durability, mucosal against systemic"


def _studies(spark, path: str | None):
    from pyspark.sql import types as T

    from .schema import STUDY
    from .sources import fixtures, readers

    if path:
        return readers.evidence(spark, path)
    rows = [(i, *[s.get(f) for f in STUDY.fieldNames()]) for i, s in enumerate(fixtures.STUDIES)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("study_ord", T.IntegerType()), *STUDY.fields]))


def _show(value) -> None:
    print(value if isinstance(value, str) else json.dumps(value, indent=2, default=str))


def schema(a) -> None:
    from .sources.sinks import schemas

    os.makedirs(a.out, exist_ok=True)
    for name, model in schemas().items():
        with open(f"{a.out}/{name}.schema.json", "w") as f:
            json.dump(model, f, indent=2)
    print(f"{len(schemas())} schemas in {a.out}")


def doctor(a) -> None:
    import pyspark

    _show({"python": platform.python_version(), "pyspark": pyspark.__version__, "rows": session("doctor", a.master).range(3).count()})


def tool(a) -> None:
    from .tools import Tools

    _show(Tools(_studies(session("tool", a.master), a.evidence)).call(a.name, **json.loads(a.arguments)))


def search(a) -> None:
    from .tools import Tools

    for h in Tools(_studies(session("search", a.master), a.evidence)).search_evidence(a.query, a.k, not a.all)["hits"]:
        print(f"[{h['score']}] {h['chunk_id']} ({h['study_id']}) {h['text'][:400]}")


def graph(a) -> None:
    from .operators import graph as g

    nodes, edges = g.build(_studies(session("graph", a.master), a.evidence))
    _show({"nodes": nodes.count(), "edges": edges.count(), "gaps": [list(r) for r in g.coverage_gaps(edges).collect()]})


def propose(a) -> None:
    from .plans import agent

    _show(agent.run(a.scenario, _studies(session("propose", a.master), a.evidence)).report)


def roadmap(a) -> None:
    from .plans import agent
    from .plans import roadmap as r
    from .sources import synthetic

    spark = session("roadmap", a.master)
    studies = _studies(spark, a.evidence)
    run = agent.run(a.scenario, studies)
    _show(r.document(run, r.build(run, studies, synthetic.demo(spark, 20)), date.fromisoformat(a.start)))


def synth(a) -> None:
    from .sources import sinks, synthetic

    d = synthetic.demo(session("synth", a.master), a.n, a.seed)
    sinks.to_csv(d, f"{a.out}/synthetic")
    print(f"{d.count()} synthetic rows in {a.out}/synthetic")


def build_evidence(a) -> None:
    from pyspark.sql import functions as F

    from .operators.evidence import extract
    from .sources import readers, sinks

    spark = session("build-evidence", a.master)
    docs = readers.downloaded(spark, a.folder) if a.downloaded else readers.literature_folder(spark, a.folder, a.limit or None)
    docs = docs.withColumn("url", F.lit(None).cast("string"))
    found = extract(docs)
    sinks.to_json(found, f"{a.out}/extracted")
    _show({"studies": found.count(), "findings": found.select(F.sum(F.size("findings"))).first()[0]})


def download(a) -> None:
    from .sources import paged

    _show(paged.download(session("download", a.master), a.folder, a.literature, a.trials, a.query, a.pmid, a.trial_query, a.nct, max_pages=a.pages))


def audit(a) -> None:
    from .operators import comparability
    from .sources.readers import measurements
    from .sources.sinks import markdown

    d = measurements(session("audit", a.master), a.csv)
    _show(markdown(comparability.audit(d), "Series"))
    _show(markdown(comparability.verdicts(d).select("key_a", "key_b", "verdict", comparability.explain_flags("flags").alias("why")), "Pairs"))


def digitize(a) -> None:
    """Check and flatten a figure's JSON, as a vision model or a person has read it off."""
    from pyspark.sql import functions as F

    from .sources import readers, sinks

    spark = session("digitize", a.master)
    d = spark.read.text(a.figure, wholetext=True).select(readers.figure(F.col("value")).alias("figure"))
    _show({"faults": readers.figure_faults(d).first().faults})
    sinks.to_csv(readers.figure_rows(d), f"{a.out}/figure")


def evaluate(a) -> None:
    from .plans import evaluation
    from .sources import readers

    spark = session("eval", a.master)
    studies = _studies(spark, a.evidence)
    rows = (evaluation.run_all(studies, readers.gold_set(spark, a.gold), a.fast) if a.gold else evaluation.extraction(studies).unionByName(evaluation.comparability(spark))).collect()
    for r in rows:
        print(f"{'ok  ' if r.passed else 'FAIL'} {r['name']} {r.value:.3f} (threshold {r.threshold})")
    if not all(r.passed for r in rows):
        sys.exit(1)


def demo(a) -> None:
    """Everything once on synthetic data: audit, verdicts, fits, plan, roadmap, gates."""
    from .operators import comparability, kinetics
    from .sources import sinks, synthetic

    d = synthetic.demo(session("demo", a.master), a.n, a.seed)
    sinks.to_csv(d, f"{a.out}/measurements")
    sinks.to_csv(comparability.audit(d), f"{a.out}/audit")
    sinks.to_csv(comparability.verdicts(d), f"{a.out}/verdicts")
    sinks.to_csv(kinetics.fits(d, ["compartment", "method", "arm_id"], 60), f"{a.out}/fits")
    for step in (propose, roadmap, evaluate):
        step(a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="titrelake", description=__doc__)
    p.add_argument("--master", help="Spark master; the session's own by default")
    p.add_argument("--out", default="outputs", help="folder for tables")
    p.add_argument("--evidence", help="evidence file; an invented one by default")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, run, help_: str, /, **options) -> None:
        s = sub.add_parser(command, help=help_)
        s.set_defaults(run=run)
        for k, v in options.items():
            names = [k] if v.pop("positional", False) else ["--" + k.replace("_", "-")]
            s.add_argument(*names, **v)

    plain = {"scenario": {"default": SCENARIO}, "n": {"type": int, "default": 30}, "seed": {"type": int, "default": 42}, "start": {"default": "2025-01-06"}}
    add("demo", demo, "everything once on synthetic data", **plain, gold={"default": None}, fast={"action": "store_true"})
    add("schema", schema, "write the record schemas")
    add("build-evidence", build_evidence, "extract and verify findings of a folder of records", folder={"positional": True}, limit={"type": int, "default": 0}, downloaded={"action": "store_true"})
    many = {"action": "append", "default": []}
    add("download", download, "records, full texts and trials of public services, as tables in a folder", folder={"positional": True}, query=dict(many), pmid=dict(many), trial_query=dict(many), nct=dict(many), pages={"type": int, "default": 1}, literature={"default": "https://www.ebi.ac.uk/europepmc/webservices/rest"}, trials={"default": "https://clinicaltrials.gov/api/v2/studies"})
    add("search", search, "query the evidence base", query={"positional": True}, k={"type": int, "default": 5}, all={"action": "store_true"})
    add("graph", graph, "size and gaps of the evidence graph")
    add("propose", propose, "a candidate plan for a scenario", scenario={"positional": True})
    add("synth", synth, "write the synthetic table", n={"type": int, "default": 30}, seed={"type": int, "default": 42})
    add("roadmap", roadmap, "what a plan leaves to be done", scenario={"positional": True, "nargs": "?", "default": SCENARIO}, start={"default": "2025-01-06"})
    add("audit", audit, "audit and verdicts of a measurement CSV", csv={"positional": True})
    add("eval", evaluate, "the gated metrics", gold={"default": None}, fast={"action": "store_true"})
    add("digitize", digitize, "check the JSON of a digitised figure", figure={"positional": True})
    add("tool", tool, "call one of the tools with JSON arguments", name={"positional": True}, arguments={"positional": True, "nargs": "?", "default": "{}"})
    add("doctor", doctor, "check the environment")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
