"""The library's questions as ten functions over one evidence base; each returns plain values that JSON can hold."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import comparability, graph, kinetics, search
from .plans import agent, roadmap
from .schema import CONTEXT, DEFAULTS, VOCABULARY
from .sources import readers, synthetic

CONTEXT_KIND = "struct<" + ", ".join(f"{c}: {'double' if c == 'lloq' else 'string'}" for c in CONTEXT) + ">"


class Tools:
    """The tools over the studies of one evidence base."""

    NAMES = ("search_evidence", "list_studies", "studies_by_tag", "evidence_gaps", "check_comparability", "propose_strategy", "generate_roadmap", "fit_kinetic_curve", "comparability_report", "synthetic_demo")

    def __init__(self, studies: DataFrame) -> None:
        self.studies, self.spark = studies, studies.sparkSession

    def call(self, name: str, **arguments):
        if name not in self.NAMES:
            raise ValueError(f"no tool {name}; there are {', '.join(self.NAMES)}")
        return getattr(self, name)(**arguments)

    #: What can be read whole, by address.
    RESOURCES = ("evidence://studies",)

    def resource(self, address: str) -> list[dict]:
        """The full evidence base, in its order."""
        if address not in self.RESOURCES:
            raise ValueError(f"no resource {address}; there is {', '.join(self.RESOURCES)}")
        return [r.asDict(recursive=True) for r in self.studies.orderBy("study_ord").drop("study_ord").collect()]

    def search_evidence(self, query: str, k: int = 5, citable_only: bool = True) -> dict:
        """The k best chunks for a query."""
        chunks = search.chunks(self.studies)
        hits = search.hybrid(self.spark.createDataFrame([(0, query)], "qid int, text string"), chunks, "qid", "chunk_id", k, citable_only)
        rows = hits.join(chunks.drop("citable"), "chunk_id").orderBy("rank").collect()
        return {"mode": "lexical", "hits": [{"chunk_id": r.chunk_id, "study_id": r.study_id, "kind": r.kind, "text": r.text, "tags": r.tags, "score": round(r.fused, 5)} for r in rows]}

    def list_studies(self) -> list[dict]:
        return [r.asDict() for r in search.study_listing(self.studies).collect()]

    def studies_by_tag(self, tag: str) -> dict:
        return {"tag": tag, "studies": [r.study_id for r in graph.studies_for_tag(*graph.build(self.studies), tag).collect()]}

    def evidence_gaps(self) -> dict:
        return {"gaps": [list(r) for r in graph.coverage_gaps(graph.build(self.studies)[1]).orderBy("platform", "method").collect()]}

    def check_comparability(self, context_a: dict, context_b: dict) -> dict:
        """Verdict, explanation and flags for two contexts; what they leave out takes its default."""
        wrong = [f"{k}={v}" for c in (context_a, context_b) for k, v in c.items() if v is not None and k in VOCABULARY and v not in VOCABULARY[k]]
        if wrong:
            raise ValueError(f"not in the vocabulary: {', '.join(wrong)}")
        side = lambda c: tuple({**DEFAULTS, **c}.get(k) for k in CONTEXT)
        pair = self.spark.createDataFrame([(side(context_a), side(context_b))], f"a {CONTEXT_KIND}, b {CONTEXT_KIND}")
        r = comparability.compare(pair).withColumn("explanation", comparability.explain_flags(F.col("flags"))).first()
        return {"verdict": r.verdict, "explanation": r.explanation, "level": r.level, "flags": [f.asDict() for f in r.flags]}

    def propose_strategy(self, scenario_text: str) -> str:
        return agent.run(scenario_text, self.studies).report

    def generate_roadmap(self, scenario_text: str, use_demo_data: bool = True) -> list[dict]:
        data = synthetic.demo(self.spark, n=20) if use_demo_data else None
        return [r.asDict() for r in roadmap.build(agent.run(scenario_text, self.studies), self.studies, data).collect()]

    def fit_kinetic_curve(self, csv_text: str, n_boot: int = 150) -> dict:
        """The curve of a CSV with subject_id, day and value."""
        rows = readers.measurements_text(self.spark, csv_text, contract=False).withColumn("series", F.lit("all"))
        got = kinetics.fits(rows, ["series"], n_boot).first()
        return got.asDict(recursive=True) if got else {"identifiable": False, "notes": ["no positive values"]}

    def comparability_report(self, csv_text: str) -> dict:
        """All pairs of series of a CSV: a matrix of verdicts, and the pairs that are not comparable as they are."""
        df = readers.measurements_text(self.spark, csv_text)
        pairs, matrix = comparability.verdicts(df).orderBy("ord_a", "ord_b").collect(), {}
        for r in comparability.contexts(df).select("series_key").collect():
            matrix.setdefault(r.series_key, {})[r.series_key] = "comparable"
        for r in pairs:
            matrix[r.key_a][r.key_b] = matrix[r.key_b][r.key_a] = r.verdict
        return {"matrix": matrix, "problems": [{"a": r.key_a, "b": r.key_b, "level": r.verdict, "flags": [f.code for f in r.flags]} for r in pairs if r.level]}

    def synthetic_demo(self, n_per_arm: int = 20, seed: int = 42) -> str:
        """The demonstration table as CSV text, marked as synthetic in its source column."""
        rows, out = synthetic.demo(self.spark, n_per_arm, seed).orderBy("arm_id", "row_ord"), io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([rows.columns, *map(tuple, rows.toLocalIterator())])
        return out.getvalue()


def over(spark: SparkSession, path: str) -> Tools:
    """The tools over an evidence file."""
    return Tools(readers.evidence(spark, path))
