"""The planning agent: parse, propose, retrieve, criticise, revise at most once, report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import verify
from ..operators import search as se
from . import scenario as sc
from .strategy import Plan, propose


# The names of the checks below.
def critique(plan: Plan, studies: DataFrame, most_assumed: float = 0.4) -> tuple[dict[str, bool], list[str]]:
    """(checks by name, issues). The late-visit check applies only if durability is asked for."""
    s, checks, issues = plan.scenario, {}, []

    def check(name: str, ok: bool, issue: str) -> None:
        checks[name] = ok
        if not ok:
            issues.append(issue)

    assumed = 1.0 - plan.coverage["share_backed"]
    check("assumption_share_ok", assumed <= most_assumed, f"{assumed:.0%} of the options are assumptions")
    refs = [r for o in plan.options for r in o["refs"]]
    ids = sorted({r["study_id"] for r in refs})
    texts = {r.study_id: r.t for r in studies.where(F.col("study_id").isin(ids)).select("study_id", F.concat_ws("\n\n", "abstract", "full_text_excerpts").alias("t")).collect()} if ids else {}
    bad = [r["finding_id"] for r in refs if not verify(r["quote"], texts.get(r["study_id"], ""))[0]]
    check("quotes_verified", not bad, f"quotes not found: {', '.join(bad)}")
    check("budget_respected", len(plan.days) <= s.max_visits, "more visits than the budget")
    check("baseline_present", 0 in plan.days, "no day-0 sample")
    check("within_followup", all(d <= s.follow_up_days for d in plan.days), "a visit after the follow-up")
    if "durability" in s.questions:
        check("late_visit_for_durability", max(plan.days or [0]) >= min(90, s.follow_up_days), "durability asked for, no late visit")
    check("experts_flagged", bool(plan.open_questions), "nothing left for the experts")
    return checks, issues


@dataclass
class Run:
    """State and outcome of a run; trace has a line for each step."""

    text: str
    scenario: sc.Scenario | None = None
    plan: Plan | None = None
    retrieved: list[dict] = field(default_factory=list)
    checks: dict[str, bool] = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)
    revisions: int = 0
    trace: list[str] = field(default_factory=list)
    report: str = ""

    def trace_json(self) -> str:
        return json.dumps({"text": self.text, "scenario": sc.flat(self.scenario), "days": self.plan.days, "checks": self.checks, "issues": self.issues, "revisions": self.revisions, "trace": self.trace})


def retrieved(questions: DataFrame, studies: DataFrame, k: int = 2) -> DataFrame:
    """(qid, rank, chunk_id, study_id, text, fused): the k best citable chunks for each of the questions (qid, text)."""
    chunks = se.chunks(studies).withColumn("id", F.to_json("chunk_ord"))
    scores = se.bm25(se.terms(questions, "qid", "text"), se.terms(chunks, "id", "text"), "qid", "id")
    hits = se.top(se.fuse([se.ranked(scores, "qid", "id")], chunks, "qid", "id"), "qid", "id", k, citable_only=True)
    return hits.join(chunks.select("id", "chunk_id", "study_id", "text"), "id").select("qid", "rank", "chunk_id", "study_id", "text", "fused")


def retrieve(questions: list[str], studies: DataFrame, most: int = 5, k: int = 2) -> list[dict]:
    """The k best citable chunks for each of the first `most` questions."""
    if not questions:
        return []
    q = studies.sparkSession.createDataFrame(list(enumerate(questions[:most])), "qid int, text string")
    return [r.asDict() for r in retrieved(q, studies, k).orderBy("qid", "rank").collect()]


def run(text: str, studies: DataFrame, max_steps: int = 12, max_revisions: int = 1) -> Run:
    """Run the state machine to its report."""
    st, step = Run(text), "parse"
    for _ in range(max_steps):
        st.trace.append(step)
        if step == "parse":
            st.scenario, step = sc.read(studies.sparkSession, text), "propose"
        elif step == "propose":
            st.plan, step = propose(st.scenario, studies), "retrieve"
        elif step == "retrieve":
            st.retrieved, step = retrieve(st.plan.open_questions, studies), "critique"
        elif step == "critique":
            st.checks, st.issues = critique(st.plan, studies)
            step = "report" if not st.issues or st.revisions >= max_revisions else "revise"
        elif step == "revise":
            st.revisions += 1
            s = st.scenario
            if not st.checks.get("budget_respected", True):
                s = sc.changed(s, max_visits=s.max_visits + 1)
            if not st.checks.get("late_visit_for_durability", True):
                s = sc.changed(s, follow_up_days=max(s.follow_up_days, 180), max_visits=max(s.max_visits, len(st.plan.days) + 1))
            st.scenario, step = s, "propose"
        else:
            st.report = report(st)
            break
    return st


def report(st: Run) -> str:
    p, c = st.plan, st.plan.coverage
    lines = [f"# {st.scenario.name}", "", f"Visits: {', '.join(map(str, p.days))}", f"Options: {c['options']}, backed {c['backed']}, assumptions {c['assumptions']}", ""]
    for o in p.options:
        lines += [f"- **{o['option_id']}** ({o['category']}): {o['choice']}. {o['why']}. Review: {o['review']}", *[f"  - “{r['quote']}” ({r['citation']})" for r in o["refs"]]]
    lines += ["", "Open questions:", *[f"- {q}" for q in p.open_questions], "", "Checks:", *[f"- {k}: {'ok' if v else 'fails'}" for k, v in st.checks.items()], *[f"- issue: {i}" for i in st.issues]]
    return "\n".join(lines)
