"""Tasks that a plan and its data leave open, in order, with ids, months, acceptance, priority and origin."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import month_bucket, week_start
from ..functions.text import owner
from ..operators.comparability import audit, verdicts
from ..operators.kinetics import fits as fitted
from ..schema import CONTEXT, SERIES_KEY
from ..session import written
from .agent import Run


class Kind(NamedTuple):
    """A kind of task: its section, who does it, in which week, how urgent; what is accepted as done, and where it comes from."""

    section: int
    owner: str
    week: int
    priority: str
    acceptance: str
    origin: str


# Sections, owners, weeks, priorities, and the lengths at which titles are cut. An open question's owner follows
# its words.
KINDS = {
    "option": Kind(1, "domain expert", 1, "high", "an expert signs, or the option goes", "an option without evidence"),
    "question": Kind(2, "", 2, "medium", "an answer stands in the decision log", "an open question of the plan"),
    "check": Kind(3, "project lead", 1, "high", "the check passes on the next run", "a self-check that failed"),
    "placeholder": Kind(4, "data engineer", 1, "high", "no entry to verify is left", "the evidence base holds placeholders"),
    "reader": Kind(4, "domain expert", 3, "high", "each quote is confirmed by a second person", "people stay in the loop"),
    "breadth": Kind(4, "data engineer", 4, "medium", "no empty cell for the planned platforms and methods", "the evidence base is a start"),
    "pairs": Kind(5, "lab lead", 5, "high", "no planned comparison is ruled out", "verdicts on the data"),
    "thin": Kind(5, "clinical trial expert", 5, "medium", "four timepoints or more, a late one among them", "audit of the data"),
    "floor": Kind(5, "biostatistician", 6, "medium", "the analysis plan names the method", "audit of the data"),
    "late": Kind(5, "clinical trial expert", 6, "medium", "the interval's ends are within a factor of three", "fits of the data"),
    "data": Kind(6, "data engineer", 7, "high", "real data pass through, synthetic ones stay as tests", "only synthetic data so far"),
    "freeze": Kind(6, "data engineer", 8, "medium", "two machines give the same bytes", "regulated use"),
    "gold": Kind(6, "data engineer", 9, "medium", "recall and quote rates stand beside their thresholds", "the gold sets are small"),
    "limits": Kind(6, "project lead", 10, "medium", "a page that an expert has read", "scope"),
    "rehearsal": Kind(6, "project lead", 11, "high", "each recommendation is traced to its source unaided", "transparency"),
    "decision": Kind(6, "project lead", 12, "high", "a written decision with what is still untested", "the last week"),
}
CUT, SHOWN = 110, 3
FEW_TIMEPOINTS, WIDE, REPLICATES = 4, 5, 60
STANDING = {
    "data": "put real measurements in the place of synthetic ones",
    "freeze": "pin versions, seeds and a manifest of the data",
    "gold": "measure retrieval and extraction on larger gold sets",
    "limits": "write down what the results must not be used for",
    "rehearsal": "walk through one scenario with the experts",
    "decision": "decide on a validation study",
}
FACTS = (
    "code of our own, on public and synthetic data only", "literature is cited and quoted, not passed on whole", "records of public registries keep their ids and terms",
    "no partner's data and no confidential text", "models run locally", "work under a sponsor's agreement belongs there and is kept apart",
)
QUESTIONS = (
    "what could be patented and what should be published (patent attorney)", "which licence serves the project", "what agreement must precede a partner's data",
    "do the terms of models and data sets fit the use", "who owns what others contribute, and where is that written",
)
SCHEMA = "section int, ord int, title string, owner string, week int, priority string, acceptance string, origin string"


def _task(df: DataFrame, kind: str, ord_: Column | int, title: Column, who: Column | None = None) -> DataFrame:
    k = KINDS[kind]
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(k.section).alias("section"), lit(ord_).cast("int").alias("ord"), title.alias("title"), (F.lit(k.owner) if who is None else who).alias("owner"), F.lit(k.week).alias("week"), *[F.lit(x).alias(c) for c, x in (("priority", k.priority), ("acceptance", k.acceptance), ("origin", k.origin))])


def build(run: Run, studies: DataFrame, data: DataFrame | None = None, fits: DataFrame | None = None) -> DataFrame:
    """(task_id, week, month, title, owner, priority, acceptance, origin) by week and id; ids follow the order of sections.

    fits (compartment, method, half_life_days, ci_half_life) are computed from the data if not given: one task for each
    compartment and method whose half-life is wide.
    """
    spark = studies.sparkSession
    p = run.plan
    fixed = [(KINDS[k].section, i, t, *KINDS[k][1:]) for k, i, t in [
        *[("option", i, f"find evidence for {o['option_id']}, or drop it: {o['choice']}") for i, o in enumerate(o for o in p.options if o["assumption"])],
        *[("check", i, "mend: " + x[:CUT]) for i, x in enumerate(run.issues)],
        ("reader", 1, "a second reader compares every quote with its source"), ("breadth", 2, "widen the evidence base to 30 studies, equally verified"),
        *[(k, i, t) for i, (k, t) in enumerate(STANDING.items())],
    ]]
    parts = [spark.createDataFrame(fixed, SCHEMA)]
    if p.open_questions:
        q = spark.createDataFrame(list(enumerate(p.open_questions)), "i int, q string")
        parts.append(_task(q, "question", F.col("i"), F.concat(F.lit("settle: "), F.substring("q", 1, CUT)), owner(F.col("q"))))
    n = F.col("n").cast("string")
    todo = studies.where("level = 'to_verify'").select("study_ord", "study_id").withColumn("i", F.row_number().over(Window.orderBy("study_ord")))  # studies: one evidence base
    named = todo.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= SHOWN, F.struct("i", "study_id")))), lambda x: x["study_id"]), ", ").alias("ids"))
    parts.append(_task(named.where("n > 0"), "placeholder", 0, F.concat(F.lit("verify "), n, F.lit(" placeholders: "), "ids")))
    if data is not None:
        used = dict.fromkeys((*CONTEXT, *SERIES_KEY, "subject_id", "day", "value", "row_ord", "below_lloq"))
        data = written(data.select(*[c for c in used if c in data.columns]), "data")  # read by audit, verdicts and fits
        seen = written(audit(data).select("n_timepoints", "below_lloq"), "audit")
        bad = verdicts(data).agg(F.count_if(F.col("level") == 2).alias("n")).where("n > 0")
        thin, below = seen.agg(F.count_if(F.col("n_timepoints") < FEW_TIMEPOINTS).alias("n")).where("n > 0"), seen.agg(F.sum("below_lloq").alias("n")).where("n > 0")
        parts += [_task(bad, "pairs", 0, F.concat(F.lit("harmonise the "), n, F.lit(" pairs of series that may not be compared")))]
        parts += [_task(thin, "thin", 1, F.concat(F.lit("add timepoints to "), n, F.lit(" thin series")))]
        parts += [_task(below, "floor", 2, F.concat(F.lit("state how the "), n, F.lit(" values below the floor are handled")))]
        by = ["compartment", "method"]
        given = fits if fits is not None else fitted(data, by, n_boot=REPLICATES, raw=False)
        wide = given.where((F.col("half_life_days") > 0) & (F.col("ci_half_life.hi") > WIDE * F.col("half_life_days"))).select(F.concat_ws("/", *by).alias("key")).distinct()
        wide = wide.withColumn("i", F.row_number().over(Window.orderBy("key")))  # as many rows as devices
        parts.append(_task(wide, "late", F.col("i") + 2, F.concat(F.lit("add a late visit for "), "key")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    numbered = out.withColumn("task_id", F.format_string("T%02d", F.row_number().over(Window.orderBy("section", "ord"))))
    return numbered.select("task_id", "week", month_bucket(F.col("week")).alias("month"), "title", "owner", "priority", "acceptance", "origin").orderBy("week", "task_id")


def untested(run: Run) -> list[str]:
    """Assumptions to test, by option."""
    return [f"{o['option_id']}: {o['choice']}" for o in run.plan.options if o["assumption"]]


def calendar(tasks: DataFrame, start: date) -> DataFrame:
    return tasks.withColumn("starts", week_start(F.lit(start), F.col("week")))


def by_month(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("month").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "task_id"))), lambda x: x["task_id"]).alias("task_ids"))


def document(run: Run, tasks: DataFrame, start: date) -> str:
    """The roadmap for people: a table for each month, the assumptions to test, facts and questions on rights."""
    rows = calendar(tasks, start).orderBy("week", "task_id").collect()
    lines = ["# Roadmap of 90 days", "", f"From {start.isoformat()}; each task comes from a gap that a run has found.", ""]
    for m in (1, 2, 3):
        own = [r for r in rows if r.month == m]
        if own:
            lines += [f"## Month {m} (weeks {4 * m - 3} to {4 * m})", "", "| id | task | owner | from | priority | done when | origin |", "|---|---|---|---|---|---|---|"]
            lines += [f"| {r.task_id} | {r.title} | {r.owner} | {r.starts} | {r.priority} | {r.acceptance} | {r.origin} |" for r in own] + [""]
    for title, said in (("Assumptions without evidence", untested(run)), ("Rights: facts", FACTS), ("Rights: questions for counsel", QUESTIONS)):
        lines += [f"## {title}", "", *[f"- {x}" for x in said], ""] if said else []
    return "\n".join(lines)
