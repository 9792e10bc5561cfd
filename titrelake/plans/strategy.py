"""Candidate plans: a table of options with their conditions, backed by citable findings or marked as assumptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.design import CANDIDATES, optimal_days
from ..operators.evidence import resolve, timepoints
from ..schema import ENDPOINT, METHOD_COMPARTMENT, MUCOSAL_ROUTES, TRIAL
from .scenario import Scenario


@dataclass
class Rule:
    """An option and what it adds to the plan; finding ids are fixed values that evidence bases use."""

    option_id: str
    category: str
    choice: str
    why: str
    finding_ids: tuple[str, ...]
    review: str
    when: Callable[[Scenario], bool] = lambda s: True
    methods: tuple[str, ...] = ()
    days: Callable[[Scenario], list[int]] = lambda s: []
    questions: Callable[[Scenario], list[str]] = lambda s: []


def mucosal(s: Scenario) -> bool:
    return s.route in MUCOSAL_ROUTES


def late_day(s: Scenario) -> int:
    return min(180, s.follow_up_days)


RULES = [
    Rule("O-DEVICE", "sampling_method", "one nasal device throughout, with paired serum", "unlike devices split the data into series that may not be compared", (), "which device suits population and laboratory?", methods=("serum", "nasosorption"), questions=lambda s: ["device and its recovery: for the laboratory to settle"]),
    Rule("O-PAIRED", "sampling_method", "nasal and serum samples at the same visits", "only paired samples allow within-subject comparison", ("bean2024_f2", "thwaites2023_f1"), "is pairing feasible at every visit?"),
    Rule("O-EP", "endpoint", "a mucosal endpoint beside the systemic ones", "the compartments respond separately", ("thwaites2023_f1", "thwaites2023_f4", "bean2024_f2"), "which endpoint is primary?", when=mucosal, questions=lambda s: ["ranking of primary and secondary endpoints"]),
    Rule("O-EP", "endpoint", "systemic endpoints first, mucosal exploratory", "injected vaccines raise little mucosal IgA", ("tsunetsugu2022_f2", "sheikhmohamed2022_f1"), "keep the mucosal endpoint?", when=lambda s: not mucosal(s), questions=lambda s: ["ranking of primary and secondary endpoints"]),
    Rule("O-NORM", "analysis", "nasal IgA raw and over total IgA", "dilution differs from visit to visit", (), "is this normalisation accepted for the assay?"),
    Rule("O-BASELINE", "timepoints", "a day-0 sample in every compartment", "fold-rise needs an own baseline", ("bean2024_f3", "tsunetsugu2022_f3", "singh2023_f3"), "how is prior immunity handled?", days=lambda s: [0], questions=lambda s: ["prior immunity may mask differences between arms: stratify?"] if s.prior_immunity in ("unknown", "high") else []),
    Rule("O-WINDOW", "timepoints", "visits 7 and 28 days after each dose", "the windows that studies report most", ("tsunetsugu2022_f1", "singh2023_f1", "sheikhmohamed2022_f4", "thwaites2023_f3"), "do these windows fit the schedule?", days=lambda s: [d + k for d in s.dose_days for k in (7, 28) if k == 7 or s.follow_up_days >= d + 28]),
    Rule("O-DURABILITY", "timepoints", "a late visit", "without one the half-life is an extrapolation", ("sheikhmohamed2022_f2",), "will subjects stay that long?", when=lambda s: "durability" in s.questions, days=lambda s: [late_day(s)]),
    Rule("O-RESPONDER", "analysis", "responder fraction at each timepoint", "means hide inconsistent responses", ("madhavan2022_f1", "sheikhmohamed2022_f1"), "which definition and sample size?", questions=lambda s: ["sample size and power"]),
    Rule("O-ASSAY", "analysis", "one standard and one laboratory for each assay, or bridging samples", "arbitrary units belong to one laboratory", ("tsunetsugu2022_f4",), "which standard exists for the antigen?"),
    Rule("O-CELL", "endpoint", "blood IgA plasmablasts, exploratory", "blood is easier to standardise than mucosal samples", ("singh2023_f4", "thwaites2023_f3"), "is ELISpot available, and when?", when=lambda s: "correlate_of_protection" in s.questions, methods=("pbmc",), questions=lambda s: ["no accepted correlate of protection: claims stay out"]),
    Rule("O-UNCERTAINTY", "open_question", "intervals, censoring and flags go with the numbers", "what cannot be constrained must be seen", ("bean2024_f4", "thwaites2023_f5"), "which caveats must be reported?"),
]


@dataclass
class Plan:
    """A candidate plan; options are dicts with refs (evidence) and assumption."""

    scenario: Scenario
    options: list[dict]
    methods: list[str]
    endpoints: list[dict]
    days: list[int]
    mandatory: list[int]
    dropped: list[int]
    open_questions: list[str]
    criterion: float = float("nan")
    reported_days: list[int] = field(default_factory=list)

    @property
    def coverage(self) -> dict:
        backed = sum(not o["assumption"] for o in self.options)
        return {"options": len(self.options), "backed": backed, "assumptions": len(self.options) - backed, "share_backed": round(backed / len(self.options), 2) if self.options else 0.0}


def endpoints(s: Scenario) -> list[dict]:
    functional = "hai" if s.pathogen.lower().startswith("influenza") else "neutralization"
    row = lambda i, c, m, iso, a, u, n="none", p=False: {"endpoint_id": i, "compartment": c, "method": m, "isotype": iso, "assay": a, "unit": u, "normalization": n, "antigen": s.pathogen, "primary": p}
    out = [row("nasal_siga", "nasal", "nasosorption", "sIgA", "elisa_binding", "ratio", "total_iga", mucosal(s)), row("serum_igg", "serum", "serum", "IgG", "elisa_binding", "bau_ml", p=not mucosal(s)), row(f"serum_{functional}", "serum", "serum", "total", functional, "titer")]
    return out + ([row("iga_asc", "blood_cells", "pbmc", "IgA", "elispot", "sfu_per_million")] if "correlate_of_protection" in s.questions else [])


def propose(s: Scenario, studies: DataFrame, use_design: bool = True, seed: int = 0) -> Plan:
    """Options in rule order with their evidence, and visit days within the budget.

    Mandatory days are clipped to the follow-up. If they fill the budget the earliest stay and the others are
    reported as dropped; else the optimal design fills up, with the days that studies report as candidates too.
    """
    spark = studies.sparkSession
    rules = [r for r in RULES if r.when(s)]
    wanted = spark.createDataFrame([(r.option_id, list(r.finding_ids)) for r in rules], "request_id string, finding_ids array<string>")
    refs = {r.request_id: [x.asDict() for x in r.refs] for r in resolve(wanted, studies).collect()}  # a dozen rows
    options = [{"option_id": r.option_id, "category": r.category, "choice": r.choice, "why": r.why, "review": r.review, "refs": refs[r.option_id], "assumption": not refs[r.option_id]} for r in rules]
    must = sorted({d for r in rules for d in r.days(s) if 0 <= d <= s.follow_up_days})
    reported = [r.day for r in timepoints(studies, s.follow_up_days).collect()]  # at most follow_up_days + 1
    days, dropped, criterion = must[: s.max_visits], must[s.max_visits :], float("nan")
    if use_design and len(must) < s.max_visits:
        days, criterion = optimal_days(s.route, s.platform, s.follow_up_days, s.max_visits, must, sorted({*CANDIDATES, *reported}), seed=seed)
    methods = sorted({m for r in rules for m in r.methods})
    questions = list(dict.fromkeys(q for r in rules for q in r.questions(s)))
    return Plan(s, options, methods, endpoints(s), days, must, dropped, questions, criterion, reported)


def schedule(plan: Plan, spark) -> DataFrame:
    """Arms by days by methods, with windows and compartments."""
    arms = ["vaccine", *(["comparator"] if plan.scenario.comparator_route else [])]
    rows = [(a, d, m, METHOD_COMPARTMENT[m], 0 if d < 7 else 1 if d < 30 else 3) for a in arms for d in plan.days for m in plan.methods]
    return spark.createDataFrame(rows, "arm string, day int, method string, compartment string, window_days int")


def options_frame(plan: Plan, spark) -> DataFrame:
    return spark.createDataFrame([(i, o["option_id"], o["category"], o["choice"], o["assumption"], [r["finding_id"] for r in o["refs"]]) for i, o in enumerate(plan.options)], "ord int, option_id string, category string, choice string, assumption boolean, finding_ids array<string>").withColumn("support", F.when(F.col("assumption"), "assumption").otherwise(F.concat(F.size("finding_ids").cast("string"), F.lit(" findings"))))


def visit_schedule(spark, plan: Plan) -> DataFrame:
    """(day, kind): the visits of a plan, mandatory or chosen for what they tell."""
    return spark.createDataFrame([(d, "mandatory" if d in plan.mandatory else "chosen") for d in plan.days], "day int, kind string")


def trial_faults(trials: DataFrame) -> DataFrame:
    """trials (schema TRIAL) with `faults`: endpoints that no sampling event serves or whose compartment is not their
    method's, and sampling after the end of follow-up. What is null finds no fault but an endpoint's missing method."""
    where = F.create_map(*[F.lit(x) for kv in METHOD_COMPARTMENT.items() for x in kv])
    sampling, ends = F.coalesce("sampling", F.array()), F.coalesce("endpoints", F.array())
    sampled = F.transform(sampling, lambda v: v["method"])
    unserved = F.filter(ends, lambda e: ~F.coalesce(F.array_contains(sampled, e["method"]), F.lit(False)))
    astray = F.filter(ends, lambda e: F.try_element_at(where, e["method"]) != e["compartment"])
    named = lambda es, what: F.when(F.size(es) > 0, F.concat(F.lit(what + ": "), F.array_join(F.transform(es, lambda e: e["endpoint_id"]), ", ")))
    late = F.filter(sampling, lambda v: v["day"] > F.col("follow_up_days"))
    days = F.array_join(F.array_sort(F.array_distinct(F.transform(late, lambda v: v["day"]))), ", ")
    found = F.array(named(unserved, "endpoints never sampled"), named(astray, "endpoints in the wrong compartment"), F.when(F.size(late) > 0, F.concat(F.lit("sampling after follow-up on days "), days)))
    return trials.withColumn("faults", F.filter(found, lambda x: x.isNotNull()))


def trial_design(plan: Plan, spark) -> DataFrame:
    """A plan's candidate design, one row of schema TRIAL for experts to look at; ValueError if it does not hold together."""
    s = plan.scenario
    sampling = [(d, m, 0 if d < 7 else 1 if d < 30 else 3) for d in plan.days for m in plan.methods]
    ends = [tuple(e.get(f, e["endpoint_id"]) for f in ENDPOINT.fieldNames()) for e in plan.endpoints]
    row = (f"candidate-{s.name}", list(s.dose_days), s.age_min, s.age_max, s.n_participants, s.max_visits, s.follow_up_days, sampling, ends)
    design = spark.createDataFrame([row], TRIAL)
    if faults := trial_faults(design).first().faults:
        raise ValueError("; ".join(faults))
    return design
