"""Reading a trial scenario out of free text, by fixed words and numbers."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VOCABULARY
from ..sources.connectors import Model

# Words that name a route, platform, pathogen or question; the first entry that hits wins.
ROUTES = (("intranasal", ("intranasal", "nasal", "nose", "spray", "intranasale")), ("inhaled", ("inhaled", "aerosol")), ("oral", ("oral",)), ("intramuscular", ("intramuscular", "injected", "injection", " im ", "parenteral")))
PLATFORMS = (
    ("live_attenuated", ("live attenuated", "laiv", "live-attenuated", "flumist")), ("adenovirus_vector", ("adenovir", "chad", "vector")),
    ("mrna", ("mrna",)), ("inactivated", ("inactivated", "iiv", "killed")), ("protein_subunit", ("subunit", "recombinant protein")),
)
PATHOGENS = (("influenza", ("influenza", "flu", "grippe", "h1n1", "h3n2")), ("SARS-CoV-2", ("sars-cov-2", "covid", "coronavirus")), ("RSV", ("rsv", "respiratory syncytial")))
QUESTIONS = (
    ("durability", ("durab", "waning", "persist", "6 month", "long term", "longevity")), ("mucosal_vs_systemic", ("mucosal vs", "versus systemic", "compare compartment", "mucosal and systemic")),
    ("correlate_of_protection", ("correlate", "protection", "challenge")), ("peak", ("peak", "kinetic", "when")),
)
# Words of a comparison, of young people and of people, and the patterns that read numbers of people, visits and
# days of follow-up.
COMPARING = ("compare", "versus", " vs ", "comparator", "comparaison")
YOUNG = ("child", "children", "paediatric", "pediatric", "infant", "enfant")
PEOPLE = r"participants?|subjects?|volunteers?|adults?|people|persons?|patients?|children|infants|toddlers|sujets?|enfants?|nourrissons?|adultes?"
NOT_TIME = r"(?!\s*(?:days?|weeks?|months?|years?|visits?|jours?|semaines?|mois|ans?)\b)"
N = rf"(\d+){NOT_TIME}\s+(?:[a-zé]+\s+){{0,2}}(?:{PEOPLE})\b"
VISITS = r"(\d+)\s*(?:visits|visites|samples|prélèvements|timepoints)"
FOLLOW_DAYS = r"(\d+)\s*(?:days?|jours?)\s*(?:of\s*)?follow"
FOLLOW_MONTHS = r"(\d+)\s*months?\s*(?:of\s*)?(?:follow|suivi)"


@dataclass(frozen=True)
class Scenario:
    """What a plan is made for."""

    name: str = "unnamed scenario"
    route: str = "intranasal"
    platform: str = "other"
    pathogen: str = "unspecified"
    comparator_route: str | None = None
    pediatric: bool = False
    age_min: int = 18
    age_max: int = 64
    prior_immunity: str = "unknown"
    n_participants: int = 30
    max_visits: int = 6
    follow_up_days: int = 180
    dose_days: tuple[int, ...] = (0,)
    questions: tuple[str, ...] = field(default=("peak", "durability"))


def _hit(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _first(low: Column, table: tuple, default: str) -> Column:
    return reduce(lambda out, kv: F.when(_hit(low, kv[1]), F.lit(kv[0])).otherwise(out), reversed(table), F.lit(default))


def _number(low: Column, pattern: str, default: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("int"), F.lit(default))


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column scenario, the struct of Scenario's fields. All words are substrings; numbers spelled out,
    negations and the like are not understood."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    pad = F.concat(F.lit(" "), low, F.lit(" "))
    route = _first(pad, ROUTES, "intranasal")
    qs = F.filter(F.array(*[F.when(_hit(pad, ws), F.lit(q)) for q, ws in QUESTIONS]), lambda q: q.isNotNull())
    young = _hit(low, YOUNG)
    other = F.when(route != "intramuscular", "intramuscular").otherwise("intranasal")
    months = F.nullif(F.regexp_extract(low, FOLLOW_MONTHS, 1), F.lit("")).try_cast("int") * 30
    return df.withColumn(
        "scenario",
        F.struct(
            F.coalesce(F.nullif(F.substring(F.trim(t), 1, 70), F.lit("")), F.lit("unnamed scenario")).alias("name"), route.alias("route"), _first(pad, PLATFORMS, "other").alias("platform"),
            _first(pad, PATHOGENS, "unspecified").alias("pathogen"), F.when(_hit(low, COMPARING), other).alias("comparator_route"), young.alias("pediatric"), F.when(young, 2).otherwise(18).alias("age_min"),
            F.when(young, 17).otherwise(64).alias("age_max"), F.lit("unknown").alias("prior_immunity"), _number(low, N, 30).alias("n_participants"), F.greatest(_number(low, VISITS, 6), F.lit(2)).alias("max_visits"),
            F.coalesce(months, _number(low, FOLLOW_DAYS, 180)).alias("follow_up_days"), F.array(F.lit(0)).alias("dose_days"), F.when(F.size(qs) > 0, qs).otherwise(F.array(F.lit("peak"), F.lit("durability"))).alias("questions"),
        ),
    )


def read(spark, text: str) -> Scenario:
    """The scenario of one text."""
    r = parse(spark.createDataFrame([(text,)], "text string")).select("scenario.*").first().asDict()
    return Scenario(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()})


PROMPT = "Read this trial scenario. Answer with one JSON object; leave out what the text does not say. Keys: route, platform, pathogen, n_participants, max_visits, follow_up_days, dose_days, age_min, age_max, prior_immunity, pediatric, questions.\n\n"


def read_with(model: Model, spark, text: str) -> tuple[Scenario, str]:
    """(scenario, "model" or "rules"): what the rules read, with those of a model's answers that have the right kind and,
    where there is a vocabulary, are in it. Without a model or an answer the rules stand alone."""
    base, got = read(spark, text), model.json(PROMPT + text)
    listed = {"route": VOCABULARY["route"], "platform": VOCABULARY["platform"], "questions": [q for q, _ in QUESTIONS]}
    taken = {}
    for k, v in (got or {}).items():
        old = getattr(base, k, None)
        if isinstance(old, tuple) and isinstance(v, list):
            v = tuple(x for x in v if type(x) is type(old[0]) and x in listed.get(k, v))
            v = tuple(sorted(v)) if k == "dose_days" else v
        if v and type(v) is type(old) and (isinstance(v, tuple) or v in listed.get(k, [v])):
            taken[k] = v
    return (changed(base, **taken), "model") if taken else (base, "rules")


#: Fields in which two readings are compared.
COMPARED = ("pathogen", "platform", "route", "comparator_route", "n_participants", "max_visits", "follow_up_days", "pediatric", "questions")


def compare_readers(model: Model, spark, text: str) -> dict:
    """Both readings of a text and the fields in which they differ. Without a model, or if it fails, `model` is null,
    `ran` is false and `error` says why."""
    part = lambda s: {k: sorted(v) if isinstance(v, tuple) else v for k, v in flat(s).items() if k in COMPARED}
    out = {"rules": part(read(spark, text)), "model": None, "ran": False, "differences": [], "error": None}
    if not model.available:
        return out | {"error": "no model"}
    try:
        s, how = read_with(model, spark, text)
    except OSError as e:
        return out | {"error": str(e)}
    if how == "rules":
        return out | {"error": "no usable answer"}
    got = part(s)
    return out | {"model": got, "ran": True, "differences": [f for f in COMPARED if got[f] != out["rules"][f]]}


def changed(a: Scenario, **fields) -> Scenario:
    return replace(a, **fields)


def flat(s: Scenario) -> dict:
    return asdict(s)
