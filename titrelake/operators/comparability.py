"""Which measurement series may be compared: declarative rules over pairs of contexts, in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONTEXT, DEFAULTS, LEVELS, MUCOSAL, SERIES_KEY, UNIT_FACTORS, VOCABULARY
from ..session import written

Side = Callable[[str], Column]
#: (code, level, message and remedy builders) in order of evaluation; a rule that does not apply gives null.
RULES: list[Callable[[Side, Side], Column]] = []


def rule(build: Callable[[Side, Side], Column]) -> Callable[[Side, Side], Column]:
    """Register a rule: a builder from the two sides' columns to a flag struct or null."""
    RULES.append(build)
    return build


def _flag(when: Column, code: str | Column, level: int | Column, message: Column, remedy: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(lit(code).alias("code"), lit(level).cast("int").alias("level"), message.alias("message"), F.lit(remedy).alias("remedy")))


def _versus(what: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(what + ": "), a, F.lit(" against "), b)


def series_key(df: DataFrame) -> Column:
    """The eight identifying columns joined by ` | `; a missing column counts as empty. The antigen is no part."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in SERIES_KEY])


@rule
def compartment(a: Side, b: Side) -> Column:
    return _flag(a("compartment") != b("compartment"), "COMPARTMENT", 2, _versus("compartments", a("compartment"), b("compartment")), "compare shapes over own baseline, not levels")


@rule
def sampling_method(a: Side, b: Side) -> Column:
    on = (a("compartment") == b("compartment")) & a("compartment").isin(MUCOSAL) & (a("method") != b("method"))
    shared = (a("normalization") == "total_iga") & (b("normalization") == "total_iga")
    return _flag(on, "SAMPLING_METHOD", F.when(shared, 1).otherwise(2), _versus("devices of unlike dilution", a("method"), b("method")), "normalise both to total IgA, or use fold-rise")


@rule
def assay(a: Side, b: Side) -> Column:
    return _flag(a("assay") != b("assay"), "ASSAY", 2, _versus("assays", a("assay"), b("assay")), "stay within one assay")


@rule
def isotype(a: Side, b: Side) -> Column:
    near = a("isotype").isin("IgA", "sIgA") & b("isotype").isin("IgA", "sIgA")
    return _flag(a("isotype") != b("isotype"), "ISOTYPE", F.when(near, 1).otherwise(2), _versus("isotypes", a("isotype"), b("isotype")), "name the detection reagent; do not pool")


@rule
def normalization(a: Side, b: Side) -> Column:
    left_to_method = a("compartment").isin(MUCOSAL) & (a("method") != b("method"))
    on = (a("normalization") != b("normalization")) & (a("compartment") == b("compartment")) & ~left_to_method
    return _flag(on, "NORMALIZATION", 2, _versus("normalisations", a("normalization"), b("normalization")), "express both in one normalisation")


@rule
def unit(a: Side, b: Side) -> Column:
    pair = F.concat(a("unit"), F.lit(">"), b("unit"))
    known = pair.isin([f"{x}>{y}" for x, y in UNIT_FACTORS])
    note = F.when((a("unit") == "au_ml") | (b("unit") == "au_ml"), " (arbitrary units belong to one lab)").otherwise("")
    return _flag(a("unit") != b("unit"), F.when(known, "UNIT_CONVERTIBLE").otherwise("UNIT"), F.when(known, 1).otherwise(2), F.concat(_versus("units", a("unit"), b("unit")), note), "convert, or use a shared standard")


@rule
def antigen(a: Side, b: Side) -> Column:
    on = (a("antigen") != b("antigen")) & (a("antigen") != "unspecified") & (b("antigen") != "unspecified")
    return _flag(on, "ANTIGEN", 1, _versus("antigens", a("antigen"), b("antigen")), "read as cross-reactivity")


@rule
def lab(a: Side, b: Side) -> Column:
    return _flag(a("lab") != b("lab"), "LAB", 1, _versus("laboratories", a("lab"), b("lab")), "use bridging samples")


@rule
def digitized(a: Side, b: Side) -> Column:
    on = (a("source") == "digitized_from_figure") | (b("source") == "digitized_from_figure")
    return _flag(on, "DIGITIZED", 1, F.lit("read off a figure"), "prefer tables")


@rule
def synthetic(a: Side, b: Side) -> Column:
    return _flag((a("source") == "synthetic") != (b("source") == "synthetic"), "SYNTHETIC_MIX", 2, F.lit("simulated and measured values"), "keep them apart")


def contexts(df: DataFrame, include_antigen: bool = False) -> DataFrame:
    """One row for each series: its key, series_ord (order of first appearance) and the context of its first row.

    df needs row_ord, the input order. Missing or empty context columns take their defaults. The quadratic step works
    on these rows only, so the facts are reduced by one partially aggregated shuffle: by hash to the first row of each
    combination of values, of which there are few, before keys and contexts are made and the first of a series is sought.
    """
    df = df.groupBy(*[c for c in dict.fromkeys((*SERIES_KEY, *CONTEXT)) if c in df.columns]).agg(F.min("row_ord").alias("row_ord"))
    cols = []
    for c in CONTEXT:
        if c in DEFAULTS:
            cols.append((F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DEFAULTS[c])) if c in df.columns else F.lit(DEFAULTS[c])).alias(c))
        else:
            cols.append((F.col(c) if c in df.columns else F.lit(None)).alias(c))
    key = series_key(df)
    if include_antigen:
        key = F.concat_ws(" | ", key, F.coalesce(F.col("antigen"), F.lit("")))
    keyed = df.select(key.alias("series_key"), F.col("row_ord"), F.struct(*cols).alias("context"))
    return keyed.groupBy("series_key").agg(F.min("row_ord").alias("series_ord"), F.min_by("context", "row_ord").alias("context")).select("series_key", "series_ord", "context.*")


def unknown_values(df: DataFrame) -> DataFrame:
    """(field, value, n): values of context columns that no vocabulary has, and how many rows have them. Columns that are
    missing, nulls and, where there is a default, empty texts are not unknown."""
    fields = [c for c in CONTEXT if c in VOCABULARY and c in df.columns]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, value string, n long")
    strange = [F.when(~F.col(c).isin([*VOCABULARY[c], *([""] if c in DEFAULTS else [])]), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c in fields]
    return df.select(F.inline(F.filter(F.array(*strange), lambda x: x.isNotNull()))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add flags (array of structs, in rule order), level (the worst) and verdict to rows with context structs a, b."""
    side = lambda s: lambda c: F.col(f"{s}.{c}")
    flags = F.filter(F.array(*[r(side(a), side(b)) for r in RULES]), lambda f: f.isNotNull())
    out = pairs.withColumn("flags", flags)
    out = out.withColumn("level", F.coalesce(F.array_max(F.transform("flags", lambda f: f["level"])), F.lit(0)))
    return out.withColumn("verdict", F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")))


def verdicts(df: DataFrame, include_antigen: bool = False) -> DataFrame:
    """(key_a, key_b, flags, level, verdict) for each unordered pair of distinct series, first-seen series first."""
    c = contexts(df, include_antigen)
    a = c.select(F.col("series_key").alias("key_a"), F.col("series_ord").alias("ord_a"), F.struct(*CONTEXT).alias("a"))
    b = c.select(F.col("series_key").alias("key_b"), F.col("series_ord").alias("ord_b"), F.struct(*CONTEXT).alias("b"))
    return compare(a.join(b, F.col("ord_a") < F.col("ord_b"))).select("key_a", "key_b", "ord_a", "ord_b", "flags", "level", "verdict")


def matrix(df: DataFrame) -> DataFrame:
    """Square matrix of verdicts; the diagonal is comparable. For display: one column for each series."""
    v = verdicts(df).select("key_a", "key_b", "verdict")
    both = v.unionByName(v.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "verdict"))
    same = contexts(df).select(F.col("series_key").alias("key_a"), F.col("series_key").alias("key_b"), F.lit("comparable").alias("verdict"))
    return both.unionByName(same).groupBy("key_a").pivot("key_b").agg(F.first("verdict"))


def level_map(df: DataFrame) -> DataFrame:
    """(key_a, key_b, level) for every ordered pair of series, 0 on the diagonal: what a heat map shows."""
    v = verdicts(df).select("key_a", "key_b", "level")
    both = v.unionByName(v.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "level"))
    return both.unionByName(contexts(df).select(F.col("series_key").alias("key_a"), F.col("series_key").alias("key_b"), F.lit(0).alias("level")))


def explain_flags(flags: Column) -> Column:
    """Lines of text, worst first, otherwise in rule order."""
    placed = F.transform(flags, lambda f, i: F.struct((-f["level"]).alias("l"), i.alias("i"), f.alias("f")))
    line = lambda p: F.concat(F.lit("["), F.get(F.array(*[F.lit(x) for x in LEVELS]), p["f"]["level"]), F.lit("] "), p["f"]["code"], F.lit(": "), p["f"]["message"], F.lit(" -> "), p["f"]["remedy"])
    return F.array_join(F.transform(F.array_sort(placed), line), "\n")


def audit(df: DataFrame, min_timepoints: int = 4) -> DataFrame:
    """For each series: subjects, timepoints, values below the assay floor, missing values, flags and uncertainty."""
    below = F.coalesce(F.col("below_lloq"), F.lit(False)) if "below_lloq" in df.columns else F.lit(False)
    g = df.groupBy(series_key(df).alias("series")).agg(
        F.countDistinct("subject_id").alias("n_subjects"),
        F.countDistinct("day").alias("n_timepoints"),
        F.count_if(below).alias("below_lloq"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.col("unit") == "au_ml"), F.lit(False)).alias("arbitrary"),
        F.coalesce(F.bool_or(F.rint("day") == 0), F.lit(False)).alias("based"),
    )
    text = lambda c, s: F.concat(F.col(c).cast("string"), F.lit(s))
    flags = F.array(
        F.when(F.col("n_timepoints") < min_timepoints, text("n_timepoints", " timepoints: no curve")),
        F.when(F.col("below_lloq") / F.col("n") > 0.2, text("below_lloq", " below LLOQ: means biased")),
        F.when(F.col("missing") / F.col("n") > 0.15, text("missing", " missing")),
        F.when(F.col("arbitrary"), F.lit("arbitrary units")),
        F.when(~F.col("based"), F.lit("no baseline")),
    )
    out = g.withColumn("flags", F.filter(flags, lambda f: f.isNotNull()))
    sure = F.when(F.size("flags") >= 2, "high").when(F.size("flags") == 1, "medium").otherwise("low")
    return out.select("series", "n_subjects", "n_timepoints", "below_lloq", "missing", "flags", sure.alias("uncertainty"))


#: Columns that a verdict of not_comparable can depend on; of the source only whether it is synthetic matters.
DECISIVE = ("compartment", "method", "assay", "isotype", "normalization", "unit")
#: Kinds of series that are put into groups on the driver; more are in rounds of jobs.
FOLDED = 2000


def comparable_groups(df: DataFrame, folded: int = FOLDED) -> DataFrame:
    """(series_key, grp): each series, in order of appearance, joins the first group in which it is comparable, at
    least conditionally, with every member.

    Series that are alike in the decisive columns have the same foes and are none of each other, so all of a kind go where
    the first of them goes, and only kinds are compared and grouped. Their number is bounded by the vocabularies, not by the
    data; beyond `folded` (free text in those columns) they settle in rounds, each once all its earlier foes have.
    """
    cols = [F.col(c) for c in DECISIVE] + [(F.coalesce(F.col("source"), F.lit("")) == "synthetic")]
    c = written(contexts(df).withColumn("kind", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})), "contexts")
    kinds = c.groupBy("kind").agg(F.min("series_ord").alias("ord"), F.min_by(F.struct(*CONTEXT), "series_ord").alias("x"))
    a, b = (kinds.select(F.col("kind").alias(f"kind_{s}"), F.col("ord").alias(f"ord_{s}"), F.col("x").alias(s)) for s in "ab")
    foes = compare(a.join(b, F.col("ord_a") < F.col("ord_b"))).where("level = 2").select("kind_a", "kind_b")
    few = kinds.select("kind", "ord").limit(folded + 1).collect()
    homes = _folded(few, foes) if len(few) <= folded else _settled(kinds.select("kind"), foes)
    return c.join(homes, "kind").select("series_key", "grp")


def _folded(kinds: list, foes: DataFrame) -> DataFrame:
    earlier: dict[str, list[str]] = {}
    for r in foes.toLocalIterator():
        earlier.setdefault(r.kind_b, []).append(r.kind_a)
    home: dict[str, int] = {}
    for r in sorted(kinds, key=lambda r: r.ord):
        barred = {home[k] for k in earlier.get(r.kind, ())}
        home[r.kind] = next(g for g in range(len(home) + 1) if g not in barred)
    return foes.sparkSession.createDataFrame(list(home.items()), "kind string, grp int")


def _settled(kinds: DataFrame, foes: DataFrame) -> DataFrame:
    """Rounds: kinds whose earlier foes all have a group take the first that none of these has."""
    foes, left = written(foes, "foes"), written(kinds, "kinds")
    homes = left.limit(0).withColumn("grp", F.lit(0))
    while not left.isEmpty():
        blocked = foes.join(left.withColumnRenamed("kind", "kind_a"), "kind_a", "left_semi").select(F.col("kind_b").alias("kind")).distinct()
        met = foes.join(homes.withColumnRenamed("kind", "kind_a"), "kind_a").groupBy(F.col("kind_b").alias("kind")).agg(F.collect_set("grp").alias("barred"))
        now = left.join(blocked, "kind", "left_anti").join(met, "kind", "left")
        barred = F.coalesce("barred", F.array().cast("array<int>"))
        now = now.select("kind", F.array_min(F.array_except(F.sequence(F.lit(0), F.size(barred)), barred)).alias("grp"))
        homes = written(homes.unionByName(now), "groups")
        left = written(left.join(homes, "kind", "left_anti"), "kinds")
    return homes


def label_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of labelled pairs (context structs a and b, expected) that get the expected verdict."""
    return compare(pairs).agg(F.avg((F.col("verdict") == F.col("expected")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
