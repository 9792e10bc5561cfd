"""Gating metrics: each evaluation gives rows (name, value, threshold, higher_is_better, passed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.comparability import label_accuracy
from ..operators.evidence import quote_rates
from ..operators.kinetics import fits
from ..schema import CONTEXT
from ..sources.synthetic import PROFILES, Series, arm

# Thresholds, and whether more is better.
THRESHOLDS = {"recall_at_3": (0.70, True), "recall_at_5": (0.80, True), "mrr": (0.60, True), "fakes_rejected": (1.00, True), "accepted": (0.95, True), "peak_day_error": (0.35, False), "ci_coverage": (0.70, True), "accuracy": (1.00, True)}
BASE = dict(compartment="nasal", method="nasosorption", isotype="IgA", assay="elisa_binding", unit="au_ml", normalization="none", antigen="HA", lab="lab_1", source="measured", lloq=None)
# Changes to the base context on either side, and the verdict that experts give.
GOLDEN = (
    ({}, {}, "comparable"),
    ({}, dict(compartment="serum", method="serum"), "not_comparable"),
    ({}, dict(method="nasal_wash"), "not_comparable"),
    (dict(normalization="total_iga", unit="ratio"), dict(normalization="total_iga", unit="ratio", method="nasal_wash"), "conditional"),
    ({}, dict(assay="neutralization"), "not_comparable"),
    ({}, dict(isotype="IgG"), "not_comparable"),
    ({}, dict(isotype="sIgA"), "conditional"),
    (dict(unit="ng_ml"), dict(unit="ug_ml"), "conditional"),
    ({}, dict(lab="lab_2"), "conditional"),
    ({}, dict(antigen="NA"), "conditional"),
    ({}, dict(source="digitized_from_figure"), "conditional"),
    ({}, dict(source="synthetic"), "not_comparable"),
    (dict(compartment="oral", method="saliva"), {}, "not_comparable"),
)
# On which other contexts the same changes get the same verdict, in words of SQL.
HOLDS = (
    "source <> 'digitized_from_figure'", "compartment <> 'serum'", "compartment = 'nasal' AND method <> 'nasal_wash' AND normalization <> 'total_iga'",
    "compartment = 'nasal' AND method <> 'nasal_wash'", "assay <> 'neutralization'", "isotype <> 'IgG'", "isotype = 'IgA'", "true", "lab <> 'lab_2'",
    "antigen NOT IN ('NA', 'unspecified')", "true", "source <> 'synthetic'", "compartment <> 'oral'",
)


def golden_pairs(spark: SparkSession) -> DataFrame:
    kind = "struct<" + ", ".join(f"{c}: {'double' if c == 'lloq' else 'string'}" for c in CONTEXT) + ">"
    side = lambda d: tuple({**BASE, **d}[c] for c in CONTEXT)
    return spark.createDataFrame([(side(a), side(b), v) for a, b, v in GOLDEN], f"a {kind}, b {kind}, expected string")


def labelled(contexts: DataFrame) -> DataFrame:
    """(a, b, expected): the experts' changes made to each context of a table on which their verdict holds."""
    side = lambda d: F.struct(*[(F.lit(d[c]) if c in d else F.col(c)).alias(c) for c in CONTEXT])
    pairs = [F.when(F.expr(on), F.struct(side(a).alias("a"), side(b).alias("b"), F.lit(v).alias("expected"))) for (a, b, v), on in zip(GOLDEN, HOLDS, strict=True)]
    return contexts.select(F.inline(F.filter(F.array(*pairs), lambda x: x.isNotNull())))


def gate(values: DataFrame) -> DataFrame:
    """A one-row frame of metrics to gated rows; metrics without a threshold do not gate."""
    names = [c for c in values.columns if c in THRESHOLDS]
    stack = ", ".join(f"'{n}', cast(`{n}` as double), {THRESHOLDS[n][0]}D, {str(THRESHOLDS[n][1]).lower()}" for n in names)
    rows = values.selectExpr(f"stack({len(names)}, {stack}) AS (name, value, threshold, higher_is_better)")
    return rows.withColumn("passed", F.when(F.col("higher_is_better"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))


def comparability(spark: SparkSession, pairs: DataFrame | None = None) -> DataFrame:
    """The gated accuracy over labelled pairs: golden_pairs if none are given."""
    return gate(label_accuracy(golden_pairs(spark) if pairs is None else pairs))


def kinetics(spark: SparkSession, replicates: int = 8, subjects: int = 40, n_boot: int = 120) -> DataFrame:
    """Fits to simulated arms with a known peak: relative error of the peak day, and coverage by the interval."""
    series = (Series("nasal_iga", "nasosorption", "nasal", "IgA", "elisa_binding", "ug_ml", (0, 3, 7, 10, 14, 21, 28, 56, 90, 180)),)
    data = None
    for k in range(replicates):
        one = arm(spark, f"R{k}", "laiv_like", series, subjects, seed=100 + k)
        data = one if data is None else data.unionByName(one)
    truth = PROFILES["laiv_like"]["nasal_iga"].peak_day
    f = fits(data, ["arm_id"], n_boot)
    inside = F.col("ci_peak_day").isNotNull() & F.lit(truth).between(F.col("ci_peak_day.lo") - 7, F.col("ci_peak_day.hi") + 7)
    return gate(f.agg(F.avg(F.abs(F.col("peak_day") - truth) / truth).alias("peak_day_error"), F.avg(inside.cast("double")).alias("ci_coverage")))


def retrieval(studies: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall and reciprocal rank of the lexical search on a gold set (case_id, query, chunk_id)."""
    chunks = search.chunks(studies)
    queries = gold.select("case_id", F.col("query").alias("text")).distinct()
    hits = search.hybrid(queries, chunks, "case_id", "chunk_id", k=5)
    return gate(search.retrieval_metrics(hits, gold.select("case_id", "chunk_id"), "case_id", "chunk_id"))


def extraction(studies: DataFrame) -> DataFrame:
    """Shares of true quotes accepted and corrupted ones rejected, over findings of studies that have a text."""
    text = F.concat_ws("\n\n", F.nullif(F.col("abstract"), F.lit("")), F.nullif(F.col("full_text_excerpts"), F.lit("")))
    quotes = studies.withColumn("source", text).where("source <> ''").select("source", F.inline("findings")).select("source", "quote")
    return gate(quote_rates(quotes))


def run_all(studies: DataFrame, gold: DataFrame, fast: bool = False) -> DataFrame:
    """Every gated metric: retrieval, extraction, comparability, kinetics (fewer replicates if fast)."""
    spark = studies.sparkSession
    out = retrieval(studies, gold).unionByName(extraction(studies)).unionByName(comparability(spark))
    return out.unionByName(kinetics(spark, 3 if fast else 8, n_boot=60 if fast else 120))
