"""Published methods tables: expanding each cohort's cells to contexts, and comparing cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONTEXT
from .comparability import compare
from .measurements import method_compartment


def expand(cohorts: DataFrame, methods: DataFrame, assays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, unmodelled) of cohorts (name, upper_airway, lower_airway, assays: arrays of verbatim cells).

    methods maps cell to method, assays maps cell to (assay, isotype); isotype `split_IgG_IgA` gives two rows. A cell
    that a map lacks is an error; one mapped to null is listed as unmodelled with the map's note.
    """
    cells = cohorts.select(F.col("name").alias("cohort"), F.explode(F.concat(F.coalesce("upper_airway", F.array()), F.coalesce("lower_airway", F.array()))).alias("cell"))
    tests = cohorts.select(F.col("name").alias("cohort"), F.explode("assays").alias("cell"))

    def mapped(df: DataFrame, table: DataFrame) -> DataFrame:
        known = df.join(table.withColumn("known", F.lit(True)), "cell", "left")
        return known.withColumn("cell", F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("cell without mapping: "), "cell")).cast("string")).otherwise(F.col("cell")))

    m, a = mapped(cells, methods), mapped(tests, assays)
    lost = m.where("method IS NULL").select("cohort", "cell", "note").unionByName(a.where("assay IS NULL").select("cohort", "cell", "note"))
    iso = F.explode(F.when(F.col("isotype") == "split_IgG_IgA", F.array(F.lit("IgG"), F.lit("IgA"))).otherwise(F.array("isotype")))
    both = m.where("method IS NOT NULL").select("cohort", F.col("cell").alias("method_cell"), "method").join(a.where("assay IS NOT NULL").select("cohort", F.col("cell").alias("assay_cell"), "assay", iso.alias("isotype")), "cohort")
    fixed = {"unit": "au_ml", "normalization": "none", "antigen": "unspecified", "source": "measured"}
    both = both.withColumn("label", F.concat_ws(" / ", "cohort", "method_cell", "assay_cell", "isotype"))
    out = both.withColumns({"compartment": method_compartment(F.col("method")), "lab": F.col("cohort"), "lloq": F.lit(None).cast("double"), **{k: F.lit(v) for k, v in fixed.items()}})
    return out, lost


def cross_pairs(contexts: DataFrame) -> DataFrame:
    """Verdicts for every pair of contexts of two different cohorts, the smaller name first."""
    side = lambda s: contexts.select(F.col("cohort").alias(f"cohort_{s}"), F.struct(*CONTEXT).alias(s))
    return compare(side("a").join(side("b"), F.col("cohort_a") < F.col("cohort_b")))


def matrix(contexts: DataFrame) -> DataFrame:
    """(label_a, label_b, verdict) for every ordered pair of contexts, `self` on the diagonal."""
    side = lambda s: contexts.select(F.col("label").alias(f"label_{s}"), F.struct(*CONTEXT).alias(s))
    pairs = compare(side("a").join(F.broadcast(side("b"))))  # a published table has some dozen contexts
    return pairs.select("label_a", "label_b", F.when(F.col("label_a") == F.col("label_b"), "self").otherwise(F.col("verdict")).alias("verdict"))


#: What a field that a methods table leaves out decides.
DECIDES = {
    "unit": "whether two numbers share a scale",
    "normalization": "whether dilution at sampling is cancelled",
    "lloq": "which values are measurements and which are floors",
    "antigen": "what the antibody binds",
    "lab": "which site runs the assay",
}


def gap_report(spark: SparkSession, fields: list[str], explained: dict[str, str] | None = None) -> DataFrame:
    """(field, recorded, decides) for every field that a table does not record; unexplained fields are an error."""
    return spark.createDataFrame([(f, False, why) for f, why in gaps(fields, explained or DECIDES)], "field string, recorded boolean, decides string")


def summary(pairs: DataFrame) -> DataFrame:
    """By pair of cohorts: pairs, undecided (not ruled out), and the codes that rule out."""
    return pairs.groupBy("cohort_a", "cohort_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") < 2).alias("undecided"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.filter("flags", lambda f: f["level"] == 2), lambda f: f["code"]))))).alias("ruled_out_by"))


def shared_methods(contexts: DataFrame, value: str = "method", group: str = "cohort") -> DataFrame:
    """For each method the number and names of the cohorts that use it, most used first."""
    g = contexts.groupBy(value).agg(F.countDistinct(group).alias("n"), F.array_join(F.array_sort(F.collect_set(group)), ", ").alias("used_by"))
    return g.orderBy(F.desc("n"), value)


def gaps(fields: list[str], explained: dict[str, str]) -> list[tuple[str, str]]:
    """(field, why it matters) for every field that a table does not record; unexplained fields are an error."""
    missing = [f for f in fields if f not in explained]
    if missing:
        raise ValueError(f"unexplained: {missing}")
    return [(f, explained[f]) for f in fields]
