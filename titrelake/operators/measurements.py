"""Measurement tables: the column contract, constraints, units, own-baseline ratios and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS, FOLD_KEY, METHOD_COMPARTMENT, REQUIRED, UNIT_FACTORS, VOCABULARY
from .quantiles import quantiles


def with_contract(df: DataFrame) -> DataFrame:
    """Fail if a required column is missing; add optional ones with their defaults; NaN becomes null.

    row_ord, the input order, is added where it is missing: rows of one file in its order, files one after the other.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c, v in {**DEFAULTS, "arm_id": "A", "below_lloq": False}.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    if "row_ord" not in df.columns:
        df = df.withColumn("row_ord", F.monotonically_increasing_id())
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c, t in df.dtypes if t == "double"})


def method_compartment(method: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in METHOD_COMPARTMENT.items() for x in kv]), method)


def rejects(df: DataFrame) -> DataFrame:
    """Rows that break the vocabulary, or whose method does not sample the stated compartment, with reasons."""
    reasons = [F.when(~F.col(c).isin(v), F.lit("unknown " + c)) for c, v in VOCABULARY.items() if c in df.columns]
    reasons.append(F.when(method_compartment(F.col("method")) != F.col("compartment"), F.lit("method outside compartment")))
    return df.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull())).where(F.size("reasons") > 0)


def trial_rejects(trials: DataFrame) -> DataFrame:
    """Trial designs (schema TRIAL) that break a rule, with reasons."""
    none = F.lit(None).cast("string")
    sampled = F.transform("sampling", lambda s: s["method"])
    reasons = F.array(
        F.when(F.col("dose_days") != F.array_sort("dose_days"), "dose days not sorted").otherwise(none),
        F.when((F.col("age_min") < 0) | (F.col("age_max") < F.col("age_min")), "ages").otherwise(none),
        F.when(F.exists("endpoints", lambda e: ~F.array_contains(sampled, e["method"])), "endpoint without sampling").otherwise(none),
        F.when(F.exists("sampling", lambda s: s["day"] > F.col("follow_up_days")), "sampling after follow-up").otherwise(none),
        F.when((F.col("n_participants") < 1) | (F.col("max_visits") < 2) | F.exists("sampling", lambda s: s["window_days"] < 0), "out of bounds").otherwise(none),
    )
    return trials.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).where(F.size("reasons") > 0)


def harmonize_units(df: DataFrame, target: str = "ug_ml", convert_lloq: bool = False) -> DataFrame:
    """Values in units that convert to the target, converted. The assay floor stays unless convert_lloq."""
    for (src, dst), factor in UNIT_FACTORS.items():
        if dst == target:
            on = F.col("unit") == src
            more = {"lloq": F.when(on, F.col("lloq") * factor).otherwise(F.col("lloq"))} if convert_lloq else {}
            df = df.withColumns({"value": F.when(on, F.col("value") * factor).otherwise(F.col("value")), **more, "unit": F.when(on, F.lit(target)).otherwise(F.col("unit"))})
    return df


def fold_rise(df: DataFrame) -> DataFrame:
    """Rows with a value and a positive own baseline, with baseline and fold_rise.

    The baseline is the median of the day-0 values of the same subject and series. It is aggregated from day-0 rows
    only and joined null-safely, so the larger side is shuffled once.
    """
    keys = ["subject_id", *[c for c in FOLD_KEY if c in df.columns]]
    d = df.where(F.col("value").isNotNull())
    base = quantiles(d.where("day = 0"), keys, "value", [0.5]).select(*keys, F.get("q", F.lit(0)).alias("baseline")).where("baseline > 0")
    base = base.select(*[F.col(k).alias("__" + k) for k in keys], "baseline")
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col("__" + k))
        on = same if on is None else on & same
    return d.join(base, on).drop(*["__" + k for k in keys]).withColumn("fold_rise", F.col("value") / F.col("baseline"))


def fold_quartiles(df: DataFrame) -> DataFrame:
    """Quartiles of fold-rise by compartment, method, arm and day."""
    by = ["compartment", "method", "arm_id", "day"]
    at = [F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "med", "q3"))]
    return quantiles(fold_rise(df), by, "fold_rise", [0.25, 0.5, 0.75]).select(*by, "n", *at)


def median_by_day(df: DataFrame, by: list[str]) -> DataFrame:
    return quantiles(df.where("value > 0"), [*by, "day"], "value", [0.5]).select(*by, "day", F.get("q", F.lit(0)).alias("med"), "n")


def peak_by_median(df: DataFrame, by: list[str]) -> DataFrame:
    """For each group the first day with the largest median, and the first day's median as baseline."""
    m = median_by_day(df, by)
    first_max = F.max_by("day", F.struct("med", (-F.col("day")).alias("d")))
    return m.groupBy(*by).agg(first_max.alias("peak_day"), F.max("med").alias("peak_value"), F.min_by("med", "day").alias("baseline"), F.count(F.lit(1)).alias("n_timepoints"))


def record_diff(a: dict, b: dict) -> list[tuple[str, object, object]]:
    """Fields in which two flat records differ, null-safely, in name order."""
    return [(k, a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
