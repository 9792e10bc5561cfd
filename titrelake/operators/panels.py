"""Frames behind a kinetics figure: a panel for each group of comparable series, a curve for each series and arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .comparability import comparable_groups, series_key
from .kinetics import bands, fits
from .quantiles import quantiles

CURVE = ["grp", "series_key", "arm_id"]


def grouped(df: DataFrame, arm: str = "arm_id") -> DataFrame:
    """Rows with their panel (grp), series_key and arm_id (? where there is none); written once, as all frames read them."""
    rows = df.withColumns({"series_key": series_key(df), "arm_id": F.coalesce(F.col(arm).cast("string"), F.lit("?"))})
    lab = F.col("lab") if "lab" in df.columns else F.lit("lab_1")
    rows = rows.select("series_key", "arm_id", "method", lab.alias("lab"), "subject_id", "day", "value")
    return written(rows.join(comparable_groups(df), "series_key"), "panels")


def panel_points(rows: DataFrame) -> DataFrame:
    """(grp, series_key, arm_id, day, med, n): medians by day of the values that are there. rows: grouped()."""
    d = rows.where("value IS NOT NULL AND day IS NOT NULL")
    return quantiles(d, [*CURVE, "day"], "value", [0.5]).select(*CURVE, "day", F.get("q", F.lit(0)).alias("med"), "n")


def panel_marks(rows: DataFrame, fitted: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each curve: whether it is fitted; the day of its peak, unless that lies beyond the last visit, as that of a
    flat or rising series does; else a note at its last point that says why there is no curve."""
    last = points.groupBy(*CURVE).agg(F.max("day").alias("last_day"), F.max("med").alias("top"), F.count(F.lit(1)).alias("n_days"))
    named = rows.groupBy(*CURVE).agg(F.min("method").alias("method"), F.min("lab").alias("lab"))
    f = fitted.select(*CURVE, "identifiable", "peak_day", "ci_peak_day", "notes")
    out = last.join(named, CURVE).join(f, CURVE, "left").withColumn("identifiable", F.coalesce("identifiable", F.lit(False)))
    why = F.when(F.col("notes").isNull(), "no positive values").otherwise(F.get("notes", F.lit(0)))
    note = F.format_string("%s, %s (%s): %s", "arm_id", "method", "lab", why)
    shown, bare = F.col("identifiable") & (F.col("peak_day") <= F.col("last_day")), ~F.col("identifiable")
    return out.select(
        *CURVE, "identifiable", F.when(shown, F.col("peak_day")).alias("peak_day"), F.when(shown, F.col("ci_peak_day")).alias("ci_peak_day"),
        F.when(bare, note).alias("note"), F.when(bare, F.col("last_day")).alias("note_day"), F.when(bare, F.col("top")).alias("note_value"),
    )


def kinetics_panels(df: DataFrame, arm: str = "arm_id", n_boot: int = 150, points: int = 200, seed: int = 0) -> dict[str, DataFrame]:
    """points, curves (grp, series_key, arm_id, t, y, lo, mid, hi) and marks of a figure of measurements."""
    rows = grouped(df, arm)
    medians, fitted = panel_points(rows), written(fits(rows, CURVE, n_boot, seed=seed), "fits")
    return {"points": medians, "curves": bands(rows, fitted, CURVE, n_boot, points, seed=seed), "marks": panel_marks(rows, fitted, medians)}
