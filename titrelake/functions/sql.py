"""The library in SQL: scalar functions, and a table function that fits curves by partition.

    register(spark)
    spark.sql("SELECT bateman(day, 2.0, 8.0, 0.3, 0.02, 0.0) FROM visits")
    spark.sql("SELECT * FROM fit_kinetics(TABLE(SELECT arm_id AS series, day, value FROM m) PARTITION BY series)")

Scalar functions are SQL expressions, which Spark puts into the query's plan, but for stem and stem_counts (stems
of a lower-cased text with their numbers), which remember words by task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import text as tx

_QUOTED = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)

#: name and parameters, type, and the expression
SCALARS = {
    "bateman(t DOUBLE, base DOUBLE, amount DOUBLE, ka DOUBLE, ke DOUBLE, lag DOUBLE)": ("DOUBLE", "base + amount * (exp(-ke * greatest(t - lag, 0.0D)) - exp(-ka * greatest(t - lag, 0.0D)))"),
    "peak_time(ka DOUBLE, ke DOUBLE)": ("DOUBLE", "CASE WHEN abs(ka - ke) <= 1e-8D + 1e-5D * abs(ke) THEN 1 / ka ELSE ln(ka / ke) / (ka - ke) END"),
    "half_life(ke DOUBLE)": ("DOUBLE", "ln(2.0D) / ke"),
    "snap_titre(x DOUBLE)": ("DOUBLE", "10.0D * power(2.0D, greatest(rint(log2(greatest(x, 5.0D) / 10.0D)), -1.0D))"),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0.0D, (s, x) -> s + x * x))"),
    "raw_tokens(t STRING)": ("ARRAY<STRING>", f"filter(regexp_extract_all(lower(t), '[a-z0-9]+', 0), w -> length(w) > 1 AND w NOT IN ({_QUOTED}))"),
}


class FitKinetics:
    """fit_kinetics(TABLE(…) PARTITION BY series [, min_timepoints]): a row for each partition with its series, number of
    values and timepoints, the curve's base, amount, ka and ke, peak_day, half_life_days, and whether it is identifiable.

    The table has series, day and value. Values that are null or not positive take no part. A partition's rows pass one by
    one into a count and a sum of logs by day, so its size is bounded by its days. Series without enough timepoints get nulls.
    """

    def __init__(self) -> None:
        self.days: dict[float, list[float]] = {}
        self.series, self.least = None, 4

    @staticmethod
    def analyze(table: AnalyzeArgument, min_timepoints: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = [f.name for f in table.dataType.fields] if isinstance(table.dataType, StructType) else []
        missing = [c for c in ("series", "day", "value") if c not in names]
        if missing:
            raise ValueError(f"fit_kinetics needs a table with series, day and value; missing: {', '.join(missing)}")
        out = StructType().add("series", table.dataType["series"].dataType).add("n", IntegerType()).add("n_timepoints", IntegerType())
        for c in ("base", "amount", "ka", "ke", "peak_day", "half_life_days"):
            out = out.add(c, DoubleType())
        return AnalyzeResult(out.add("identifiable", BooleanType()))

    def eval(self, row, min_timepoints: int = 4) -> None:
        from math import log10

        self.series, self.least = row["series"], min_timepoints
        if row["value"] is not None and row["value"] > 0 and row["day"] is not None:
            held = self.days.setdefault(float(row["day"]), [0, 0.0])
            held[0] += 1
            held[1] += log10(max(row["value"], 1e-9))

    def terminate(self) -> Iterator[tuple]:
        import numpy as np

        from titrelake.operators.kinetics import fit

        if not self.days:
            return
        days = np.array(sorted(self.days))
        n, s = np.array([self.days[d] for d in days]).T
        theta = fit(days, n, s / n) if len(days) >= self.least else None
        if theta is None:
            yield (self.series, int(n.sum()), len(days), *[None] * 6, False)
            return
        base, amount, extra, ke = map(float, np.exp(theta))
        ka = ke + extra
        yield self.series, int(n.sum()), len(days), base, amount, ka, ke, float(np.log(ka / ke) / (ka - ke)), float(np.log(2) / ke), True


def register(spark: SparkSession) -> None:
    """Make all functions known to the session, under their names."""
    from pyspark.sql.functions import udtf

    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("stem", tx._stems)
    spark.udf.register("stem_counts", tx._stem_counts)
    spark.udtf.register("fit_kinetics", udtf(FitKinetics))
