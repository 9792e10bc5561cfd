"""Numeric column expressions: curves, titres, calendar and unit helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def bateman(t: Column, base: Column, amount: Column, ka: Column, ke: Column, lag: Column | None = None) -> Column:
    """Rise and decline after a dose: base + amount * (exp(-ke t) - exp(-ka t)), flat before the lag."""
    s = F.greatest(t - (lag if lag is not None else F.lit(0.0)), F.lit(0.0))
    return base + amount * (F.exp(-ke * s) - F.exp(-ka * s))


def peak_time(ka: Column, ke: Column, lag: Column | None = None) -> Column:
    """Where bateman is largest; the limit lag + 1/ka where both rates are as good as equal."""
    at = F.when(F.abs(ka - ke) <= 1e-8 + 1e-5 * F.abs(ke), 1 / ka).otherwise(F.log(ka / ke) / (ka - ke))
    return at if lag is None else lag + at


def shape_to_rates(peak_day: Column, half_life: Column, baseline: Column, fold: Column, steps: int = 100) -> Column:
    """struct(amount, ka, ke) of the curve with this peak day, half-life and fold over baseline, by bisection on ka."""
    ke = LN2 / half_life
    start = F.struct((ke * 1.0001).alias("lo"), F.lit(50.0).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        late = F.log(mid / ke) / (mid - ke) > peak_day
        return F.struct(F.when(late, mid).otherwise(acc["lo"]).alias("lo"), F.when(late, acc["hi"]).otherwise(mid).alias("hi"))

    def finish(acc: Column) -> Column:
        ka = (acc["lo"] + acc["hi"]) / 2
        return F.struct((baseline * (fold - 1) / (F.exp(-ke * peak_day) - F.exp(-ka * peak_day))).alias("amount"), ka.alias("ka"), ke.alias("ke"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, finish)


def curve_summary(base: Column, amount: Column, ka: Column, ke: Column) -> Column:
    """struct(peak_day, peak_value, half_life_days, fold_rise)."""
    at = peak_time(ka, ke)
    top = bateman(at, base, amount, ka, ke)
    return F.struct(at.alias("peak_day"), top.alias("peak_value"), (LN2 / ke).alias("half_life_days"), F.when(base > 0, top / base).alias("fold_rise"))


def snap_titre(x: Column, start: float = 10.0) -> Column:
    """The nearest two-fold dilution (half-even on the log scale), at least one step below start."""
    steps = F.rint(F.log2(F.greatest(x, F.lit(start / 2)) / start))
    return F.pow(F.lit(2.0), F.greatest(steps, F.lit(-1.0))) * start


def impute_below(value: Column, lloq: Column) -> Column:
    """Half the assay floor for values below it."""
    return F.when(value < lloq, lloq / 2).otherwise(value)


def share_of_total(value: Column, total: Column) -> Column:
    """Specific over total: a dilution common to both cancels. Null where the total is 0 or null."""
    return F.try_divide(value, total)


def lognormal_sd(cv: float) -> float:
    """Standard deviation on the log scale of a log-normal with this coefficient of variation."""
    from math import log, sqrt

    return sqrt(log(1 + cv * cv))


def visit_window(day: Column) -> Column:
    """Days of tolerance around a visit."""
    return F.when(day < 7, 0).when(day < 30, 1).otherwise(3)


def axis_days(unit: Column) -> Column:
    """Days in one step of a figure's time axis."""
    return F.when(unit.isin("week", "weeks"), 7.0).when(unit.isin("month", "months"), 30.0).otherwise(1.0)


def month_bucket(week: Column) -> Column:
    return F.least(F.lit(3), (F.floor((week - 1) / 4) + 1).cast("int"))


def week_start(start: Column, week: Column) -> Column:
    return F.date_add(start, ((week - 1) * 7).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_vector(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))
