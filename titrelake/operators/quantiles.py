"""Exact quantiles by group, whatever the size of a group.

A built-in percentile holds the distinct values of a group in one task. That is fine for groups up to `limit` rows. The
values of larger groups are never gathered: they are counted once by distinct value, then each wanted rank is sought in
rounds. A round cuts the interval that holds a rank into bins of equal width, counts them with partial aggregation, and goes
on with the bin that holds the rank, until the interval has few distinct values; these are put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of a group that a built-in percentile may hold, bins of a round, and distinct values that are put in order.
LIMIT, BINS, FEW = 1_000_000, 4096, 100_000


def _scale(v: Column) -> Column:
    """A non-decreasing function of v that spreads many orders of magnitude; infinities stay at the ends."""
    return F.greatest(F.least(F.signum(v) * F.log1p(F.abs(v)), F.lit(1000.0)), F.lit(-1000.0))


def _matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """left joined with right on `by`, nulls alike; right's keys are dropped. extra sees both sides' other columns."""
    r = right.select(*[F.col(f"`{c}`").alias(f"__r{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(by)], F.lit(True))
    out = left.join(r, on if extra is None else on & extra, how)
    return out.drop(*[f"__r{i}" for i in range(len(by))]) if how not in ("left_semi", "left_anti") else out


def _searched(d: DataFrame, sizes: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """(by, q, n) of the groups in sizes (by, n), all large; d has by and __v."""
    slots = F.array(*[F.lit(float(p)) for p in probs])
    base = written(_matched(d, sizes.select(*by), by, "left_semi").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("c")).withColumn("t", _scale(F.col("__v"))), "quantiles")
    ends = base.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("m"))
    places = sizes.withColumn("p", F.explode(slots)).withColumn("at", F.col("p") * (F.col("n") - 1))
    ranks = places.select(*by, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("j")).distinct().withColumn("rank", F.col("j"))
    wanted = written(_matched(ranks, ends, by), "ranks")
    while (wanted.agg(F.max("m").alias("m")).first().m or 0) > FEW:
        open_ = wanted.where((F.col("m") > FEW) & (F.col("hi") > F.col("lo")))
        rest = wanted.where((F.col("m") <= FEW) | (F.col("hi") <= F.col("lo")))
        if open_.isEmpty():
            break
        spans = open_.select(*by, "lo", "hi").distinct()
        inside = _matched(base, spans, by, extra=F.col("t").between(F.col("lo"), F.col("hi")))
        # subtraction, division by a positive number and floor keep the order of values, so bins are intervals of them
        numbered = inside.withColumn("bin", F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        bins = numbered.groupBy(*by, "lo", "bin").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m"), F.min("t").alias("a"), F.max("t").alias("b"))
        upto = bins.withColumn("end", F.sum("c").over(Window.partitionBy(*by, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        spots = upto.select(*by, F.col("lo").alias("from"), "m", "a", "b", "end", "c")
        holds = (F.col("lo") == F.col("from")) & (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c"))
        nearer = _matched(open_.drop("m", "hi"), spots, by, extra=holds)
        nearer = nearer.select(*by, "j", (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), F.col("a").alias("lo"), F.col("b").alias("hi"), "m")
        wanted = written(rest.select(*nearer.columns).unionByName(nearer), "ranks")
    last = _matched(base, wanted.select(*by, "lo", "hi").distinct(), by, extra=F.col("t").between(F.col("lo"), F.col("hi")))
    upto = last.withColumn("end", F.sum("c").over(Window.partitionBy(*by, "lo").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    spots = upto.select(*by, F.col("lo").alias("from"), "end", "c", "__v")
    holds = (F.col("lo") == F.col("from")) & (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c"))
    found = _matched(wanted.select(*by, "j", "rank", "lo"), spots, by, extra=holds).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("j", "__v"))).alias("of"))
    whole = _matched(sizes, found, by)

    def value(p: Column) -> Column:
        at = p * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("of", low), F.element_at("of", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return whole.select(*by, F.transform(slots, value).alias("q"), "n")


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], limit: int = LIMIT) -> DataFrame:
    """(by, q, n): the quantiles of each group in the order of probs, interpolated between neighbouring values, and the number
    of values. Null and NaN values do not count; a group without values is absent. Null keys are a group of their own.

    A table of up to `limit` rows (counted once, without reading columns) cannot hold a larger group: one aggregation does.
    """
    d = df.select(*[F.col(f"`{c}`") for c in by], F.col(f"`{value}`").cast("double").alias("__v"))
    d = d.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    plain = lambda x: x.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"), F.count(F.lit(1)).alias("n"))
    if df.count() <= limit:
        return plain(d)
    sizes = written(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "groups")
    if sizes.isEmpty():
        return plain(d)
    return plain(_matched(d, sizes.select(*by), by, "left_anti")).unionByName(_searched(d, sizes, by, probs))
