"""Curve fits with subject-level bootstrap.

Least squares on log10 values needs only the count and mean log of each day, so Spark reduces any number of rows to
one short list of days for each series and replicate; only those lists go to the vectorised fitter. Replicates draw
subjects with replacement, seeded by series and replicate: the same on every run and partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import bateman, curve_summary
from ..session import spread, written
from .quantiles import quantiles

# Bounds of log baseline, log amount, log extra rise rate and log decline rate, and their start.
LOW = np.array([-30.0, -30.0, np.log(1e-3), np.log(1e-4)])
HIGH = np.array([30.0, 30.0, np.log(5.0), np.log(1.0)])
STARTS = np.log([(0.15, 0.03), (0.05, 0.01), (0.6, 0.08)])
LN10 = float(np.log(10))


def models(theta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of many curves (rows of four log parameters) at their own days (rows of t), and the Jacobians."""
    b, a, kx, ke = (x[:, None] for x in np.exp(theta).T)
    up, down = np.exp(-(kx + ke) * t), np.exp(-ke * t)
    f = np.maximum(b + a * (down - up), 1e-300)
    jac = np.stack([b * np.ones_like(t), a * (down - up), a * t * up * kx, a * ke * t * (up - down)], axis=2)
    return np.log10(f), jac / (f * LN10)[:, :, None]


def model(theta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one curve."""
    f, jac = models(theta[None], t[None])
    return f[0], jac[0]


def fit_many(t: np.ndarray, n: np.ndarray, means: np.ndarray, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt with projection on the bounds, from three starts, for all rows at once; nan where nothing finite
    comes out. Rows are lists of days with counts and mean logs; a count of 0 fills up a short row."""
    rows, on = len(t), n > 0
    y, w = np.where(on, np.maximum(means, -9.0), 0.0), np.sqrt(n)
    early = n * (t <= 1)
    least = np.where(on, y, np.inf).min(axis=1)
    low = np.maximum(10 ** np.where(early.any(axis=1), (early * y).sum(axis=1) / np.maximum(early.sum(axis=1), 1e-300), least), 1e-6)
    lift = np.maximum(10 ** np.where(on, y, -np.inf).max(axis=1) - low, low * 0.5)
    x = np.concatenate([np.column_stack([np.log(low), np.log(lift * 1.5), np.full(rows, rise), np.full(rows, fall)]) for rise, fall in STARTS]).clip(LOW, HIGH)
    t, y, w = (np.tile(z, (len(STARTS), 1)) for z in (t, y, w))
    f, jac = models(x, t)
    r, damp = (y - f) * w, np.full(len(x), 1e-2)
    cost = (r**2).sum(axis=1)
    going = np.flatnonzero(np.isfinite(cost))
    for _ in range(steps):
        if not len(going):
            break
        j = jac[going] * w[going][:, :, None]
        h, g = np.einsum("ndi,ndj->nij", j, j), np.einsum("ndi,nd->ni", j, r[going])
        bent = h + damp[going][:, None, None] * (h * np.eye(4) + 1e-9 * np.eye(4)) + 1e-14 * np.eye(4)
        new = (x[going] + np.linalg.solve(bent, g[:, :, None])[:, :, 0]).clip(LOW, HIGH)
        f2, jac2 = models(new, t[going])
        r2 = (y[going] - f2) * w[going]
        cost2 = (r2**2).sum(axis=1)
        better = np.isfinite(cost2) & (cost2 < cost[going])
        settled = better & (cost[going] - cost2 < 1e-10 * (cost[going] + 1e-12))
        at = going[better]
        x[at], r[at], jac[at], cost[at] = new[better], r2[better], jac2[better], cost2[better]
        damp[at] = np.maximum(damp[at] / 5, 1e-12)
        damp[going[~better]] *= 4
        going = going[~settled & (damp[going] <= 1e10)]
    cost = np.where(np.isfinite(cost), cost, np.inf).reshape(len(STARTS), rows)
    best = cost.argmin(axis=0)
    return np.where(np.isfinite(cost.min(axis=0))[:, None], x.reshape(len(STARTS), rows, 4)[best, np.arange(rows)], np.nan)


def fit(days: np.ndarray, counts: np.ndarray, means: np.ndarray) -> np.ndarray | None:
    """The log parameters of one curve; None if nothing finite comes out."""
    got = fit_many(days[None].astype(float), counts[None].astype(float), means[None].astype(float))[0]
    return None if np.isnan(got).any() else got


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("base", "amount", "ka", "ke")]))
def _fit(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for lists in it:
        out = np.full((len(lists), 4), np.nan)
        given = [(i, days) for i, days in enumerate(lists) if days is not None and len(days)]
        for at in range(0, len(given), 2000):
            some = given[at : at + 2000]
            t, n, m = np.zeros((3, len(some), max(len(days) for _, days in some)))
            for k, (_, days) in enumerate(some):
                t[k, : len(days)], n[k, : len(days)], m[k, : len(days)] = zip(*((x["day"], x["n"], x["m"]) for x in days))
            b, a, kx, ke = np.exp(fit_many(t, n, m)).T
            out[[i for i, _ in some]] = np.column_stack([b, a, kx + ke, ke])
        frame = pd.DataFrame(out, columns=["base", "amount", "ka", "ke"]).astype(object)
        yield frame.where(frame.notna(), None)


def _days(weight: Column) -> list[Column]:
    return [F.sum(weight).alias("n"), (F.sum(weight * F.log10(F.greatest("value", F.lit(1e-9)))) / F.sum(weight)).alias("m")]


#: Slots that subjects are hashed into, subjects of a bucket of neighbouring slots, and weights held at a time.
SLOTS, BUCKET, HELD = 4096, 2048, 1 << 22


def _seeded(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k % (1 << 64) for k in key])))


def shares(sizes: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """How many of the subjects drawn in each replicate (as many as there are) fall into each bucket of the given sizes: a row
    for each bucket.

    The drawn number is split in two over and over, binomially by the numbers of subjects on both sides; a split is seeded
    by its range alone, and the buckets of a series add up exactly.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((len(sizes), n_boot), np.int64)
    parts = [(0, len(sizes), np.full(n_boot, int(upto[-1])))]
    while parts:
        lo, hi, drawn = parts.pop()
        if hi - lo <= 1:
            out[lo:hi] = drawn
        elif drawn.any():
            mid = (lo + hi) // 2
            whole = upto[hi] - upto[lo]
            left = _seeded(seed, lo, hi).binomial(drawn, (upto[mid] - upto[lo]) / whole if whole else 0.0)
            parts += [(lo, mid, left), (mid, hi, drawn - left)]
    return out


def draws(sizes: np.ndarray, at: int, n_boot: int, seed: int) -> np.ndarray:
    """The same for bucket `at` alone."""
    return shares(sizes, n_boot, seed)[at]


def _shared(by: list[str], n_boot: int):
    """For rows (by, slots, width, seed) of series a row (by, bucket, seed, drawn) for each bucket that has subjects."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for i in part.to_dict("records"):
                sizes = np.zeros(-(-SLOTS // i["width"]), np.int64)
                for x in i["slots"]:
                    sizes[x["slot"] // i["width"]] += x["n"]
                at = np.flatnonzero(sizes)
                drawn = shares(sizes, n_boot, int(i["seed"]))[at]
                yield pd.DataFrame({**{c: [i[c]] * len(at) for c in by}, "bucket": at.astype(np.int32), "seed": i["seed"], "drawn": list(drawn)})

    return run


def _folded(by: list[str], n_boot: int):
    """For the rows (subject_id, day, c, s) of a bucket the sums over drawn subjects for each replicate and day."""

    def run(key: tuple, rows: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(info):
            i = info.iloc[0]
            drawn = np.asarray(i["drawn"], np.int64)
            names, person = np.unique(rows["subject_id"].to_numpy(str), return_inverse=True)
            days, day = np.unique(rows["day"].to_numpy(float), return_inverse=True)
            sums = np.zeros((2, len(names), len(days)))
            np.add.at(sums[0], (person, day), rows["c"].to_numpy(float))
            np.add.at(sums[1], (person, day), rows["s"].to_numpy(float))
            rng, even, step = _seeded(int(i["seed"]), SLOTS + int(i["bucket"])), np.full(len(names), 1 / len(names)), max(1, HELD // len(names))
            for at in range(0, n_boot, step):
                weights = rng.multinomial(drawn[at : at + step], even)
                n, s = weights @ sums[0], weights @ sums[1]
                r, d = np.nonzero(n)
                out.append(pd.DataFrame({"rep": (at + 1 + r).astype(np.int32), "day": days[d], "n": n[r, d], "s": s[r, d]}))
        told = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"rep": np.zeros(0, np.int32), "day": np.zeros(0), "n": np.zeros(0), "s": np.zeros(0)})
        for c, v in zip(by, key):
            told[c] = v
        return told[[*by, "rep", "day", "n", "s"]]

    return run


def resampled(df: DataFrame, by: list[str], n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(by, rep, day, n, s): number and sum of logs of the values that each bootstrap replicate of each series has on a day.

    A replicate draws as many subjects as the series has, with replacement: multiplicities are multinomial and sum to the
    number of subjects exactly. Subjects are hashed into buckets of bounded size; each draws its share on its own, and
    folds it into sums by replicate and day, so subjects are never gathered and no row is made for each of their draws.
    """
    of_day = df.where("value > 0").withColumn("subject_id", F.coalesce(F.col("subject_id").cast("string"), F.lit(""))).groupBy(*by, "subject_id", "day").agg(F.count(F.lit(1)).alias("c"), F.sum(F.log10(F.greatest("value", F.lit(1e-9)))).alias("s"))
    of_day = written(of_day.withColumn("slot", F.pmod(F.xxhash64("subject_id"), F.lit(SLOTS))), "subject-days")
    slots = of_day.select(*by, "slot", "subject_id").distinct().groupBy(*by, "slot").agg(F.count(F.lit(1)).alias("n"))
    series = slots.groupBy(*by).agg(F.sum("n").alias("total"), F.collect_list(F.struct("slot", "n")).alias("slots"))
    width = F.greatest(F.lit(1), F.least(F.lit(SLOTS), F.floor(F.lit(float(SLOTS) * BUCKET) / F.col("total")))).cast("int")
    series = written(series.withColumns({"width": width, "seed": F.xxhash64(*by, F.lit(seed))}), "series")
    # the splits of a series are drawn once, and a bucket is sent its own share alone
    told = T.StructType([*[series.schema[c] for c in by], *T.StructType.fromDDL("bucket int, seed long, drawn array<long>")])
    info = series.select(*by, "slots", "width", "seed").mapInPandas(_shared(by, n_boot), told)
    same = reduce(lambda x, y: x & y, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"w.`{c}`")) for c in by], F.lit(True))
    rows = of_day.alias("o").join(series.select(*by, "width").alias("w"), same).select(*[F.col(f"o.`{c}`").alias(c) for c in by], (F.floor(F.col("slot") / F.col("width"))).cast("int").alias("bucket"), "subject_id", "day", "c", "s")
    kinds = dict(df.dtypes)
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", rep int, day double, n double, s double"
    return rows.groupBy(*by, "bucket").cogroup(info.groupBy(*by, "bucket")).applyInPandas(_folded(by, n_boot), spec)


def replicates(df: DataFrame, by: list[str], n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(by, rep, p): the curve of each bootstrap replicate of each series. Few and small rows with much work for each: a
    stated number of partitions keeps the fits from being put into one task."""
    tasks = min(200, df.sparkSession.sparkContext.defaultParallelism)
    daily = resampled(df, by, n_boot, seed).groupBy(*by, "rep", "day").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"))
    lists = daily.groupBy(*by, "rep").agg(F.array_sort(F.collect_list(F.struct("day", "n", "m"))).alias("days"))
    return lists.where(F.size("days") >= 2).repartition(tasks, *by, "rep").withColumn("p", _fit("days")).where("p.ke IS NOT NULL").select(*by, "rep", "p")


def fits(df: DataFrame, by: list[str], n_boot: int = 200, min_timepoints: int = 4, enough: int = 20, seed: int = 0, raw: bool = True) -> DataFrame:
    """One row for each series: parameters, summary, 95% intervals, counts, identifiable and notes.

    Values that are null or not positive take no part. Series with too few timepoints are refused: they get the
    medians by day instead of a curve, or nulls where these are not wanted (raw). Fewer than `enough` good replicates give no interval. The columns needed are written
    out once, as counts, medians and replicates each read them.
    """
    d = written(spread(df.where("value > 0").select(*by, "subject_id", "day", "value")), "values")
    counts = d.groupBy(*by).agg(F.countDistinct("subject_id").alias("n_subjects"), F.countDistinct("day").alias("n_timepoints"), F.max("day").alias("last_day"))
    daily = d.groupBy(*by, "day").agg(*_days(F.lit(1.0)))
    if raw:
        daily = daily.join(quantiles(d, [*by, "day"], "value", [0.5]).select(*by, "day", F.get("q", F.lit(0)).alias("med")), [*by, "day"])
    else:
        daily = daily.withColumn("med", F.lit(None).cast("double"))
    lists = daily.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("day", "n", "m"))).alias("days"), F.max_by("day", F.struct("med", (-F.col("day")).alias("d"))).alias("raw_peak_day"), F.max("med").alias("raw_peak"), F.min_by("med", "day").alias("raw_base"))
    ok = lists.join(counts, by)
    point = ok.withColumn("p", _fit(F.when(F.col("n_timepoints") >= min_timepoints, F.col("days"))))
    boot = replicates(d.join(counts.where(F.col("n_timepoints") >= min_timepoints).select(*by), by, "left_semi"), by, n_boot, seed)
    s = curve_summary(F.col("p.base"), F.col("p.amount"), F.col("p.ka"), F.col("p.ke"))
    ends = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    ends_of = boot.withColumn("s", s).groupBy(*by).agg(F.count(F.lit(1)).alias("n_boot"), *[F.percentile(f"s.{c}", ends).alias(f"q_{c}") for c in ("peak_day", "half_life_days", "peak_value", "fold_rise")])
    out = point.withColumn("s", F.when(F.col("p.ke").isNotNull(), s)).join(ends_of, by, "left")
    sure = F.coalesce(F.col("n_boot"), F.lit(0)) >= enough
    lo, hi = (lambda c: F.get(f"q_{c}", F.lit(0))), (lambda c: F.get(f"q_{c}", F.lit(2)))
    few, fitted = F.col("n_timepoints") < min_timepoints, F.col("p.ke").isNotNull()
    notes = F.array(
        F.when(few, F.concat(F.lit("not identifiable: timepoints "), F.col("n_timepoints").cast("string"))),
        F.when(~few & ~fitted, F.lit("no convergence")),
        F.when(fitted & sure & (hi("half_life_days") > 5 * F.greatest(F.col("s.half_life_days"), F.lit(1.0))), F.lit("half-life poorly constrained")),
        F.when(fitted & sure & (hi("peak_day") - lo("peak_day") > 21), F.lit("peak day uncertain")),
        F.when(fitted & ~sure, F.lit("no bootstrap interval")),
        F.when(fitted & (F.col("s.half_life_days") > 3 * F.col("last_day")), F.lit("half-life beyond the data")),
    )
    pair = lambda c: F.when(sure, F.struct(lo(c).alias("lo"), hi(c).alias("hi")))
    return out.select(
        *by, F.coalesce("p.base", "raw_base").alias("baseline"), F.coalesce("s.peak_value", "raw_peak").alias("peak_value"), F.coalesce("s.peak_day", "raw_peak_day").alias("peak_day"),
        F.col("s.half_life_days").alias("half_life_days"), F.col("s.fold_rise").alias("fold_rise"), pair("peak_day").alias("ci_peak_day"), pair("half_life_days").alias("ci_half_life"),
        "n_subjects", "n_timepoints", "last_day", F.coalesce("n_boot", F.lit(0)).alias("n_boot"), (~few & fitted).alias("identifiable"), F.filter(notes, lambda n: n.isNotNull()).alias("notes"), "p",
    )


def _grid(fitted: DataFrame, points: int, horizon: float | None) -> DataFrame:
    """fitted with t, a grid of equal steps up to the horizon (by default the last day, 30 at least)."""
    upto = F.greatest("last_day", F.lit(30.0)) if horizon is None else F.lit(float(horizon))
    grid = fitted.where("p.ke IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.withColumn("t", F.col("i") * upto / (points - 1))


_Y = lambda: bateman(F.col("t"), F.col("p.base"), F.col("p.amount"), F.col("p.ka"), F.col("p.ke"))


def curve(fitted: DataFrame, by: list[str], points: int = 200, horizon: float | None = None) -> DataFrame:
    """(by, t, y) of the fitted curves on a grid."""
    return _grid(fitted, points, horizon).select(*by, "t", _Y().alias("y"))


def bands(df: DataFrame, fitted: DataFrame, by: list[str], n_boot: int = 200, points: int = 200, horizon: float | None = None, seed: int = 0) -> DataFrame:
    """(by, t, y, lo, mid, hi): the fitted curves with the 2.5, 50 and 97.5 % points of their replicates at each t."""
    reps = replicates(df, by, n_boot, seed).join(fitted.where("identifiable").select(*by, "last_day"), by)
    spread = _grid(reps, points, horizon).groupBy(*by, "i").agg(F.percentile(_Y(), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    at = _grid(fitted, points, horizon).select(*by, "i", "t", _Y().alias("y"))
    return at.join(spread, [*by, "i"], "left").select(*by, "t", "y", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("lo", "mid", "hi"))])


def panels(df: DataFrame, fitted: DataFrame, by: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """What a kinetics figure draws: the rows' points, and the curves with their bands."""
    points = df.where("value > 0").select(*by, "subject_id", "day", "value")
    return points, bands(df, fitted, by, **options)
