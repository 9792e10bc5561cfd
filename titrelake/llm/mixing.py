"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Targets come from water filling: shares by weight, no source above `most` passes over its rows. Each source has
a schedule of relative weights over training time 0 to 1. Its integral, scaled to the source's target, is the
demand up to a time; inverting it at a document's cumulative word offset gives the document's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, without

WORDS = r"[^\x20\x09-\x0D]+"
#: Relative weight over time as (time, weight) knots, by class of weight: the heavy class early, the light late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))
ADDED = ["size", "source_size", "target", "copies", "taken", "position", "last_position"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def invert(schedule: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time by which a schedule has asked for `share` (0 to 1) of its whole integral.

    The integral of a piecewise linear weight is quadratic on each piece, so each inverse is a square root.
    """
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    done, out = 0.0, F.lit(schedule[-1][0])
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        slope, start = (w1 - w0) / (t1 - t0), done
        done += (t1 - t0) * (w0 + w1) / 2
        left = F.greatest(share * whole - start, F.lit(0.0))
        # stable form of the root: 2c / (b + sqrt(b*b + 2ac))
        root = 2 * left / F.nullif(F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0))), F.lit(0.0))
        pieces.append((done / whole, t0 + F.coalesce(root, F.lit(0.0))))
    for upto, at in reversed(pieces):
        out = F.when(share <= upto, at).otherwise(out)
    return out


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0) -> DataFrame:
    """totals (source, source_size) with cls, weight and target.

    Water level: the largest of (T - caps of the k fullest) / (weights of the rest) over k, the exact solution of
    sum(min(level * weight, cap)) = T. One row for each source meets in one task; sources are pre-aggregated.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = totals.withColumn("cls", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    t = t.withColumn("weight", F.get(w, F.col("cls"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    rest = F.sum("weight").over(everything) - F.sum("weight").over(full) + F.col("weight")
    left = F.sum("source_size").over(everything) * F.lit(float(amount)) - F.sum("cap").over(full) + F.col("cap")
    t = t.withColumn("level", left / rest)
    return t.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight"))).select("source", "source_size", "cls", "weight", "target")


def _planned(df: DataFrame, keep: list[str], weights, amount: float, most: float, seed: str, digits: int | None, text: str) -> DataFrame:
    """The kept columns of each row of df in the struct __all, with size, source_size, target, cls, copies, and __mid, the words of its source
    up to its own middle. Helpers stand outside the struct, so that no name of df's can clash with theirs."""
    if digits is None:  # of the key, in a cell: about 10,000 rows or fewer of a source, at most 2**24 cells
        digits = min(6, max(3, -(-(df.count() // 10_000).bit_length() // 4)))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__all"),
        n_words(F.col(f"`{text}`")).alias("size"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), body)).alias("__key"),
        F.col("source").isNull().alias("__none"),
        F.coalesce("source", F.lit("")).alias("__src"),
    ).withColumn("__cell", F.substring("__key", 1, digits))
    slim = cut(named.groupBy("__none", "__src", "__cell").agg(F.sum("size").alias("__in")))
    totals = slim.groupBy("__none", "__src").agg(F.sum("__in").alias("source_size")).select(F.when(~F.col("__none"), F.col("__src")).alias("source"), "source_size")
    targets = source_targets(totals, weights, amount, most).withColumns({"__none": F.col("source").isNull(), "__src": F.coalesce("source", F.lit(""))}).drop("source")
    by_cell = Window.partitionBy("__none", "__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.withColumn("__before", F.coalesce(F.sum("__in").over(by_cell), F.lit(0))).drop("__in").join(targets, ["__none", "__src"])
    within = Window.partitionBy("__none", "__src", "__cell").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = named.withColumn("__run", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["__none", "__src", "__cell"])
    middle = 2 * (F.col("__before") + F.col("__run")) + F.col("size")  # twice the middle, to stay in integers
    passes = range(int(-(-most // 1)))
    copies = sum((F.when(middle + 2 * p * F.col("source_size") < 2 * F.col("target"), 1).otherwise(0) for p in passes), F.lit(0))
    return out.withColumns({"copies": copies.cast("int"), "__mid": middle / 2})


def plan_mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: str = "mix", digits: int | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`, so that texts need not move) with size, source_size, target, copies, taken and the training positions of its first and last copy.

    A source's documents stand in the order of md5(seed, doc_id, text); each pass takes those whose middle word
    is below the target. Cumulative sizes come in two steps, over the cells of a source and then within a cell, so no
    source meets in one task. Cells are the first `digits` of the hash, more for more rows; results are the same for any
    number. Null texts and sources are allowed: a null source is a source of its own, last; a null text has size 0. Empty
    tables give empty results; equal rows may differ in copies. Columns with the added names are replaced. Documents that
    are not taken get position 1 or more.
    """
    names = [c for c in without(df, ADDED).columns if keep is None or c in keep]
    out = _planned(df, names or [text], weights, amount, most, seed, digits, text)
    last = F.col("__mid") + F.col("source_size") * (F.greatest("copies", F.lit(1)) - 1)
    added = {"taken": F.col("size") * F.col("copies"), "position": _position(F.col("__mid"), schedules), "last_position": _position(last, schedules)}
    return out.withColumns(added).select(*[F.col("__all")[c].alias(c) for c in names], *ADDED)


def _position(offset: Column, schedules) -> Column:
    share = offset / F.nullif(F.col("target"), F.lit(0.0))
    cases = None
    for i, s in enumerate(schedules):
        on = F.col("cls") % len(schedules) == i
        cases = F.when(on, invert(s, share)) if cases is None else cases.when(on, invert(s, share))
    return F.when(share >= 1, share).otherwise(F.coalesce(cases, F.lit(2.0)))


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: str = "mix", digits: int | None = None, text: str = "text", position: str | None = "position") -> DataFrame:
    """df's columns, one row for each copy that training reads, range-sorted by its position in training.

    Each copy has the position at which demand reaches its own middle. position: the name of the column that holds it (one
    of df's with this name is replaced); None returns df's columns alone. Nulls, repeated rows and empty tables are as in
    plan_mix.
    """
    plan = _planned(df, df.columns, weights, amount, most, seed, digits, text).where("copies > 0")
    rows = plan.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.select("__all", _position(F.col("__mid") + F.col("source_size") * F.col("__copy"), schedules).alias("__at"))
    rows = rows.repartitionByRange(F.col("__at")).sortWithinPartitions("__at")
    names = [c for c in df.columns if position is None or c.lower() != position.lower()]
    return rows.select(*[F.col("__all")[c].alias(c) for c in names], *([F.col("__at").alias(position)] if position else []))


def mix_report(df: DataFrame) -> DataFrame:
    """The contract of op1: one row for each document, range-sorted by its first training position."""
    plan = plan_mix(df.select("doc_id", "text", "source"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return plan.repartitionByRange(F.col("position")).sortWithinPartitions("position").drop("position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
  [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST) + cap)
  / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST) + weight) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target,
  2 * coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * ((middle < 2 * target)::INT + (middle + 2 * source_size < 2 * target)::INT))::BIGINT AS taken,
  (middle < 2 * target)::INT + (middle + 2 * source_size < 2 * target)::INT AS copies FROM r
"""
