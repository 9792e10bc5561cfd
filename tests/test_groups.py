"""Greedy grouping of comparable series."""

import random

import pytest
from pyspark.sql import functions as F

from titrelake.operators import comparability as cp
from titrelake.schema import CONTEXT

POOL = {
    "compartment": ["nasal", "oral", "serum"],
    "method": ["nasal_wash", "nasosorption", "saliva", "serum"],
    "isotype": ["IgA", "sIgA", "IgG"],
    "assay": ["elisa_binding", "hai"],
    "unit": ["ug_ml", "ng_ml", "au_ml"],
    "normalization": ["none", "total_iga"],
    "lab": ["l1", "l2", "l3"],
    "source": ["measured", "synthetic", "digitized_from_figure"],
    "antigen": ["HA", "NA", "unspecified"],
}


def rows(spark, n, pool=POOL, seed=0):
    r = random.Random(seed)
    data = [(i, *(r.choice(v) for v in pool.values())) for i in range(n)]
    return spark.createDataFrame(data, "row_ord long, " + ", ".join(f"{c} string" for c in pool)).withColumns({"subject_id": F.lit("s"), "day": F.lit(0.0), "value": F.lit(1.0), "lloq": F.lit(None).cast("double")})


def plain(df):
    """The fold over all series by their pairwise verdicts."""
    foes = {(r.key_a, r.key_b) for r in cp.verdicts(df).where("level = 2").collect()}
    groups, home = [], {}
    for r in cp.contexts(df).orderBy("series_ord").collect():
        k = r.series_key
        g = next((i for i, g in enumerate(groups) if not any((x, k) in foes for x in g)), len(groups))
        if g == len(groups):
            groups.append([])
        groups[g].append(k)
        home[k] = g
    return home


@pytest.mark.parametrize("folded", [2000, 0])
def test_same_as_the_fold_over_all_series(spark, folded):
    small = {**POOL, "compartment": ["nasal", "serum"], "method": ["nasal_wash", "serum"], "unit": ["ug_ml", "au_ml"], "normalization": ["none"]} if folded == 0 else POOL
    d = rows(spark, 25 if folded == 0 else 150, small)
    got = {r.series_key: r.grp for r in cp.comparable_groups(d, folded).collect()}
    assert got == plain(d)


def test_only_decisive_columns_decide(spark):
    """Whatever the other columns hold, the level is 2 or not by the decisive ones."""
    d = rows(spark, 400, seed=1)
    v = cp.verdicts(d, include_antigen=True)
    kind = lambda key: F.concat_ws("|", *[F.get(F.split(key, r" \| "), F.lit(i)) for i in range(6)], F.get(F.split(key, r" \| "), F.lit(7)) == "synthetic")
    k = v.select(kind(F.col("key_a")).alias("a"), kind(F.col("key_b")).alias("b"), (F.col("level") == 2).alias("foe"))
    assert k.groupBy("a", "b").agg(F.countDistinct("foe").alias("n")).where("n > 1").isEmpty()
    assert k.where("a = b AND foe").isEmpty()


def test_a_hundred_thousand_series(spark):
    d = spark.range(100_000).select(F.col("id").alias("row_ord"), F.concat(F.lit("lab"), F.col("id")).alias("lab"), *[F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(len(v))) + 1).cast("int")).alias(c) for c, v in POOL.items() if c != "lab"])
    d = d.withColumns({"lloq": F.lit(None).cast("double")})
    out = cp.comparable_groups(d)
    assert out.count() == 100_000 and out.select("grp").distinct().count() < 200
    assert set(CONTEXT) <= set(d.columns)
