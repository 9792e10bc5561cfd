"""Fits, replicates and bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrelake.operators import kinetics
from titrelake.sources import synthetic

S = (synthetic.Series("nasal_iga", "nasosorption", "nasal", "IgA", "elisa_binding", "ug_ml", synthetic.DENSE),)


def test_models_have_their_jacobian():
    rng = np.random.default_rng(1)
    theta, t = np.log(rng.uniform(0.01, 3, (5, 4))), rng.uniform(0, 100, (5, 7))
    f, jac = kinetics.models(theta, t)
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-6
        assert np.allclose((kinetics.models(theta + step, t)[0] - f) / 1e-6, jac[:, :, k], atol=1e-4)


def test_rows_are_fitted_as_if_alone():
    rng = np.random.default_rng(2)
    t = np.tile(np.array([0, 3, 7, 14, 28, 60, 120, 180.0]), (12, 1))
    theta = np.log(np.column_stack([rng.uniform(0.5, 3, 12), rng.uniform(2, 9, 12), rng.uniform(0.1, 0.4, 12), rng.uniform(0.01, 0.03, 12)]))
    y = kinetics.models(theta, t)[0]
    n = np.ones_like(t)
    n[::3, 6:] = 0  # short rows
    got = kinetics.fit_many(t, n, y)
    assert np.allclose(kinetics.models(got, t)[0][n > 0], y[n > 0], atol=1e-3)
    for k in range(12):
        on = n[k] > 0
        alone = kinetics.fit(t[k][on], n[k][on], y[k][on])
        assert np.allclose(kinetics.model(alone, t[k])[0][on], kinetics.model(got[k], t[k])[0][on], atol=1e-3)
    assert np.isnan(kinetics.fit_many(t[:1], n[:1], np.full((1, 8), np.nan))).all()


def test_buckets_add_up_to_the_subjects():
    sizes = np.array([3, 0, 5, 1, 7, 2, 9])
    each = np.array([kinetics.draws(sizes, k, 500, seed=4) for k in range(len(sizes))])
    assert (each.sum(axis=0) == sizes.sum()).all() and (each[1] == 0).all()
    assert np.abs(each.mean(axis=1) - sizes).max() < 0.5
    assert (kinetics.draws(np.array([6]), 0, 4, 1) == 6).all()


def subjects(spark):
    r = np.random.default_rng(3)
    rows = [(g, f"s{i}", float(d), float(10 ** r.normal(1 + 0.3 * i / 150, 0.1))) for g in ("a", "b", None) for i in range(150) for d in (0, 7)]
    return spark.createDataFrame(rows, "g string, subject_id string, day double, value double")


@pytest.mark.parametrize("bucket", [2048, 10])
def test_replicates_draw_as_many_subjects_as_there_are(spark, monkeypatch, bucket):
    """In any number of buckets; and the spread of a mean is that of a plain resampler."""
    monkeypatch.setattr(kinetics, "BUCKET", bucket)
    d = subjects(spark)
    got = kinetics.resampled(d.repartition(5), ["g"], 300).groupBy("g", "rep", "day").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m")).toPandas()
    assert len(got) == 3 * 300 * 2 and (got["n"] == 150).all()
    again = kinetics.resampled(d, ["g"], 300).groupBy("g", "rep", "day").agg((F.sum("s") / F.sum("n")).alias("m")).toPandas()
    key = ["g", "rep", "day"]
    assert np.allclose(got.sort_values(key)["m"].to_numpy(), again.sort_values(key)["m"].to_numpy())
    logs = np.log10([r.value for r in d.where("g = 'a' AND day = 7").orderBy("subject_id").collect()])
    r = np.random.default_rng(0)
    plain = np.array([r.choice(logs, 150).mean() for _ in range(3000)])
    own = got[(got["g"] == "a") & (got["day"] == 7)]["m"]
    ends = [0.025, 0.5, 0.975]
    assert np.abs(np.quantile(own, ends) - np.quantile(plain, ends)).max() < 0.25 * plain.std() + 0.2 * plain.std()
    assert abs(own.std() / plain.std() - 1) < 0.15


def test_replicates_fit_their_sums(spark):
    d = subjects(spark).where("g IS NOT NULL")
    days = d.unionByName(d.withColumns({"day": F.col("day") + 20, "value": F.col("value") * 0.7}))
    sums = kinetics.resampled(days, ["g"], 4).groupBy("g", "rep", "day").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m")).toPandas()
    for r in kinetics.replicates(days, ["g"], 4).collect():
        own = sums[(sums["g"] == r.g) & (sums["rep"] == r.rep)].sort_values("day")
        b, a_, kx, ke = np.exp(kinetics.fit(own["day"].to_numpy(), own["n"].to_numpy(), own["m"].to_numpy()))
        assert np.allclose([r.p.base, r.p.amount, r.p.ka, r.p.ke], [b, a_, kx + ke, ke], rtol=1e-6)


def test_bands_hold_the_curve(spark):
    d = synthetic.arm(spark, "A", "laiv_like", S, n=40, seed=5)
    f = kinetics.fits(d, ["arm_id"], n_boot=40)
    b = kinetics.bands(d, f, ["arm_id"], n_boot=80, points=20, horizon=365).orderBy("t").collect()
    assert len(b) == 20 and b[-1].t == 365 and all(r.lo <= r.mid <= r.hi for r in b)
    assert np.mean([r.lo <= r.y <= r.hi for r in b]) > 0.8
    points, lines = kinetics.panels(d, f, ["arm_id"], n_boot=20, points=5)
    assert points.count() == d.where("value > 0").count() and lines.count() == 5
