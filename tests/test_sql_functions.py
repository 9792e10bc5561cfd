"""The SQL functions against the column functions, and the table function against the operator."""

import pytest
from pyspark.sql import functions as F

from titrelake.functions import math as mx
from titrelake.functions import sql
from titrelake.functions import text as tx
from titrelake.operators import kinetics
from titrelake.sources import synthetic


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def test_scalars(session):
    d = session.createDataFrame([(float(t), 0.3, 0.02, 10.0 * t, [1.0, float(t), 0.5], [2.0, 1.0, float(t)]) for t in range(6)], "t double, ka double, ke double, x double, a array<double>, b array<double>")
    own = session.sql("SELECT bateman(t, 2.0D, 8.0D, ka, ke, 1.0D) AS y, peak_time(ka, ke) AS p, half_life(ke) AS h, snap_titre(x) AS s, cosine(a, b) AS c FROM {d}", d=d)
    want = d.select(mx.bateman(F.col("t"), F.lit(2.0), F.lit(8.0), F.col("ka"), F.col("ke"), F.lit(1.0)).alias("y"), mx.peak_time(F.col("ka"), F.col("ke")).alias("p"), (F.log(F.lit(2.0)) / F.col("ke")).alias("h"), mx.snap_titre(F.col("x")).alias("s"), mx.cosine(F.col("a"), F.col("b")).alias("c"))
    for a, b in zip(own.collect(), want.collect()):
        assert a.asDict() == pytest.approx(b.asDict(), rel=1e-12)


def test_words(session):
    d = session.createDataFrame([("The nasal responses, and the Studies of 12 peaks",), ("",), (None,)], "t string")
    own = session.sql("SELECT transform(raw_tokens(t), w -> w) AS w FROM {d}", d=d).collect()
    assert [r.w for r in own] == [r.w for r in d.select(tx.raw_tokens(F.col("t")).alias("w")).collect()]
    assert session.sql("SELECT stem('studies') AS s").first().s == tx.stem_word("studies")


def test_fits_by_partition(session):
    s = (synthetic.Series("nasal_iga", "nasosorption", "nasal", "IgA", "elisa_binding", "ug_ml", synthetic.DENSE),)
    m = synthetic.arm(session, "A", "laiv_like", s, n=25, seed=7).unionByName(synthetic.arm(session, "B", "iiv_im_like", s, n=25, seed=8))
    m = m.unionByName(m.where("arm_id = 'A' AND day < 10").withColumn("arm_id", F.lit("few"))).repartition(4)
    got = {r.series: r for r in session.sql("SELECT * FROM fit_kinetics(TABLE(SELECT arm_id AS series, day, value FROM {m}) PARTITION BY series)", m=m).collect()}
    assert got.keys() == {"A", "B", "few"} and not got["few"].identifiable and got["few"].ke is None
    for r in kinetics.fits(m, ["arm_id"], n_boot=2).where("identifiable").collect():
        assert (got[r.arm_id].peak_day, got[r.arm_id].half_life_days, got[r.arm_id].n_timepoints) == pytest.approx((r.peak_day, r.half_life_days, r.n_timepoints), rel=1e-3)
    assert session.sql("SELECT * FROM fit_kinetics(TABLE(SELECT arm_id AS series, day, value FROM {m}) PARTITION BY (series), 3)", m=m).where("series = 'few'").first().identifiable


def test_a_table_without_the_columns_is_refused(session):
    with pytest.raises(Exception, match="series, day and value"):
        session.sql("SELECT * FROM fit_kinetics(TABLE(SELECT 1 AS day) WITH SINGLE PARTITION)").collect()
