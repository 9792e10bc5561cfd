"""Streams against batch results."""

import pytest
from pyspark.sql import functions as F

from titrelake.operators import measurements as ms
from titrelake.queries import measurements
from titrelake.schema import MEASUREMENT
from titrelake.session import shared_path
from titrelake.streaming import live_audit, live_baseline


def parts(spark, df, order, n):
    """A folder with n files that a stream reads one by one, rows dealt out by `order`."""
    path = shared_path(spark, "arrivals")
    for k in range(n):
        df.where(order == k).coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(100)
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("idle_ms", [0])
def test_own_baseline_equals_batch(spark, sf, idle_ms):
    """Day-0 rows come first, in the middle and last; corrections make up for it."""
    m = measurements(spark, sf).select("row_ord", "subject_id", "day", "value", "compartment", "method", "isotype", "assay", "unit", "normalization", "lab")
    few = m.where("pmod(cast(subject_id AS int), 4) = 0").withColumn("day", F.when(F.pmod("row_ord", F.lit(5)) < 2, 0.0).otherwise(F.col("day"))).withColumn("subject_id", F.pmod(F.col("subject_id").cast("int"), F.lit(24)).cast("string"))
    turned = (F.col("subject_id") == "0") & (F.pmod(F.xxhash64("row_ord"), F.lit(3)) == 2) & (F.col("day") == 0)
    few = few.withColumn("value", F.when(turned, -1e6).otherwise(F.col("value")))  # a baseline that turns negative at last
    path = parts(spark, few, F.pmod(F.xxhash64("row_ord"), F.lit(3)), 3)
    stream = spark.readStream.schema(few.schema).option("maxFilesPerTrigger", 1).parquet(path)
    updates = run(live_baseline.own_baseline(stream, idle_ms), "update", f"baseline_updates_{idle_ms}")
    got = {r.row_ord: (round(r.baseline, 9), round(r.fold_rise, 9)) for r in live_baseline.latest(updates).collect()}
    want = {r.row_ord: (round(r.baseline, 9), round(r.fold_rise, 9)) for r in ms.fold_rise(few).collect()}
    assert got == want and len(want) > 20
    assert updates.agg(F.max("revision").alias("r")).first().r > 1


def test_windowed_audit_counts_all_rows(spark, sf):
    m = measurements(spark, sf).select(*[F.col(f.name).cast(f.dataType) if f.name in measurements(spark, sf).columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MEASUREMENT], F.timestamp_seconds(F.col("row_ord") * 60).alias("ts"))
    path = parts(spark, m, F.floor(F.col("row_ord") * 0).cast("int"), 1)
    out = run(live_audit.windowed_audit(live_audit.arrivals(spark, path)), "complete", "audit_windows")
    got = out.groupBy("series").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("below_lloq").alias("below")).collect()
    batch = {r.series: (r.below_lloq, r.missing) for r in live_audit_batch(m).collect()}
    assert {r.series: (r.below, r.missing) for r in got} == batch and sum(r.n for r in got) == m.count()


def live_audit_batch(m):
    from titrelake.operators.comparability import audit

    return audit(m)


def test_idle_subjects_are_forgotten(spark):
    """With timers a key's rows go after a while: a row that comes later finds no baseline. Such a stream ends only when stopped."""
    import time

    path = shared_path(spark, "arrivals")
    kind = "row_ord long, subject_id string, day double, value double, compartment string"
    spark.createDataFrame([(1, "a", 0.0, 2.0, "nasal"), (2, "a", 7.0, 6.0, "nasal")], kind).coalesce(1).write.parquet(path)
    q = live_baseline.own_baseline(spark.readStream.schema(kind).parquet(path), 1).writeStream.outputMode("update").format("memory").queryName("idle").trigger(processingTime="500 milliseconds").start()

    def rows(n):
        until = time.time() + 60
        while time.time() < until and spark.table("idle").count() < n:
            time.sleep(1)
        return {r.row_ord: r.fold_rise for r in spark.table("idle").collect()}

    try:
        assert rows(2) == {1: 1.0, 2: 3.0}
        time.sleep(8)  # batches without data run the timers
        spark.createDataFrame([(3, "a", 9.0, 8.0, "nasal"), (4, "b", 0.0, 5.0, "nasal")], kind).coalesce(1).write.mode("append").parquet(path)
        assert rows(3) == {1: 1.0, 2: 3.0, 4: 1.0}
    finally:
        q.stop()


def test_a_call_for_each_subject_and_three_batches(spark, sf):
    """Neither a subject's series nor the number of files add calls: updates of a subject come from three batches at most."""
    from titrelake import session
    from titrelake.queries import QUERIES

    QUERIES["stream_fold_rise"](spark, sf)
    path = [p for p in session._WRITTEN if "/stream-" in p][-1]
    commits = spark.sparkContext._jvm.java.io.File(f"{path}/commits").list()
    assert len([c for c in commits if not c.startswith(".")]) == 3
    held = spark.read.format("statestore").option("stateVarName", "known").load(path)
    assert held.select("key.*").columns == ["subject_id"] and held.count() > 0
