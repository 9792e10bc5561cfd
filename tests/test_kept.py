"""Tables that grow by batches: against a merge in one go, through deaths at every step, on a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from titrelake.operators import evidence, search
from titrelake.sources import kept

KIND = "study_id string, study_ord long, level string, x int"


def rows(table):
    return {r.study_id: (r.level, r.x) for r in table.read().collect()}


def folded(batches):
    """The same one row at a time."""
    out = {}
    for batch in batches:
        seen = set()
        for key, _, level, x in sorted(batch, key=lambda r: r[1]):
            if key is None or key in seen:
                continue
            seen.add(key)
            if key not in out or out[key][0] == "to_verify":
                out[key] = (level, x)
    return out


def test_batches_equal_a_fold(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(rng.choice([None, *"abcdefghij"]), i, rng.choice(["to_verify", "verified_abstract", None]), rng.randint(0, 99)) for i in range(8)] for _ in range(6)]
    t = kept.evidence(spark, f"{tmp_path}/t")
    t.parts = 3  # so that parts are put together on the way
    assert t.read() is None
    for i, b in enumerate(batches):
        assert t.upsert(spark.createDataFrame(b, KIND), f"b{i}", "study_ord")
        assert not t.upsert(spark.createDataFrame(batches[0], KIND), f"b{i}", "study_ord")
        assert rows(t) == folded(batches[: i + 1])
    before = {(r.study_id, r.ord) for r in t.read().collect()}
    assert len(t.manifest()["parts"]) <= 3 and t.vacuum() > 0 and {(r.study_id, r.ord) for r in t.read().collect()} == before
    assert sorted(os.listdir(tmp_path / "t")) == sorted(["manifests", *[p["folder"] for p in t.manifest()["parts"]]])


def test_order_is_that_of_the_first_row(spark, tmp_path):
    base = [("a", 0, "verified_abstract", 1), ("b", 1, "to_verify", 2)]
    extra = [("b", 0, "llm_extracted", 3), ("a", 1, "llm_extracted", 4), ("c", 2, "to_verify", 5)]
    t = kept.evidence(spark, f"{tmp_path}/t")
    t.upsert(spark.createDataFrame(base, KIND), "base", "study_ord")
    t.upsert(spark.createDataFrame(extra, KIND), "extra", "study_ord")
    once = evidence.merge(spark.createDataFrame(base, KIND), spark.createDataFrame(extra, KIND)).orderBy("study_ord")
    assert [(r.study_id, r.x) for r in t.read().orderBy("ord").collect()] == [(r.study_id, r.x) for r in once.collect()] == [("a", 1), ("b", 3), ("c", 5)]


def test_a_batch_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    t = kept.evidence(spark, f"{tmp_path}/t")
    t.upsert(spark.createDataFrame([("a", 0, "to_verify", 1)], KIND), "one", "study_ord")
    second = spark.createDataFrame([("a", 0, "verified_abstract", 2), ("b", 1, "to_verify", 3)], KIND)
    with monkeypatch.context() as m:
        m.setattr(kept.Kept, "_swap", lambda self, state: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.upsert(second, "two", "study_ord")
    assert rows(t) == {"a": ("to_verify", 1)}
    assert t.upsert(second, "two", "study_ord") and rows(t) == {"a": ("verified_abstract", 2), "b": ("to_verify", 3)}
    assert t.vacuum() == 2 and rows(t)["b"] == ("to_verify", 3)  # the dead part and the first manifest
    with pytest.raises(ValueError, match="the batch"):
        t.upsert(second.withColumn("y", F.lit(1)), "three", "study_ord")


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    a, b = (kept.evidence(spark, f"{tmp_path}/t") for _ in range(2))
    stale = b.manifest()
    a.upsert(spark.createDataFrame([("a", 0, "to_verify", 1)], KIND), "one", "study_ord")
    monkeypatch.setattr(b, "manifest", lambda: dict(stale))
    with pytest.raises(RuntimeError, match="another writer"):
        b.upsert(spark.createDataFrame([("z", 0, "to_verify", 1)], KIND), "other", "study_ord")
    assert rows(a) == {"a": ("to_verify", 1)}


def test_an_empty_batch_and_an_empty_start(spark, tmp_path):
    t = kept.evidence(spark, f"{tmp_path}/t")
    none = spark.createDataFrame([], KIND)
    assert t.upsert(none, "none", "study_ord") and t.read().count() == 0
    assert t.upsert(spark.createDataFrame([("a", 5, None, 1)], KIND), "one", "study_ord") and rows(t) == {"a": (None, 1)}


def test_a_stream_into_a_kept_table(spark, tmp_path):
    t = kept.evidence(spark, f"{tmp_path}/t")
    source = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame([(f"s{i}", i, "to_verify" if k == 0 else "verified_abstract", k) for i in range(k, 4)], KIND).coalesce(1).write.mode("append").parquet(f"{source}")
        q = spark.readStream.schema(KIND).parquet(f"{source}").writeStream.foreachBatch(t.sink("in", "study_ord")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    t.sink("in", "study_ord")(spark.createDataFrame([("s0", 0, "verified_abstract", 9)], KIND), 1)  # tried again
    assert rows(t) == {"s0": ("to_verify", 0), **{f"s{i}": ("verified_abstract", 1) for i in range(1, 4)}}


def test_embeddings_paid_for_stay_paid(spark, tmp_path):
    cache, calls = kept.embeddings(spark, f"{tmp_path}/e"), tmp_path / "calls"
    calls.mkdir()
    docs = spark.createDataFrame([(f"text {i % 40}",) for i in range(90)] + [(None,)], "text string")

    def model(stop):
        def embed(texts):
            if len(os.listdir(calls)) >= stop:
                raise OSError("model gone")
            (calls / str(random.random())).write_text("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    with pytest.raises(Exception, match="model gone"):
        search.embed_missing(docs, cache, "m", model(10), batch=2, flush=10)
    some = cache.read().count()
    assert 0 < some < 40
    assert search.embed_missing(docs, cache, "m", model(1000), batch=2, flush=10) == 40 - some
    assert search.embed_missing(docs, cache, "m", model(0)) == 0  # nothing is asked again
    got = search.embedding_keys(docs.distinct(), "text", "m").join(cache.read(), "key").collect()
    assert len(got) == 40 and all(r.embedding == [float(len(r.text)), 1.0] for r in got)
    assert search.embed_missing(docs, cache, "other model", model(1000), batch=16) == 40
    with pytest.raises(Exception, match="vectors for"):
        search.embed_missing(docs, cache, "short", lambda texts: [[1.0]], batch=16)
