"""Nulls, ties, repeated rows, empty tables and clashing names for every operator and stage; SQL; plain re-scoring."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from titrelake.llm import decontamination, html, licenses, mixing, quality, sharding, simhash, substring, urls

NAMES = ["size", "target", "source_size", "taken", "copies", "position", "last_position", "__row", "removed", "a.b", "labels", "score", "predicted", "__all", "__text", "__k0", "__cell", "start", "item_id", "fp"]
BODY = "A long enough sentence stands here, so that a passage of it can be found again in another text of this table today. "


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "x. " + BODY + "One two three four.", "en", "s"), (2, BODY + "Five six seven.", "en", "s"), (2, BODY + "Five six seven.", "en", "s"), (3, None, None, None), (4, "", "fr", None), (None, BODY * 3, "en", "t"), (5, "word " * 30_000, "en", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.withColumns({n: F.lit(i) for i, n in enumerate(NAMES)}).cache()


def test_every_operator_keeps_odd_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, None), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, BODY), (2, None), (None, "Five six seven eight nine ten")], "item_id long, text string")
    same = [
        lambda d: simhash.drop_near_copies(d),
        lambda d: decontamination.drop_leaks(d, bench),
        lambda d: quality.drop_rejected(d, labels),
        lambda d: mixing.mix(d, position=None),
    ]
    for op in same:
        for d in (odd, odd.limit(0)):
            out = op(d)
            assert out.columns == odd.columns
            rows = out.collect()
            assert all([r[i] for r in rows] == [i - 4] * len(rows) for i in range(4, len(odd.columns)))
    removed = substring.remove_repeats(odd)
    assert removed.columns == [c for c in odd.columns if c != "removed"] + ["removed"] and removed.count() == odd.count()
    assert {r.doc_id: len(r.removed) for r in removed.collect()}[2] == 1
    assert substring.remove_repeats(odd.limit(0)).count() == 0
    planned = mixing.plan_mix(odd).collect()
    assert len(planned) == odd.count() and all(r["a.b"] == NAMES.index("a.b") for r in planned)
    scored = quality.score_quality(odd, quality.train(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    shards = sharding.assign_shards(odd)
    assert shards.columns == [*odd.columns, "shard", "slot"] and shards.count() == odd.count()
    assert licenses.scan(odd, keep=("doc_id", "labels", "a.b")).count() == odd.count()
    assert decontamination.find_leaks(odd, bench, keep=("doc_id", "item_id", "a.b")).columns[:2] == ["doc_id", "a.b"]
    assert substring.repeats(odd).where("doc_id IS NULL").count() >= 1


def test_pipeline_stages_on_odd_tables(spark, odd, sf, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this kind stands in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns + (["shard", "slot"] if k == 4 else [])
            out.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            d = spark.read.parquet(f"{tmp_path}/{k}")


def test_urls_on_tables(spark, sf):
    given = [(1, "HTTP://WWW.Example.NET/en/x?q", 9), (2, None, 9), (3, "no scheme", 9), (4, "http://a.org/fr/#x", 9), (4, "http://a.org/fr/#x", 9), (None, "x://net/", 9), (6, "a://example.com/de/" + "y" * 100_000, 9), (7, "a://notexample.com/de/", 9)]
    d = spark.createDataFrame(given, "page_id long, url string, host int")
    got = sorted([(r.page_id or 0, r.host, r.path[:20], r.rule, r.verdict) for r in urls.url_report(d).collect()], key=str)
    assert got == sorted([(1, "www.example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "/fr/", "org/fr/", "allow"), (4, "a.org", "/fr/", "org/fr/", "allow"), (0, "net", "/", "net/", "block"), (6, "example.com", "/de/" + "y" * 16, "example.com/de/", "block"), (7, "notexample.com", "/de/", None, "allow")], key=str)
    assert urls.judge(d).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert urls.url_report(d.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.ORACLE})").fetchall()
    assert sorted(map(tuple, urls.url_report(spark.read.parquet(f"{sf}/pages.parquet")).collect()), key=str) == sorted(want, key=str)


def test_rules_equal_a_scan_of_all_rules():
    rng = random.Random(3)
    label, seg = (lambda: rng.choice(["a", "b", "ab", "net"])), (lambda: rng.choice(["x", "xy", "y", ""]))
    rules = list({(".".join(label() for _ in range(rng.randint(1, 3))) + "/" + "/".join(seg() for _ in range(rng.randint(0, 3)))): v for v in ("allow", "block") for _ in range(60)}.items())
    rules = [(v, r) for r, v in rules]
    root = urls.build(rules)
    for _ in range(3000):
        host, path = ".".join(label() for _ in range(rng.randint(1, 4))), rng.choice(["", "/" + "/".join(seg() for _ in range(rng.randint(0, 4)))])
        fit = [(len(r), len(r.partition("/")[0]), v == "allow", r) for v, r in rules if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        got = urls.find(root, host, path)
        assert got == ((max(fit)[3], max(fit)[2]) if fit else None)


@pytest.mark.parametrize("digits", [None, 1, 5])
def test_mix_equals_sql(spark, sf, digits):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")).alias("source"))
    rows = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    names = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall()
    got = [tuple(r) for r in mixing.plan_mix(docs, digits=digits).select(*names).collect()]
    assert [(*x[:3], round(x[3], 6), *x[4:]) for x in sorted(got)] == [(*x[:3], round(x[3], 6), *x[4:]) for x in sorted(want)]


def test_copies_follow_demand(spark):
    """Beyond two passes each copy stands where demand reaches its own middle."""
    d = spark.createDataFrame([(i, "w " * 10, "s") for i in range(50)], "doc_id long, text string, source string")
    out = mixing.mix(d, amount=4.0, most=4.0, position="at").toPandas().sort_values("at")
    t = np.linspace(0, 1, 4001)
    w = np.interp(t, *zip(*mixing.SCHEDULES[0]))
    c = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert len(out) == 200 and np.allclose(out["at"], np.interp((np.arange(200) + 0.5) / 200, c / c[-1], t), atol=2e-3)


SPACED, STOPS = re.compile(r"[^\x20\x09-\x0D]+"), ".,;:?"


def plain_features(text):
    """The classifier's features of one text, by plain string work."""
    raw, w = text.encode(), [x.encode() for x in SPACED.findall(text)]
    per = lambda a, b: a / b if b else 0.0
    letters = sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw)
    lines = [x for x in raw.split(b"\n") if x]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    odd = set(b"#$%&*+<=>@[\\]^_`{|}~")
    return [
        np.log1p(len(w)), per(sum(map(len, w)), len(w)), per(sum(65 <= b <= 90 for b in raw), letters), per(sum(48 <= b <= 57 for b in raw), len(raw)), per(sum(b in odd for b in raw), len(raw)), per(sum(b in STOPS.encode() for b in raw), len(w)),
        per(len(lines), len(w)), per(raw.count(b"!"), len(w)), per(raw.count(b"|"), len(w)), per(len(set(low)), len(w)), 1 - len(set(lines)) / len(lines) if lines else 0.0, per(len(w), len(lines)),
        per(sum(len(x) <= 2 for x in w), len(w)), per(max((low.count(x) for x in set(low)), default=0), len(w)), per(sum(any(b in odd or b == 33 for b in x) for x in w), len(w)), per(sum(b >= 128 for b in raw), len(raw)),
    ]


def test_features_and_scores_equal_plain_ones():
    rng = random.Random(8)
    texts = ["", " \n ", "É"] + ["".join(rng.choice("aB3é .,!?|#\n~ ") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    x = quality.features(raw, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))))
    assert np.allclose(x, [plain_features(t) for t in texts])
    y = (x[:, 2] > np.median(x[:, 2])).astype(float)
    g = quality.fit(x, y, cycles=10, pair_cycles=5)
    for row, s in zip(x, g.score(x)):
        z = g.base + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(g.single, g.edges, row))
        z += sum(t[sum(e <= row[i] for e in g.coarse[i]), sum(e <= row[j] for e in g.coarse[j])] for i, j, t in g.pairs)
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert len({r.score for r in quality.quality_report(docs, labels).collect()}) == 1
    assert quality.quality_report(docs.limit(0), labels).count() == 0


def test_shards_follow_the_keys(spark):
    """Shards are runs of the sorted keys, slots the place in the run, cuts where the running bytes pass a share."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", None, "", f"t{i}", "é" * rng.randint(1, 99)])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    keyed = sharding._keys(d, "text").select("doc_id", "__k0", "__k1", "__bytes")
    mask = (1 << 64) - 1  # keys are ordered as unsigned numbers
    order = {r.doc_id: (r["__k0"] & mask, r["__k1"] & mask, r["__bytes"]) for r in keyed.collect()}
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(d).collect()}
    ids = sorted(order, key=lambda i: order[i][:2])
    assert [got[i] for i in ids] == sorted(got.values())
    total, at, sums = sum(o[2] for o in order.values()), 0, {}
    for i in ids:
        sums[got[i][0]] = sums.get(got[i][0], 0) + order[i][2]
    assert set(sums) == set(range(16)) and all(abs(s - total / 16) <= 0.004 * total / 16 + 2 * 199 for s in sums.values())


def test_written_shards_come_back(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(d, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_pages_with_odd_columns(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>A good day, and it was long.</p></article>", 1), (1, "u", None, 2)], "page_id long, url string, html string, `a.b` int")
    assert html.extract(d).columns == ["page_id", "url", "a.b", "text", "n_chars"] and html.extract(d).count() == 2
