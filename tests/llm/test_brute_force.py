"""Whole queries of the corpus operators against plain Python."""

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from titrelake.llm import decontamination, licenses, mixing, quality, sharding, simhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def plain_fingerprint(text):
    w = SPACED.findall((text or "").translate(AZ))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps):
    """fps by doc_id to the smallest doc_id reachable by links of three bits or fewer."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(fps), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in fps}


def shingles(text):
    w = SPACED.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(texts):
    """texts by doc_id to the smallest doc_id reachable by links of five-word similarity 0.8 or more; empty texts are a group."""
    sets, root, holders = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        seen = Counter(j for x in sets[i] or {None} for j in holders.get(x, ()))
        for j, n in seen.items():
            if not sets[i] or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in sets[i] or {None}:
            holders.setdefault(x, []).append(i)
    return {i: find(i) for i in texts}


def folded_words(text):
    return ALNUM.findall(re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))


def closest(item, words):
    """Fewest edits from the item to any run of the words."""
    code = {w: i for i, w in enumerate(set(item))}
    b = np.array([code.get(w, -1) for w in words], dtype=int)
    at, row = np.arange(len(b) + 1), np.zeros(len(b) + 1, int)
    for i, w in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (b != code[w]), row[1:] + 1)))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def plain_leaks(docs, items):
    out = set()
    for d, text in docs:
        words = folded_words(text)
        have = Counter(words)
        for i, item in items:
            it = folded_words(item)
            most = int(0.2 * len(it) + 1e-9)
            if it and sum((Counter(it) & have).values()) >= len(it) - most and closest(it, words) <= most:
                out.add((d, i))
    return out


def test_licenses(spark):
    rng = random.Random(1)
    pool = ["cc", "by", "CC", "all", "rights", "reserved", "Reserved.", "general", "public", "license", "é", "x9", "\n", "—", "cc-by", "CC_BY"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "general public"), (303, "all rights"), (304, "license"), (305, "cc"), (None, "cc by cc by"), (1, rows[1][1])]
    got = licenses.license_report(frame(spark, rows)).collect()
    want = []
    for i, text in rows:
        w = ALNUM.findall((text or "").translate(AZ))
        hits = [(k, label) for p, label in BASE.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        at = [k for k, _ in hits]
        want.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(want, key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_simhash(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeÉXY") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 200, 400])))) for i in range(0, 120)]
    for i in range(120, 240):
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, rng.choice([" ", "\t", "  "]).join(w)))
    rows += [(240, None), (241, ""), (242, " \n"), (243, " ")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_report(frame(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    groups = plain_groups(fps)
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}
    assert len(set(groups.values())) < len(rows) - 30


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Éte", "ÀB"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([5, 12, 30, 80])))) for i in range(40)]
    docs = []
    for i in range(160):
        w = text(rng.choice([0, 20, 150]))
        if i % 2:
            p = rng.choice(items)[1].upper().split()
            for _ in range(int(rng.choice([0, 0.1, 0.15, 0.3]) * len(p))):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], ["new"], [p[k], "more"]])
            k = rng.randint(0, len(w))
            w[k:k] = p
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(160, None), (161, ""), (162, items[0][1]), (162, items[0][1])]
    bench = [*items, (40, None), (41, ""), (42, " — ")]
    found = decontamination.leak_report(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got, want = {(r.doc_id, r.item_id) for r in found}, plain_leaks(docs, bench)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40
    words = {i: folded_words(t) for i, t in bench}
    assert all(r.distance == closest(words[r.item_id], folded_words(dict(docs)[r.doc_id])) for r in found if r.distance <= 1)
    left = decontamination.drop_leaks(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i not in {d for d, _ in got})


def test_quality_learns_nothing_from_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    score = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality_report(docs, turned).collect()} == {i: r.score for i, r in score.items()}
    held = [(score[r.doc_id].score, r.quality) for r in labels.collect() if score[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in score.values())


@pytest.mark.parametrize("rows", [0, 1, 3, 500])
def test_shards(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice([i, None]), rng.choice(["", "hot", None, f"é{i}", "x" * rng.randint(1, 300)])) for i in range(rows)]
    out = sharding.shard_report(frame(spark, data)).collect()
    again = sharding.shard_report(frame(spark, data).repartition(2)).collect()
    assert sorted(out, key=str) == sorted(again, key=str) and len(out) == rows
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values()) and set(by) <= set(range(16))
    assert Counter(r.size for r in out) == Counter(len((t or "").encode()) + 1 for _, t in data)
    if rows == 500:
        sums = [sum(r.size for r in by[k]) for k in range(16)]
        assert max(sums) - min(sums) <= 2 * 301


def test_pipeline(spark, sf):
    """Every stage of the pipeline, done plainly on what the stage before kept."""
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality_report(docs, labels).where("score >= 0.7").collect()}
    kept = set(similar({i: text[i] for i in kept}).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept -= {d for d, _ in plain_leaks([(i, text[i]) for i in kept], items)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' WHERE doc_id IN ({', '.join(map(str, kept))})")
    copies = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall() if n}
    assert Counter(r.doc_id for r in out) == Counter(copies)
    assert all(r.text == text[r.doc_id] for r in out)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in shards.values())
    size = lambda r: len(r.text.encode()) + 1
    sums = [sum(map(size, shards.get(k, []))) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * max(map(size, out))
