"""Runs of words against every period tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np

from titrelake.llm import runs


def plain(w, least=12):
    """(start, length, period) of all runs: for each period, stretches that agree with themselves so many words later."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def texts(seed, many):
    r = random.Random(seed)
    for _ in range(many):
        w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 90))]
        if w and r.random() < 0.5:
            a, p = r.randrange(len(w)), r.randint(1, len(w))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w


def test_all_runs_are_found(monkeypatch):
    for near, chunk, least in ((24, 1 << 20, 12), (1, 1 << 20, 12), (2, 9, 2), (3, 40, 5)):
        monkeypatch.setattr(runs, "NEAR", near)
        monkeypatch.setattr(runs, "CHUNK", chunk)
        some = list(texts(near, 400))
        got = runs.find(np.array([x for w in some for x in w]), np.cumsum([0, *map(len, some)]), least)
        want = [(k, *r) for k, w in enumerate(some) for r in sorted(plain(w, least), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in got.tolist()] == want


def test_long_texts_take_seconds():
    for w in (np.zeros(300_000, np.int64), np.arange(300_000) % 7, np.tile(np.random.default_rng(0).integers(0, 9, 100_000), 3)):
        r = runs.find(w, np.array([0, len(w)]))
        assert r[:, 2].max() == 300_000


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = plain(w)
    r.sort(key=lambda x: (x[0], x[2]))
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
    gone = {i for s, m, q in r for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(r), *best, best[1] * 1000 // best[2] if r else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in r)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report_and_edges(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab é c d".split(" ")) for _ in range(r.randint(0, 60))), "x", i) for i in range(300)]
    rows += [(300, None, None, None), (301, "", "", 0), (302, " \t\n ", "", 0), (None, "a " * 40, "", 0), (303, "x", "", 1), (303, "x", "", 1), (304, "b\x00 " * 30 + "\x0b\x85", "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs long").repartition(5)
    assert any(zlib.crc32(str(x[0]).encode()) % 10 == 0 for x in rows)
    got = runs.run_report(d).collect()
    assert sorted(map(tuple, got), key=str) == sorted((contract(x[0], x[1]) for x in rows), key=str)
    whole = runs.find_runs(d.withColumnRenamed("n_runs", "RUNS2"))
    assert whole.columns == ["doc_id", "text", "RUNS2", "runs", "collapsed"]
    for x in whole.collect():
        assert [tuple(y) for y in x.runs] == sorted(plain(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")), key=lambda y: (y[0], y[2]))
    assert {x.collapsed for x in whole.where("doc_id IS NULL").collect()} == {"a"}
    assert runs.run_report(d.limit(0)).count() == 0 == runs.find_runs(d.limit(0)).count()


def test_query_over_documents(spark, sf):
    from titrelake.llm.queries import QUERIES

    got = {r.doc_id: tuple(r) for r in QUERIES["op11_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 6000 or zlib.crc32(str(d.doc_id).encode()) % 10 == 0:
            assert got[d.doc_id] == contract(d.doc_id, d.text)
