"""The near-copy stage against all pairs: sets of five-word shingles, Jaccard similarity of 0.8 or more."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titrelake.llm import simhash

from .test_brute_force import shingles, similar


def edited(words, rng, least):
    """The words with changes, as many as the similarity allows."""
    out = list(words)
    while True:
        new = list(out)
        k = rng.randrange(len(new))
        new[k : k + 1] = rng.choice([["new%d" % rng.randrange(10**6)], [], [new[k], "more%d" % rng.randrange(10**6)]])
        x, y = shingles(" ".join(words)), shingles(" ".join(new))
        if len(x & y) < least * len(x | y):
            return " ".join(out)
        out = new


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgÉX") for _ in range(rng.randint(2, 7)))
    rows = []
    for n in (1, 4, 5, 30, 80, 200, 500):
        for _ in range(16):
            w = [word() for _ in range(n)]
            rows += [" ".join(w), edited(w, rng, rng.choice([0.8, 0.8, 0.85, 0.9, 0.6])).replace(" ", rng.choice([" ", "\n", " \t"]))]
    base = [word() for _ in range(150)]
    rows += [edited(base, rng, 0.9) for _ in range(60)]
    rows += [None, "", " \n", rows[3], rows[3].upper().replace("É", "é").replace("é", "É") if rows[3] else "", "x " * 5000, "x " * 4000]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    rows = documents(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, want = {}, similar(dict(rows))
    for r in simhash.similar_groups(d).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    plain = {}
    for i, r in want.items():
        plain.setdefault(r, set()).add(i)
    of = {i: frozenset(g) for g in plain.values() for i in g}
    # no group is too large; at the threshold itself three pairs of a hundred may be lost
    assert all(g <= of[next(iter(g))] for g in got.values())
    pairs = sum(len(g) > 1 for g in plain.values())
    assert pairs > 60 and len(got) - len(plain) <= 0.04 * pairs
    kept = {r.doc_id for r in simhash.drop_near_copies(d).collect()}
    assert kept == {min(g) for g in got.values()}


def test_crowded_entries_lose_nothing(spark):
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(5000) for _ in range(150)]
    rows = [(i, edited(base, rng, 0.9)) for i in range(120)] + [(120 + i, " ".join("v%d" % rng.randrange(5000) for _ in range(60))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for entry in (8, 1 << 15):
        assert len({r.root for r in simhash.similar_groups(d, entry=entry).collect()}) == len(set(similar(dict(rows)).values()))


def test_spanning_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    for radius in (10, 40):
        centres = rng.integers(0, 2, (6, 192), dtype=np.uint8)
        bits = np.concatenate([c ^ (rng.random((40, 192)) < rate).astype(np.uint8) for c, rate in zip(centres, (0.01, 0.05, 0.1, 0.15, 0.2, 0.3))])
        fps = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        near = (bits[:, None] != bits[None]).sum(axis=2) <= radius
        got = simhash.spanning_links(fps, radius)
        assert all(near[i, j] for i, j in got)

        def groups(links):
            root = list(range(len(bits)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in links:
                root[find(i)] = find(j)
            return [find(i) for i in range(len(bits))]

        a, b = groups(got), groups(np.argwhere(near).tolist())
        assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_equal_rows_and_clashing_names(spark):
    t = " ".join("w%d" % i for i in range(40))
    rows = [(2, t, 1, "x"), (2, t, 1, "x"), (1, t + " more", None, "y"), (None, t, 2, "z"), (3, "other text", 3, None), (3, "other text", 3, None), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `__row` int, `a.b` string").withColumns({"root": F.lit(1), "__all": F.lit(2), "fid": F.lit(3)})
    out = simhash.drop_near_copies(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 1, 3]
    assert simhash.drop_near_copies(d.limit(0)).count() == 0
