"""Notices that are wrapped over lines."""

import random
import textwrap

import numpy as np
import pytest

from titrelake.llm import licenses

MIT = "Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in it."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


@pytest.mark.parametrize("width", [12, 40, 72, 80])
@pytest.mark.parametrize("lead", ["", " * ", "# "])
def test_wrapped_notices(spark, width, lead):
    wrap = lambda t: "\n".join(lead + x for p in t.split("\n") for x in textwrap.wrap(p, width, break_long_words=False) or [""])
    rows = [(1, wrap(MIT)), (2, "Some words first and then " + wrap(BSD) + " and more."), (3, wrap("Permission is given to any person.")), (4, wrap(MIT) + "\n\n" + wrap(BSD))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "bsd", "", "bsd,mit"]
    assert [len(got[i].matches) for i in (1, 2, 3, 4)] == [1, 1, 0, 2] and got[1].score == 1.0


def test_runs_equal_brute_force():
    v = licenses.Vocabulary(licenses.TEMPLATES, licenses.PHRASES)
    join = licenses.Join(v, np.arange(len(v.words))[::-1].copy(), licenses.TEMPLATES, 0.9)
    rng = random.Random(3)
    found = 0
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [rng.choice(v.words + ["x"] * 40) for _ in range(rng.randint(0, 9))]
            t = licenses.words_of(rng.choice(licenses.TEMPLATES)[1])
            words += t if rng.random() < 0.6 else [w for w in t if rng.random() < 0.93]
        first = sorted({0, *(rng.randrange(len(words)) for _ in range(rng.randint(0, len(words) // 2)))}) + [len(words)]
        hits = np.array([k for k, w in enumerate(words) if w in v.id_of], dtype=np.int64)
        ranks = np.array([join.rank[v.id_of[words[k]]] for k in hits], dtype=np.int64)
        want = {}
        for k, (_, t) in enumerate(join.templates):
            for s in range(len(first) - 1):
                end = next((e for e in first if e >= first[s + 1] + join.words[k]), len(words))
                n = len(set(t) & {int(join.rank[v.id_of[w]]) for w in words[first[s] : end] if w in v.id_of})
                if n >= join.need[k]:
                    want[k] = max(want.get(k, 0), n / len(t))
        got = {}
        for k, _, share in join.runs(ranks, hits, first):
            got[k] = max(got.get(k, 0), share)
        assert got == want
        found += len(want)
    assert found > 300


def plain(text, templates, threshold):
    """(label, containment) of every block: a line and those after it until these have as many words as the template."""
    lines = [licenses.words_of(x) for x in text.split("\n")]
    lines = [x for x in lines if x]
    out = []
    for label, t in templates:
        words = licenses.words_of(t)
        for i in range(len(lines)):
            block, n = list(lines[i]), 0
            for later in lines[i + 1 :]:
                if n >= len(words):
                    break
                block += later
                n += len(later)
            share = len(set(words) & set(block)) / len(set(words))
            if share >= threshold - 1e-12:
                out.append((label, share))
    return out


def test_whole_licenses_equal_plain_containment(spark):
    """Wrapped, re-flowed, cut and altered licenses between other lines: labels and scores of the whole scan."""
    rng = random.Random(9)
    every = licenses.TEMPLATES + licenses.WHOLE_TEXTS
    rows = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 120):
        out = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(every)[1].split()
            lose = rng.choice([0, 0.03, 0.08, 0.2])
            t = [w for w in t if rng.random() >= lose]
            t = t[: int(len(t) * rng.choice([1, 1, 0.97, 0.6]))]
            out += textwrap.wrap(" ".join(t), rng.choice([20, 60, 80, 10**6]), break_long_words=False)
            out += ["other words stand here, and more of them " * rng.randint(0, 3)]
        rows.append((i, "\n".join(out)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = 0
    for i, text in rows:
        want = plain(text or "", every, 0.9)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == {k for k, _ in want} | base
        assert got[i].score == pytest.approx(1.0 if base else max((x for _, x in want), default=0.0))
        found += len({k for k, _ in want} & {"mit", "bsd", "isc", "zlib"})
    assert found > 40


def test_kept_columns_with_added_names(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License", "x", 3)], "doc_id long, text string, labels string, `a.b` int")
    r = licenses.scan(d.withColumnRenamed("a.b", "b"), keep=("doc_id", "labels", "b")).first()
    assert (r.labels, r.b) == ("mit", 3)
    long = "one two three four five six seven eight nine ten eleven"
    s = licenses.scan(spark.createDataFrame([(1, "x " + long), (2, long[:-7])], "doc_id long, text string"), phrases={long: "long"}).collect()
    assert [(r.n_base, r.first_word) for r in sorted(s, key=lambda r: r.doc_id)] == [(1, 1), (0, None)]


def test_many_words_one_a_line_take_seconds():
    """The work is linear in the text: whole licenses over and over, a word a line."""
    import time

    templates = licenses.TEMPLATES + licenses.WHOLE_TEXTS
    v = licenses.Vocabulary(templates, licenses.PHRASES)
    join = licenses.Join(v, np.arange(len(v.words))[::-1].copy(), templates, 0.9)
    once = [w for _, t in licenses.WHOLE_TEXTS for w in licenses.words_of(t)]
    times = 100_000 // len(once) + 1
    text = "\n".join(once * times).encode()
    page = licenses.Page(v, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    began = time.process_time()
    found = list(join.runs(join.rank[page.ids[page.hits]], page.hits, [*range(len(page.starts)), len(page.starts)]))
    assert time.process_time() - began < 60
    assert len(page.starts) >= 100_000
    of = {k: sum(1 for x, _, _ in found if x == k) for k in range(len(templates))}
    assert all(of[k] >= times for k in range(len(templates) - len(licenses.WHOLE_TEXTS), len(templates)))
