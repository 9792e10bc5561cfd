"""Corpus operators: brute force, planted cases and edge cases."""

import random
import zlib

import numpy as np
import pytest

from titrelake.llm import components, decontamination, html, licenses, mixing, quality, sharding, simhash, substring, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, position string, `__x` int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(20000))
    texts = [" ".join(word() for _ in range(rng.randint(30, 90))) + "." for _ in range(40)]
    texts += [texts[0]] * 5 + [None, "", " \n ", long, "Released under the MIT License.", "x CC by y"]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", 1, "a", "b", None) for i, t in enumerate(texts)]
    rows += [(None, "null id text here", None, None, None, None, None, None)] + [rows[1]] * 2
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_edge_tables_do_not_crash(docs, none, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, docs.first().text)], "item_id long, text string")
    for d, n in ((docs, docs.count()), (none, 0)):
        assert mixing.mix_report(d).count() == n
        assert sharding.shard_report(d).count() == n
        assert sharding.assign_shards(d).columns.count("shard") == 1
        assert simhash.simhash_report(d).count() == n
        assert licenses.license_report(d).count() == n
        assert quality.quality_report(d, labels).count() == n
        assert (substring.repeat_report(d).count() > 0) == bool(n)
        assert (decontamination.leak_report(d, bench).count() > 0) == bool(n)
        assert mixing.mix(d).select("position").count() >= n // 2
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_shards(docs):
    r = sharding.shard_report(docs).toPandas()
    for _, g in r.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    rows = {x.doc_id: x.text for x in docs.collect()}
    assert all(x.text_crc32 == zlib.crc32((rows[x.doc_id] or "").encode()) for x in r.dropna(subset=["doc_id"]).itertuples())


def test_hot_group_is_split(spark):
    d = spark.range(4000).selectExpr("id AS doc_id", "if(id < 2500, 'same text', concat('t', id)) AS text", "'s' AS source")
    r = sharding.shard_report(d).groupBy("shard").sum("size").toPandas()
    assert len(r) == 16 and r["sum(size)"].max() / r["sum(size)"].mean() < 1.02


def test_mix_targets(docs):
    m = mixing.mix_report(docs).toPandas()
    assert (m.taken <= 2 * m["size"]).all()
    assert abs(m.drop_duplicates("source_size").target.sum() - 1.5 * m["size"].sum()) < 1


def test_curriculum_inverse(spark):
    from pyspark.sql import functions as F

    for s in mixing.SCHEDULES:
        u = spark.range(11).select((F.col("id") / 10.0).alias("u")).select("u", mixing.invert(s, F.col("u")).alias("t")).toPandas()
        t = np.linspace(0, 1, 2001)
        w = np.interp(t, *zip(*s))
        c = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(u.u, c / c[-1], t), u.t, atol=2e-3)


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c d".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > 2)
    assert simhash.fingerprint(b"A b\tC d") == want and simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"Ab") == xxhash.xxh64_intdigest(b"ab", 42)


@pytest.mark.parametrize("entry", [4, 2048])
def test_links_find_all_components(spark, entry):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, entry)).collect()
    root = {r.node: r.root for r in got}
    ours, theirs = {}, {}
    for i, s in enumerate(signed):
        ours.setdefault(root.get(s, s), set()).add(s)
        theirs.setdefault(find(i), set()).add(s)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_chain_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 3)], "a long, b long")
    r = components.components(e).collect()
    assert {x.root for x in r} == {0} and len(r) == 200


def test_urls():
    root = urls.build()
    case = {"https://a.Example.NET/en/1?x": "example.net/en/", "http://b.net/x": "net/", "http://x.org/fr/": "org/fr/", "http://x.org/de/": None, "http://example.com/de/#a": "example.com/de/", "http://net": None}
    for u, rule in case.items():
        hit = urls.find(root, *urls.parts(u))
        assert (hit[0] if hit else None) == rule
    assert urls.parts(None) == ("", "") and urls.parts("no scheme/x") == ("", "")


def test_license_join_equals_brute_force():
    v = licenses.Vocabulary(licenses.TEMPLATES, licenses.PHRASES)
    join = licenses.Join(v, np.arange(len(v.words))[::-1].copy(), licenses.TEMPLATES, 0.6)
    rng = random.Random(2)
    for _ in range(500):
        block = sorted(rng.sample(range(len(v.words)), rng.randint(1, 30)))
        want = {k for k, (_, t) in enumerate(join.templates) if len(set(t) & set(block)) >= join.need[k]}
        assert {k for k, _ in join.matches(block, len(block))} == want


def test_topk_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [((i * 37 + j * 11) % 19 - 9) / 10 for j in range(6)]) for i in range(120)]
    rows += [(200, [nan] * 6), (220, None), (240, [inf] + [0.0] * 5), (260, [None] * 6), (280, [0.5, 0.5]), (None, [1.0] * 6), (20, rows[3][1])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), pivots=5, cell=16, block=2).collect()
    v = [(i, np.floor(64 * np.array((x + [0.0] * 6)[:6], np.float32).astype(float)).astype(int)) for i, x in rows if i is not None and x and all(e is not None and np.isfinite(e) for e in x)]
    queries = {}
    for i, x in v:
        if i % 20 == 0 and (i not in queries or tuple(x) < tuple(queries[i])):
            queries[i] = x
    for qid, qx in queries.items():
        want = sorted(((-int(qx @ x), i) for i, x in v if i != qid))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((g for g in got if g.query_id == qid), key=lambda r: r.rank)] == want
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination_recall():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(14, 60)))) for i in range(100)]
    index = decontamination.Index(items)
    found = 0
    for n, w in enumerate(index.words):
        x = w.tolist()
        for _ in range(int(0.15 * len(x))):
            x[rng.randrange(len(x))] = 0
        s = np.array([0] * 9 + x + [0] * 9, np.int32)
        found += any(h[1] == n for h in index.hits(s, np.zeros(len(s), np.int64)))
    assert found >= 95


def test_edit_distance():
    a = np.array([1, 2, 3, 4, 5])
    assert decontamination.edit_distance(a, np.array([9, 1, 2, 4, 5, 9]), 2) == (1, 1, 5)
    assert decontamination.edit_distance(a, np.array([9, 9]), 2)[0] == 3


def test_repeats_keep_the_first(spark):
    p = "This long passage has a good many words and it stands in more than one of the documents that we test here today."
    d = spark.createDataFrame([(1, "Start. " + p + " End of one."), (2, "Other words first. " + p), (3, "Clean text of its own.")], "doc_id long, text string")
    r = substring.repeat_report(d).collect()
    assert [(x.doc_id, x.kept_doc_id) for x in r] == [(2, 1)]
    kept = {x.doc_id: x.text for x in substring.remove_repeats(d).collect()}
    assert kept[1] == "Start. " + p + " End of one." and p not in kept[2] and kept[3] == "Clean text of its own."


@pytest.mark.parametrize("hot", [1, 30, 10**6])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    line = [" ".join(word() for _ in range(rng.choice([2, 6, 14, 70]))) + "." for _ in range(25)]
    text = lambda: "".join(rng.choice([line[0], rng.choice(line), word() + " " + word() + "!"]) + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randint(0, 12)))
    rows = [(i, text(), "doc") for i in range(60)] + [(60, None, "a"), (61, "", "b"), (None, text(), None), (None, line[3] + " " + line[4], "c")]
    rows += [rows[5], rows[5], (7, text(), "doc")]
    d = spark.createDataFrame(rows, "doc_id long, text string, hi string")
    hashes = {(r.doc_id, r.text, r.hi): r.h for r in d.withColumn("h", substring.row_hash(d)).collect()}
    first, want = {}, []
    for doc in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r])):
        raw = (doc[1] or "").encode()
        run = []
        for a, b, n, body in [*substring.units_of(raw), (0, 0, 0, None)]:
            if body is not None and body in first:
                run.append((a, b, n, first[body]))
                continue
            first.setdefault(body, doc[0])
            words = sum(u[2] for u in run)
            if words >= 20 and (words >= 50 or max(u[2] for u in run) >= 5):
                want.append((doc[0], len(raw[: run[0][0]].decode()), len(raw[: run[-1][1]].decode()), words, len(run), run[0][3]))
            run = []
        first.pop(None, None)
    got = [tuple(r) for r in substring.repeats(d, hot=hot).drop("__row").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert len(want) > 30 and sorted(got, key=key) == sorted(want, key=key)


def test_html_held_out_pages():
    chain, rng = html.train(200), random.Random(77)
    good = sum(html.main_text(p, chain) == a for p, a in (html.labelled_page(rng) for _ in range(60)))
    assert good >= 42
    assert html.main_text(None, chain) == "" and html.main_text("<p", chain) is not None
    page = "<nav><a href=x>Menu</a></nav><article><p>One &amp; two<br>three</p><script>no</script></article><footer>&copy; x</footer>"
    assert html.main_text(page, chain) == "One & two three"


def test_html_align_is_not_misled_by_first_words():
    found = html.blocks("<title>Con du</title><nav><a>Con</a></nav><article><p>Con du</p><p>ba</p></article><p>ba no</p>")
    assert html.align(found, "Con du ba") == [0, 0, 1, 1, 0] and html.align(found, "Con du bas") is None and html.align([], "") == []


def test_html_edge_rows(spark):
    rows = [(None, None, None, "x", 1), (1, "u", "", "x", 2), (2, "u", "<article><p>A good day, and it was long.</p></article>", None, 3), (2, "u", "<p>" * 3000, "y", 4), (3, None, "<article>" + "<p>Many words stand here, and more follow.</p>" * 20000, "z", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, N_CHARS int")
    r = html.extract(d).collect()
    assert html.extract(d).columns == ["page_id", "url", "text", "n_chars"] and len(r) == 5
    assert (r[0].text, r[0].n_chars) == ("", 0) and r[1].text == "" and r[4].text.count("Many") == 20000 and r[4].n_chars == len(r[4].text)
    assert html.page_report(d.limit(0)).count() == 0


def test_html_chain_of_the_query():
    """The chain as op9 trains it, on more held-out pages than the small one above."""
    chain, rng = html.train(), random.Random(5)
    assert sum(html.main_text(p, chain) == a for p, a in (html.labelled_page(rng) for _ in range(200))) >= 190
    page = "<nav><a href=x>Menu</a></nav><article><p>One &amp; two<br>three</p></article><footer>&copy; x</footer>"
    assert html.main_text(page, chain) == "One & two three"


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    g = quality.fit(x[:3000], y[:3000], cycles=20, pair_cycles=60)
    assert ((g.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_pipeline_runs(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaks = {r.doc_id for r in decontamination.leak_report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids and not ids & leaks
    groups = {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}
    assert len({groups[i] for i in ids}) == len(ids)
