"""Every quote in every source, against verify() on all pairs."""

import random

from titrelake.functions.quotes import verify
from titrelake.operators import evidence


def cases(seed=0):
    r = random.Random(seed)
    words = ["iga", "IgG", "rose", "the", "nasal", "wash", "–", "3.5", "fold", "ﬁndings", "é", "中文", "x"]
    some = lambda lo, hi: " ".join(r.choice(words) for _ in range(r.randint(lo, hi)))
    docs = [some(0, 60) for _ in range(60)] + [None, "", "   ", "iga rose", "IGA  rose!", "Rose iga", "中文 é"]
    quotes = [some(1, 6) for _ in range(40)] + [None, "", " ", "iga rose", "iga, rose", "é", "中文", "a" * 50]
    docs.append("we saw that nasal iga, in most of the adults who were vaccinated twice, rose within two weeks. more")
    quotes.append("nasal IgA in most of the adults who were vaccinated twice, rose within two weeks")
    for d in docs[:40]:
        w = d.split()
        if len(w) > 12:
            a = r.randrange(len(w) - 10)
            part = w[a : a + r.randint(4, 10)]
            quotes.append(" ".join(part))
            quotes.append(" ".join(reversed(part)))
            quotes.append(" ".join(part).replace("–", "-").upper())
            quotes.append(", ".join(part))
    return quotes, docs


def test_all_pairs(spark):
    quotes, docs = cases()
    q = spark.createDataFrame(list(enumerate(quotes)), "qid int, quote string")
    d = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(docs)], "id string, source string").repartition(5)
    want = {}
    for i, x in enumerate(quotes):
        for j, t in enumerate(docs):
            ok, score = verify(x or "", t or "")
            if score > 0:
                want[i, f"d{j}"] = ok, round(score, 9)
    for a_pass in (50_000, 17):
        rows = evidence.quotes_found(q, d, "qid", "id", a_pass=a_pass).collect()
        got = {(r.qid, r.id): (r.ok, round(r.score, 9)) for r in rows}
        assert len(rows) == len(got) and got == want
    assert any(not ok for ok, _ in want.values()) and any(ok and s < 1 for ok, s in want.values())


def test_empty_sides(spark):
    q = spark.createDataFrame([], "qid int, quote string")
    d = spark.createDataFrame([("a", "some words here")], "id string, source string")
    assert evidence.quotes_found(q, d, "qid", "id").count() == 0
    assert evidence.quotes_found(d.toDF("qid", "quote"), q.toDF("id", "source"), "qid", "id").count() == 0
