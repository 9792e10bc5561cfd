"""Evidence: merging, extraction by rules, resolving references, quote rates."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.quotes import WORD, normal, quote_check, verify
from ..schema import CITABLE, FINDING
from ..session import spread
from ..sources.connectors import Model


def merge(base: DataFrame, extra: DataFrame, key: str = "study_id", order: str = "study_ord") -> DataFrame:
    """Upsert: extra rows win where the id is new or the base row is still to_verify; base order, then new ids."""
    cols = [c for c in base.columns if c not in (key, order)]
    b = base.select(key, F.struct(*cols).alias("b"), F.col(order).alias("bo"))
    x = extra.select(key, F.struct(*cols).alias("x"), F.col(order).alias("xo"))
    j = b.join(x, key, "full_outer")
    take = F.col("x").isNotNull() & (F.col("b").isNull() | (F.col("b.level") == "to_verify"))
    j = j.withColumn("r", F.when(take, F.col("x")).otherwise(F.col("b")))
    return j.select(key, F.struct(F.col("bo").isNull().cast("int").alias("late"), F.coalesce("bo", "xo").alias("at")).alias(order), "r.*")


def by_tags(studies: DataFrame, tags: list[str]) -> DataFrame:
    """Citable findings of citable studies with any of the tags."""
    f = studies.where(F.col("level").isin(CITABLE)).select("study_ord", "study_id", F.posexplode("findings").alias("pos", "f"))
    return f.where(F.col("f.level").isin(CITABLE) & F.arrays_overlap("f.tags", F.array(*map(F.lit, tags)))).select("study_ord", "pos", "study_id", "f.*")


def resolve(requests: DataFrame, studies: DataFrame) -> DataFrame:
    """(request_id, refs): citable findings for the wanted ids (array `finding_ids`), in the order asked for."""
    f = studies.select("study_id", "citation", "url", F.col("level").alias("sl"), F.inline("findings")).where(F.col("sl").isin(CITABLE) & F.col("level").isin(CITABLE))
    f = f.select("finding_id", F.struct("study_id", "finding_id", "citation", "quote", "url").alias("ref"))
    want = requests.select("request_id", F.posexplode("finding_ids").alias("pos", "finding_id"))
    got = want.join(f, "finding_id").groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))
    return requests.select("request_id").join(got, "request_id", "left").withColumn("refs", F.coalesce("refs", F.array()))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _hold(quotes: pd.Series, sources: pd.Series) -> pd.Series:
    """Whether each quote of a text's list holds; the text is normalised once."""

    def one(said, source) -> list[bool]:
        if said is None or source is None:
            return [False] * (0 if said is None else len(said))
        whole = normal(source)
        return [bool(normal(q)) and normal(q) in whole or verify(q, source)[0] for q in said]

    return pd.Series([one(q, s) for q, s in zip(quotes, sources)])


def extract(docs: DataFrame, max_findings: int = 6) -> DataFrame:
    """Studies from documents (doc_id, citation, year, doi, pmid, url, abstract, full_text) by rules.

    A finding is a sentence with a topic and a word of the field; its quote is verified against the full text.
    """
    body = F.col("full_text")
    source = F.coalesce(F.nullif(F.col("abstract"), F.lit("")), body)
    numbered = F.transform(tx.sentences(source), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    field = "(?iU)" + tx.DOMAIN
    hits = F.filter(numbered, lambda x: x["s"].rlike(field) & (F.size(tx.matching(x["s"], tx.TOPICS)) > 0))
    made = F.transform(F.slice(hits, 1, max_findings), lambda x: F.struct(F.concat(F.col("doc_id"), F.lit("_r"), x["i"].cast("string")).alias("finding_id"), x["s"].alias("statement"), x["s"].alias("quote"), tx.matching(x["s"], tx.TOPICS).alias("tags"), F.lit("extractive_auto").alias("level")))
    # a text without a word of the field has no sentence with one; quotes are checked where the text lies
    some = spread(docs).withColumns({"f": F.when(source.rlike(field), made), "m": tx.matching(body, tx.METHODS), "a": tx.matching(body, tx.ASSAYS)})
    d = some.withColumn("ok", _hold(F.col("f.quote"), F.when(F.size("f") > 0, body)))
    kept = F.coalesce(F.transform(F.filter(F.arrays_zip("f", "ok"), lambda x: x["ok"]), lambda x: x["f"]), F.array().cast(T.ArrayType(FINDING)))
    methods, assays = F.col("m"), F.col("a")
    return d.select(
        F.concat(F.lit("auto_"), "doc_id").alias("study_id"), "citation", F.coalesce("year", F.lit(0)).alias("year"), "doi", "pmid", "url",
        tx.pathogen(body).alias("pathogen"), tx.vaccines(body).alias("vaccines"), methods.alias("sampling_methods"), tx.method_compartments(methods).alias("compartments"),
        F.filter(tx.timeframe_days(F.col("abstract")), lambda x: x.between(0, 730)).alias("timepoints_days"), assays.alias("assays"), "abstract",
        kept.alias("findings"),
        F.filter(F.array(F.when(F.size(methods) == 0, F.lit("sampling_method")), F.when(F.size(assays) == 0, F.lit("assay"))), lambda x: x.isNotNull()).alias("not_reported"),
        F.lit("extractive_auto").alias("level"),
    )


ASK = "List the findings of this text on antibody responses. Answer with a JSON object {findings: [{statement, quote, tags}]}; each quote must stand in the text word for word.\n\n"


def extract_with(model: Model, docs: DataFrame, shown: int = 12_000) -> DataFrame:
    """extract(), with the findings of a model for the documents in which it gives some that hold.

    The model sees the abstract (else the full text), at most `shown` characters: a model's window is bounded, and quotes are
    verified against what it was shown. Tags that are no topics are dropped. Without a model this is extract().
    """
    rules = extract(docs)
    if not model.available:
        return rules
    topics = set(tx.TOPICS)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                told = (model.json(ASK + text) or {}).get("findings")
                found = [f for f in told if isinstance(f, dict) and verify(str(f.get("quote") or ""), text)[0]] if isinstance(told, list) else []
                out.append((doc_id, [{"finding_id": f"{doc_id}_m{i}", "statement": str(f.get("statement") or f["quote"]), "quote": str(f["quote"]), "tags": [t for t in f.get("tags") or [] if t in topics], "level": "llm_extracted"} for i, f in enumerate(found)]))
            yield pd.DataFrame(out, columns=["doc_id", "told"])

    seen = docs.select("doc_id", F.substring(F.coalesce(F.nullif(F.col("abstract"), F.lit("")), "full_text", F.lit("")), 1, shown).alias("text"))
    told = seen.mapInPandas(run, T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("told", T.ArrayType(FINDING))])).where(F.size("told") > 0)
    both = rules.join(told.select(F.concat(F.lit("auto_"), "doc_id").alias("study_id"), "told"), "study_id", "left")
    return both.withColumns({"findings": F.coalesce("told", "findings"), "level": F.when(F.col("told").isNotNull(), "llm_extracted").otherwise(F.col("level"))}).drop("told")


def quote_rates(quotes: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """One row: share of quotes accepted (1 if there are none), and of their corruptions rejected."""
    true = quotes.select(quote_check(F.col(quote), F.col(source))["ok"].alias("ok")).agg(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(1.0)).alias("accepted"), F.count(F.lit(1)).alias("n_quotes"))
    fake = quotes.select(F.col(source).alias("s"), F.col(quote).alias("q"), F.explode(tx.mutations(F.col(quote))).alias("fake")).where("trim(fake) <> trim(q)")
    caught = fake.select(quote_check(F.col("fake"), F.col("s"))["ok"].alias("ok")).agg(F.coalesce(F.avg((~F.col("ok")).cast("double")), F.lit(1.0)).alias("fakes_rejected"), F.count(F.lit(1)).alias("n_fakes"))
    return true.crossJoin(caught)


#: Quotes that are looked for in one pass over the documents.
QUOTES_A_PASS = 50_000


class _Finder:
    """Where the words of some quotes stand in texts: each quote as it is, or its words in a row, each as often, in any order."""

    def __init__(self, quotes: list[str]) -> None:
        import ahocorasick

        self.quotes = [normal(q) for q in quotes]
        self.exact = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for i, q in enumerate(self.quotes):
            if q:
                same.setdefault(q, []).append(i)
        for q, at in same.items():
            self.exact.add_word(q, at)
        if same:
            self.exact.make_automaton()
        said = [WORD.findall(q) for q in self.quotes]
        self.code = {w: int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for ws in said for w in ws}
        # by length: sums of the words' codes, sorted, and the quotes with that sum
        self.sums: dict[int, tuple[np.ndarray, list[int]]] = {}
        for n in {len(ws) for ws in said} - {0}:
            own = sorted((sum(self.code[w] for w in ws) % (1 << 64), i) for i, ws in enumerate(said) if len(ws) == n)
            self.sums[n] = np.array([k for k, _ in own], np.uint64), [i for _, i in own]

    def pairs(self, texts: list[str]) -> Iterator[tuple[int, int, bool]]:
        """(text, quote, whether the text holds it as it is) by number; texts are normal."""
        found = {(k, i) for k, t in enumerate(texts) for _, at in (self.exact.iter(t) if len(self.exact) else ()) for i in at}
        yield from ((k, i, True) for k, i in found)
        said = [[self.code.get(w, -1) for w in WORD.findall(t)] for t in texts]
        flat = np.array([c for ws in said for c in (*ws, -1)], dtype=object)
        foreign = flat == -1  # so is the end of a text
        codes = np.where(foreign, 0, flat).astype(np.uint64)
        upto, gaps = np.zeros(len(codes) + 1, np.uint64), np.zeros(len(codes) + 1, np.int64)
        np.cumsum(codes, out=upto[1:])
        np.cumsum(foreign, out=gaps[1:])
        ends = np.cumsum([len(ws) + 1 for ws in said])
        seen = set()
        for n, (keys, of) in self.sums.items():
            whole = np.flatnonzero(gaps[n:] == gaps[:-n])
            run = upto[whole + n] - upto[whole]
            lo, hi = np.searchsorted(keys, run), np.searchsorted(keys, run, side="right")
            for j in np.flatnonzero(hi > lo).tolist():
                k = int(np.searchsorted(ends, whole[j], side="right"))
                seen.update((k, of[x]) for x in range(lo[j], hi[j]))
        yield from ((k, i, False) for k, i in seen - found)


def quotes_found(quotes: DataFrame, docs: DataFrame, quote_id: str, id_: str, quote: str = "quote", source: str = "source", a_pass: int = QUOTES_A_PASS) -> DataFrame:
    """(quote_id, id, ok, score) of verify() for every quote and every document that has its words in a row: all pairs whose
    score is above 0, without comparing each quote with each document.

    The sum of a word's codes over a window of as many words as the quote has is the same in any order; a pass over the
    documents, which stay where they are, takes these sums from running totals and looks them up, and looks for all quotes as
    they stand by one automaton. Quotes are a stated set, sent to the tasks in blocks of `a_pass`. Null and empty quotes and
    texts give nothing.
    """
    q = quotes.select(F.col(quote_id).alias("q"), F.col(quote).alias("t")).where("t IS NOT NULL")
    blocks = max(1, -(-q.count() // a_pass))
    d = spread(docs.select(F.col(id_).alias("d"), F.col(source).alias("t")).where("t IS NOT NULL"))
    spec = f"q {dict(q.dtypes)['q']}, d {dict(d.dtypes)['d']}, ok boolean, score double"

    def block(k: int) -> DataFrame:
        rows = q.where(F.pmod(F.xxhash64("q", "t"), F.lit(blocks)) == k).collect()  # some a_pass quotes
        ids, said = [r.q for r in rows], [r.t for r in rows]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = _Finder(said)
            for part in it:
                for at in range(0, len(part), 256):
                    names, raw = part["d"].iloc[at : at + 256].tolist(), part["t"].iloc[at : at + 256].tolist()
                    texts = [normal(t) for t in raw]
                    out = [(ids[i], names[j], True, 1.0) if exact else (ids[i], names[j], *verify(said[i], raw[j])) for j, i, exact in finder.pairs(texts)]
                    if out:
                        yield pd.DataFrame(out, columns=["q", "d", "ok", "score"])

        return d.mapInPandas(run, spec)

    out = block(0)
    for k in range(1, blocks):
        out = out.unionByName(block(k))
    return out.toDF(quote_id, id_, "ok", "score")


def verified(quotes: DataFrame, quote: str = "quote", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, one row with n and rate) of quotes checked against their sources; both lists carry the score."""
    checked = quotes.withColumn("check", quote_check(F.col(quote), F.col(source))).select("*", F.col("check.score").alias("score"), F.col("check.ok").alias("ok")).drop("check")
    rate = checked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(1.0)).alias("rate"))
    return checked.where("ok").drop("ok"), checked.where("NOT ok").drop("ok"), rate


def timepoints(studies: DataFrame, last: int = 365) -> DataFrame:
    """Days that citable studies report, within 0 and `last`, sorted."""
    return studies.where(F.col("level").isin(CITABLE)).select(F.explode("timepoints_days").alias("day")).where(F.col("day").between(0, last)).distinct().orderBy("day")
