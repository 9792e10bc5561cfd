"""Ranked retrieval over chunks: postings, BM25, dense cosine, reciprocal rank fusion, metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import cosine
from ..functions.text import STOP_WORDS, expand, with_stem, words
from ..schema import CITABLE
from ..session import spread, written
from ..sources.kept import Kept

K1, B, RRF = 1.5, 0.75, 60
WEIGHTS = {"finding": 1.0, "abstract": 0.45}
TAG_BOOST = 0.01


def chunks(studies: DataFrame) -> DataFrame:
    """Search units of an evidence base: a row for each finding and each abstract that is not empty."""
    ok = F.col("level").isin(CITABLE)
    f = studies.select("study_ord", "study_id", "citation", ok.alias("study_ok"), F.posexplode("findings").alias("pos", "f"))
    found = f.select(F.struct("study_ord", F.col("pos").alias("pos")).alias("chunk_ord"), F.col("f.finding_id").alias("chunk_id"), "study_id", F.lit("finding").alias("kind"), F.concat_ws(" ", "f.statement", "f.quote", "citation").alias("text"), F.col("f.tags").alias("tags"), (F.col("study_ok") & F.col("f.level").isin(CITABLE)).alias("citable"))
    whole = studies.where(F.coalesce(F.col("abstract"), F.lit("")) != "").select(F.struct("study_ord", F.lit(1 << 20).alias("pos")).alias("chunk_ord"), F.concat(F.col("study_id"), F.lit("_abstract")).alias("chunk_id"), "study_id", F.lit("abstract").alias("kind"), F.col("abstract").alias("text"), F.array().cast("array<string>").alias("tags"), ok.alias("citable"))
    return found.unionByName(whole)


def terms(df: DataFrame, id_: str, text: str, expanded: bool = True) -> DataFrame:
    """(id, term, tf): stemmed tokens with multiplicity, and the stemmed synonyms of each if expanded."""
    # the words of raw_tokens; once exploded they are filtered in generated code, by a hash set of stop words
    said = spread(df.select(F.col(id_), F.col(text))).select(F.col(id_), F.explode(words(F.lower(F.col(text)))).alias("w")).where((F.length("w") > 1) & ~F.col("w").isin(STOP_WORDS))
    stems = with_stem(said.groupBy(id_, "w").agg(F.count(F.lit(1)).alias("n")), "w", "s")
    root = F.array("s")
    return stems.select(id_, "n", F.explode(expand(root) if expanded else root).alias("term")).groupBy(id_, "term").agg(F.sum("n").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def corpus_stats(postings: DataFrame, id_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(length by document, document frequency by term, one row with n and avgdl)."""
    length = postings.groupBy(id_).agg(F.sum("tf").alias("dl"))
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return length, freq, length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25(queries: DataFrame, postings: DataFrame, query_id: str, id_: str, n_docs: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) for every pair that shares a term.

    queries: (query_id, term, tf). The postings are reduced to the queries' terms before lengths are joined, so only
    matching documents are touched; n_docs overrides the one-row (n, avgdl), if documents without terms count.
    """
    length, _, whole = corpus_stats(postings, id_)
    q = written(queries.select(query_id, "term", F.col("tf").alias("qtf")), "queries")  # tokenised once; its size decides about broadcasts
    sent = F.broadcast if q.count() <= 50_000 else lambda df: df  # of rows by term no more than the queries have
    kept = postings.join(sent(q.select("term").distinct()), "term", "left_semi")
    freq = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hit = kept.join(sent(q), "term").join(sent(freq), "term").join(length, id_).crossJoin(F.broadcast(n_docs if n_docs is not None else whole))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(query_id, id_).agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, query_id: str, id_: str, k: int | None = None, score: str = "score") -> DataFrame:
    """Add rank (from 1) by score, ties to the smaller id; keep k."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(score), id_)))
    return out if k is None else out.where(F.col("rank") <= k)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; how a larger one is joined is left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense(queries: DataFrame, docs: DataFrame, query_id: str, id_: str, vector: str = "embedding") -> DataFrame:
    """Cosine of every stated query with every document; documents stay where they are while queries are few. For rankings in
    full; the k best alone are dense_top's."""
    q = queries.select(query_id, F.col(vector).alias("__q"))
    return docs.select(id_, F.col(vector).alias("__d")).join(small(q)).select(query_id, id_, cosine(F.col("__q"), F.col("__d")).alias("score"))


#: Queries that dense_top compares with a vector at a time, and vectors of a product.
QUERIES_A_PASS, VECTORS = 4096, 2048


def dense_top(queries: DataFrame, docs: DataFrame, query_id: str, id_: str, k: int, vector: str = "embedding", digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank): the k documents with the largest cosine to each stated query, rounded, ties to the smaller
    id. Vectors that are null, of length 0 or of another length than the query have no cosine.

    Queries go to the tasks in blocks; a task multiplies a block of vectors with them and keeps k a query, so that what
    meets for the ranking is k a task and query, never a product of both tables.
    """
    q = written(queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL"), "queries")
    d = spread(docs.select(F.col(id_).alias("d"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL"))
    types = dict(q.dtypes)["q"], dict(d.dtypes)["d"]
    blocks = max(1, -(-q.count() // QUERIES_A_PASS))

    def best(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of each column's k best, ties at the end by id."""
        return np.lexsort((np.broadcast_to(ids[:, None], score.shape), -score), axis=0)[:k]

    def block(n: int) -> DataFrame:
        rows = [r for r in q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).collect() if r.v and None not in r.v]
        sizes = sorted({len(r.v) for r in rows})
        sides = [([r.q for r in rows if len(r.v) == s], np.array([r.v for r in rows if len(r.v) == s])) for s in sizes]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = {s: (np.zeros(0, object), np.zeros((0, len(names)))) for s, (names, _) in zip(sizes, sides)}
            for part in it:
                for at in range(0, len(part), VECTORS):
                    some = part.iloc[at : at + VECTORS]
                    for s, (names, m) in zip(sizes, sides):
                        own = [(i, v) for i, v in zip(some["d"], some["v"]) if len(v) == s]
                        if not own:
                            continue
                        x = np.array([v for _, v in own], dtype=float)
                        with np.errstate(invalid="ignore", divide="ignore"):
                            new = np.round(x @ m.T / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((m * m).sum(axis=1)), digits)
                        ids = np.concatenate([held[s][0], np.array([i for i, _ in own], dtype=object)])
                        score = np.concatenate([held[s][1], np.where(np.isfinite(new), new, -np.inf)])
                        keep = np.unique(best(score, ids))
                        held[s] = ids[keep], score[keep]
            for s, (names, _) in zip(sizes, sides):
                ids, score = held[s]
                if len(ids):
                    at = best(score, ids)
                    for j in range(0, len(names), 512):
                        rows_ = [(names[c], ids[i], float(score[i, c])) for c in range(j, min(j + 512, len(names))) for i in at[:, c] if score[i, c] > -np.inf]
                        yield pd.DataFrame(rows_, columns=["q", "d", "score"])

        return d.mapInPandas(run, f"q {types[0]}, d {types[1]}, score double")

    out = block(0)
    for n in range(1, blocks):
        out = out.unionByName(block(n))
    return ranked(out.toDF(query_id, id_, "score"), query_id, id_, k)


def containing(passages: DataFrame, docs: DataFrame, passage_id: str, id_: str, passage: str = "text", text: str = "text") -> DataFrame:
    """(passage_id, id) wherever a document's text holds a passage, without regard to case; nulls hold and give nothing.

    A word inside a passage, with other characters on both sides, is a word of each text that holds it. So documents
    are looked up by the longest such word and only those found are compared as a whole. Passages without one (a
    word or two) are compared with every document.
    """
    p = passages.select(passage_id, F.lower(F.col(passage)).alias("__p"))
    inner = F.regexp_extract_all("__p", F.lit("(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"), F.lit(0))
    p = p.withColumn("__w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    d = spread(docs.select(id_, F.col(text))).select(id_, F.lower(F.col(text)).alias("__t"))
    keyed = p.where("__w IS NOT NULL")
    wanted = keyed.select("__w").distinct()  # few words are sent to the documents
    words_ = d.select(id_, F.explode(words(F.col("__t"))).alias("__w")).join(wanted, "__w", "left_semi").distinct()
    found = words_.join(keyed, "__w").join(d, id_).where(F.contains("__t", "__p"))
    brief = p.where("__w IS NULL AND __p IS NOT NULL")
    out = found.select(passage_id, id_)
    return out if brief.isEmpty() else out.unionByName(d.join(small(brief), F.contains("__t", "__p")).select(passage_id, id_))


def fuse(rankings: list[DataFrame], docs: DataFrame, query_id: str, id_: str, tags: list[str] | None = None, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) tables, weighted by a document's kind, plus a boost for each
    wanted tag; columns fused and, by ranking, rank_0, rank_1, …"""
    out = None
    for i, r in enumerate(rankings):
        r = r.select(query_id, id_, F.col("rank").alias(f"rank_{i}"))
        out = r if out is None else out.join(r, [query_id, id_], "full_outer")
    meta = docs.select(id_, "kind", "tags", "citable")
    if tags:  # a tag alone can make a hit
        boosted = meta.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select(id_).join(F.broadcast(out.select(query_id).distinct()))
        out = out.join(boosted, [query_id, id_], "full_outer")
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("kind")), F.lit(1.0))
    score = sum((F.coalesce(weight / (k + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(rankings))), F.lit(0.0))
    if tags:
        score = score + TAG_BOOST * F.size(F.array_intersect("tags", F.array(*map(F.lit, tags))))
    return out.join(meta, id_).withColumn("fused", score)


def top(fused: DataFrame, query_id: str, id_: str, k: int = 5, citable_only: bool = False) -> DataFrame:
    """The k best with a positive score; the citable filter comes before k."""
    hits = fused.where(F.col("fused") > 0)
    return ranked(hits.where("citable") if citable_only else hits, query_id, id_, k, "fused")


def hybrid(queries: DataFrame, docs: DataFrame, query_id: str, id_: str, k: int = 5, citable_only: bool = True, tags: list[str] | None = None, vectors: DataFrame | None = None, depth: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank, fused) of the k best chunks: BM25 over stemmed words and synonyms, fused with a ranking by
    cosine if queries have an `embedding` and vectors (id, embedding) are given.

    docs: (id, text, kind, tags, citable). Without vectors the ranking is lexical alone. depth: how far down each ranking
    counts; without it rankings are whole, so that a document that both rank low can still be among the best. postings: terms() of the docs, if they are at hand.
    """
    lexical = ranked(bm25(terms(queries, query_id, "text"), terms(docs, id_, "text") if postings is None else postings, query_id, id_).withColumn("score", F.round("score", 8)), query_id, id_, depth)
    rankings = [lexical]
    if vectors is not None:
        asked = queries.where("embedding IS NOT NULL")
        if depth is None:
            close = dense(asked, vectors, query_id, id_).where("score IS NOT NULL").withColumn("score", F.round("score", 9))
            rankings.append(ranked(close, query_id, id_))
        else:
            rankings.append(dense_top(asked, vectors, query_id, id_, depth))
    fused = fuse(rankings, docs, query_id, id_, tags).withColumn("fused", F.round("fused", 9))
    return top(fused, query_id, id_, k, citable_only).select(query_id, id_, "rank", "fused")


def study_listing(studies: DataFrame) -> DataFrame:
    """What a reader sees of an evidence base: one row for each study."""
    return studies.select("study_id", "citation", "year", "pathogen", "level", F.size("findings").alias("n_findings"), F.coalesce("doi", "pmid", F.lit("")).alias("link"), "not_reported")


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, query_id: str, id_: str, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """One row: mean recall at each k, mean reciprocal rank of the first relevant hit, queries without any."""
    found = relevant.join(hits.select(query_id, id_, "rank"), [query_id, id_], "left").groupBy(query_id)
    per = found.agg(*[F.avg((F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("double")).alias(f"r{k}") for k in ks], F.min("rank").alias("first"))
    return per.agg(*[F.avg(f"r{k}").alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count_if(F.col("first").isNull()).alias("misses"), F.count(F.lit(1)).alias("queries"))


def embedding_keys(df: DataFrame, text: str, model: str) -> DataFrame:
    """Cache key of each text for a model."""
    return df.withColumn("key", F.sha1(F.concat(F.lit(model), F.col(text))))


def to_embed(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key is not in the cache yet, one for each key."""
    return df.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def embed_missing(df: DataFrame, cache: Kept, model: str, embed: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 16, flush: int = 100_000) -> int:
    """Embed the texts that the cache (sources.kept.embeddings) does not hold yet, `batch` at a call; how many.

    Some `flush` texts at a time become a part of the cache: what a run that dies has paid for up to there stays paid,
    and the next run goes on. An answer with fewer vectors than texts is an error. Null texts have no vector.
    """
    keyed = embedding_keys(df.select(F.col(text).alias("text")).where("text IS NOT NULL"), "text", model)
    held = cache.read()
    todo = written(keyed.dropDuplicates(["key"]) if held is None else to_embed(keyed, held), "to-embed")
    n = todo.count()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[list[float]] = []
            for i in range(0, len(f), batch):
                asked = f["text"].iloc[i : i + batch].tolist()
                got = embed(asked)
                if len(got) != len(asked):
                    raise ValueError(f"{len(got)} vectors for {len(asked)} texts")
                vectors += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"key": f["key"], "embedding": vectors, "at": 0})

    rounds = -(-n // flush)
    for k in range(rounds):
        some = todo.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        cache.upsert(spread(some).mapInPandas(ask, "key string, embedding array<double>, at long"), uuid.uuid4().hex, "at")
    return n
