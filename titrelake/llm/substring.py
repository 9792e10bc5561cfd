"""Substring deduplication on lines and the sentences in them.

Units are normalised (A-Z lower-cased, white space squeezed) and hashed to 128 bits. Of all units with one digest
the earliest, by document and then place, is kept. Neighbouring repeats in a document join into passages, and
passages of enough words are removed, with their offsets in the original text. Shorter lines that stand earlier as whole
lines are removed by a rule of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_table, row_hash, without
from .textarrays import slices

UNITS = {
    "sentence": re.compile(rb"[^\n]*?(?:(?<![.!?])[.!?](?=[ \t\r])|(?=\n)|\Z)\s*", re.S),
    "line": re.compile(rb"[^\n]*\n*"),
    "paragraph": re.compile(rb".*?(?:\n\s*\n|\Z)", re.S),
}
WORD = re.compile(rb"\S+")
#: The place of a text's first line among its units.
LINES = 1 << 40


def anchors(words: list[bytes], window: int) -> set[int]:
    """Places of the words after which a long unit is cut: winnowing over hashes of three words (the word and the two
    before it), so that each `window` words in a row hold one. Of equal hashes the last chosen one stays while it is in the
    window: text that repeats itself is not cut at every word."""
    h = list(map(xxhash.xxh64_intdigest, words))
    h = [xxhash.xxh64_intdigest(b"%x %x %x" % (a, b, c)) for a, b, c in zip([0, 0, *h], [0, *h], h)]
    out, at = set(), -1
    for i in range(window - 1, len(h)):
        if at <= i - window:
            least = min(h[i - window + 1 : i + 1])
            at = next(k for k in range(i, -1, -1) if h[k] == least)
            out.add(at)
        elif h[i] < h[at]:
            at = i
            out.add(at)
    return out


def units_of(text: bytes, unit: str = "sentence", longest: int = 24, window: int = 12) -> Iterator[tuple[int, int, int, bytes]]:
    """(start byte, end byte, words, normalised bytes) of each unit with words, in order.

    Units of over `longest` words are cut at anchors, of which each `window` words hold one, chosen by what stands in the
    window alone: a passage in the middle of a long line is cut alike wherever it stands, but for its first window + 2
    and its last window - 1 words at most.
    """
    for m in UNITS[unit].finditer(text):
        body = m[0].lower()
        words = body.split()
        if not words:
            continue
        lead = len(body) - len(body.lstrip())
        if len(words) <= longest:
            yield m.start() + lead, m.start() + len(body.rstrip()), len(words), b" ".join(words)
            continue
        held, start, cuts = [], 0, anchors(words, window)
        for k, w in enumerate(WORD.finditer(body)):
            start = start if held else w.start()
            held.append(w[0])
            if k in cuts:
                yield m.start() + start, m.start() + w.end(), len(held), b" ".join(held)
                held = []
        if held:
            yield m.start() + start, m.start() + len(body.rstrip()), len(held), b" ".join(held)


def short_lines(text: bytes, unit: str, line_words: int, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Like units_of, the lines of at least `line_words` words that are no passage by themselves, as wholes."""
    for m in UNITS["line"].finditer(text):
        words = m[0].lower().split()
        if line_words <= len(words) < min_words or min_words <= len(words) < 50 and max(u[2] for u in units_of(m[0], unit)) < 5:
            lead = len(m[0]) - len(m[0].lstrip())
            yield m.start() + lead, m.start() + len(m[0].rstrip()), len(words), b"\n" + b" ".join(words)


def _places(stream: Iterator[tuple[int, int, int, bytes]], raw: np.ndarray, first: int, step: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, start, end, words, digest halves) of the units of one text in blocks; start and end become code points.

    Only the bytes between neighbouring unit edges are counted, so that a long text needs no array of its own length.
    """
    held = iter(stream)
    byte, point, k = 0, 0, 0
    while got := list(islice(held, block)):
        edges = np.array([e for u in got for e in u[:2]], dtype=np.int64)
        inner = raw[byte : edges[-1]]
        tails = np.concatenate(([0], np.cumsum((inner & 0xC0) == 0x80, dtype=np.int32)))[edges - byte]
        points = point + (edges - byte) - tails
        digests = [xxhash.xxh3_128_digest(u[3]) for u in got]
        halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
        yield first + step * np.arange(k, k + len(got)), points[0::2], points[1::2], np.array([u[2] for u in got], dtype=np.int64), halves[:, 0], halves[:, 1]
        byte, point, k = int(edges[-1]), int(points[-1]), k + len(got)


def _one_each(df: DataFrame) -> bool:
    """Whether doc_id alone tells the rows apart: never null, never repeated."""
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def _row(df: DataFrame, alone: bool | None = None) -> Column:
    """What tells rows of one doc_id apart."""
    return F.lit(0).cast("long") if (_one_each(df) if alone is None else alone) else row_hash(df)


def repeats(df: DataFrame, text: str = "text", unit: str = "sentence", min_words: int = 20, hot: int = 1000, line_words: int = 0) -> DataFrame:
    """(doc_id, __row, start, end, n_words, n_units, kept_doc_id): passages of at least min_words words whose units
    all stand earlier, with one unit of five words or 50 words in all; start and end are code points of the original
    text, kept_doc_id holds the first unit's earliest occurrence.

    Documents rank by doc_id (null last), then by the hash of all columns (__row; 0 where every doc_id is there and
    stands once); rows equal in all columns count as one document. Null and empty texts have no units. Every unit of the
    whole text is hashed, however short. A digest's units meet in one task, but for the at most `hot` most frequent
    digests, whose earliest units go by broadcast and whose others stay where they are; results are the same for any `hot`.
    line_words: if not 0, a line of so many words or more that stands earlier as a whole line is one too, however short.
    """
    alone = _one_each(df)
    named = df.select("doc_id", _row(df, alone).alias("__row"), F.col(f"`{text}`").alias("__text"))
    names = ["doc_id", "__row", "place", "start", "end", "n", "hi", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(part: pa.RecordBatch, rows: list, got: list) -> pa.RecordBatch:
            take = pa.array(np.repeat(rows, [len(g[0]) for g in got]))
            place, start, end, n, hi, lo = (np.concatenate(x) for x in zip(*got))
            small = [pa.array(x.astype(np.int32)) for x in (start, end, n)]
            return pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("__row").take(take), pa.array(place), *small, pa.array(hi), pa.array(lo)], names=names)

        for part, raw, offs in slices(batches, "__text"):
            data, at = raw.tobytes(), offs.tolist()
            rows, got = [], []
            for r, (i, j) in enumerate(zip(at, at[1:])):
                body = data[i:j]
                # lines have every second place, so that they never make a run
                lines = _places(short_lines(body, unit, line_words, min_words), raw[i:j], LINES, 2) if line_words else ()
                for g in chain(_places(units_of(body, unit), raw[i:j], 0, 1), lines):
                    rows.append(r), got.append(g)
                    if len(g[0]) == 1 << 15:
                        yield batch(part, rows, got)
                        rows, got = [], []
            if got:
                yield batch(part, rows, got)

    units = cut_table(named.mapInArrow(run, "doc_id bigint, __row bigint, place bigint, start int, end int, n int, hi bigint, lo bigint"))
    # a sketch names the candidates for frequent digests, at most `hot`; which ones it names changes no result
    # (merged in two steps, so that no task meets the sketches of all others)
    partial = units.groupBy((F.spark_partition_id() % 64).alias("p")).agg(F.expr(f"approx_top_k_accumulate(lo, {max(8 * 1024, hot)})").alias("s"))
    whole = partial.groupBy(F.lit(1)).agg(F.expr("approx_top_k_combine(s)").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {hot})").alias("top")).first()
    top = whole.top if whole else []  # no row if there are no units
    frequent = F.broadcast(units.sparkSession.createDataFrame([(t[0],) for t in top], "lo bigint").distinct())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "place")
    common = F.broadcast(units.join(frequent, "lo").groupBy("hi", "lo").agg(F.min(rank).alias("first")))
    keep = ["doc_id", "__row", "place", "start", "end", "n"]
    far = units.join(common, ["hi", "lo"]).where(rank > F.col("first")).select(*keep, F.col("first.doc_id").alias("kept_doc_id"))
    same = Window.partitionBy("hi", "lo").orderBy(F.col("doc_id").asc_nulls_last(), "__row", "place")
    near = units.join(frequent, "lo", "left_anti").select(*keep, F.first("doc_id").over(same).alias("kept_doc_id"), F.rank().over(same).alias("nth")).where("nth > 1").drop("nth")
    later = far.unionByName(near)
    if not alone:  # rows equal in all columns give each unit once
        later = later.distinct()
    in_doc = Window.partitionBy("doc_id", "__row").orderBy("place")
    runs = later.withColumn("run", F.col("place") - F.row_number().over(in_doc))
    passages = runs.groupBy("doc_id", "__row", "run").agg(F.max(F.col("place") >= LINES).alias("line"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_units"), F.max("n").alias("longest"), F.min_by("kept_doc_id", "place").alias("kept_doc_id"))
    passages = passages.where(F.col("line") | (F.col("n_words") >= min_words) & ((F.col("longest") >= 5) | (F.col("n_words") >= 50)))
    if line_words:  # all units of a repeated line stand earlier, so a passage holds the whole line or nothing of it
        before = Window.partitionBy("doc_id", "__row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
        upto = F.max(F.when(~F.col("line"), F.col("end"))).over(before)
        passages = passages.withColumn("upto", upto).where("NOT line OR upto IS NULL OR upto < end").drop("upto")
    return passages.drop("run", "longest", "line").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def remove_repeats(df: DataFrame, text: str = "text", line_words: int = 5, **options) -> DataFrame:
    """df with the repeated passages cut out of its texts and removed, the list of their original (start, end).

    A column named removed is replaced; other columns stay as they are, whatever their names. Null texts stay null.
    """
    df = without(df, ["removed"])
    spans = repeats(df, text, line_words=line_words, **options).groupBy("doc_id", "__row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__hash"), "__spans")
    # doc_id and row hash together, so that of two documents none can take the other's offsets
    rows = df.select(F.col("doc_id").alias("__doc"), _row(df).alias("__row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__all"))
    out = rows.join(spans, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash")), "left")
    body, cuts = F.col("__all")[text], F.coalesce("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    ends = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.length(body).cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda s: s["end"]))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(body, (a + 1).cast("int"), (b - a).cast("int"))), "")
    text_now = F.when(F.size(cuts) == 0, body).otherwise(kept)
    return out.select(*[(text_now if c == text else F.col("__all")[c]).alias(c) for c in df.columns], cuts.alias("removed"))


def repeat_report(df: DataFrame) -> DataFrame:
    """One row for each passage or whole line of five words or more that deduplication removes."""
    return repeats(df.select("doc_id", "text"), line_words=5).drop("__row")
