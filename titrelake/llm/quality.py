"""Quality classifier: a generalised additive model with pairwise interactions (boosted lookup tables).

Training goes round the features: each step fits a tree of up to four leaves on one feature's bins, from
histograms of gradients, and adds it to that feature's table. Then the pairs with the largest gain on the
residuals get tables of two features in the same way. Scoring adds up table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_rows, without
from .textarrays import LOWER, SPACED, mixed, slices, word_bounds, word_hashes

FEATURES = (
    "log_words", "word_length", "upper", "digits", "odd_signs", "stops", "lines", "bangs", "bars", "distinct_words",
    "repeated_lines", "line_words", "short_words", "top_word", "odd_words", "beyond_ascii",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LETTER, DIGIT, HIGH = np.zeros((4, 256), bool)
UPPER[65:91] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = DIGIT[48:58] = HIGH[128:] = True
ODD, STOP, BANG, BAR, LINE = _class("#$%&*+<=>@[\\]^_`{|}~"), _class(".,;:?"), _class("!"), _class("|"), _class("\n")


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text, from its whole bytes. Empty texts give zeros."""
    n = len(offs) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[offs[1:]] - sums[offs[:-1]]).astype(float)

    def per(top: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.divide(top, by, out=np.zeros(n), where=by > 0)

    starts, ends, rows = word_bounds(raw, offs, SPACED)
    words = np.bincount(rows, minlength=n).astype(float)
    size, letters = (ends - starts), count(LETTER[raw])
    hashes = word_hashes(LOWER[raw], starts, ends)
    distinct, top = _kinds(rows, hashes, n)
    lines_at, lines_to, line_rows = word_bounds(raw, offs, ~LINE)
    lines = np.bincount(line_rows, minlength=n).astype(float)
    kinds, _ = _kinds(line_rows, word_hashes(raw, lines_at, lines_to), n)
    odd = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ODD[raw] | BANG[raw], out=odd[1:])
    odd_words = np.bincount(rows, weights=odd[ends] > odd[starts], minlength=n)
    return np.column_stack(
        [np.log1p(words), per(np.bincount(rows, weights=size, minlength=n), words), per(count(UPPER[raw]), letters), per(count(DIGIT[raw]), np.diff(offs)), per(count(ODD[raw]), np.diff(offs)), per(count(STOP[raw]), words)]
        + [per(lines, words), per(count(BANG[raw]), words), per(count(BAR[raw]), words), per(distinct, words), 1 - per(kinds, lines) * (lines > 0) - (lines == 0), per(words, lines)]
        + [per(np.bincount(rows, weights=size <= 2, minlength=n), words), per(top, words), per(odd_words, words), per(count(HIGH[raw]), np.diff(offs))]
    )


def _kinds(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: the number of distinct hashes, and of the most frequent one."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    with np.errstate(over="ignore"):
        key = np.sort((mixed(hashes) >> np.uint64(24)) | (rows.astype(np.uint64) << np.uint64(40)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    runs = np.diff(np.append(first, len(key)))
    of = (key[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, runs)
    return np.bincount(of, minlength=n).astype(float), top


@dataclass
class Gam:
    """Bin edges and tables: `single` by feature, `pairs` as (i, j, table over coarse bins of both)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by row."""
        z = np.full(len(x), self.base)
        for i, table in enumerate(self.single):
            z += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


RIDGE = 1.0


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a row of bins: gain, and the number of bins to its left (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree of some depth over a row of bins."""
    _, k = _split(g, h) if depth else (0, 0)
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)]) if k else np.full(len(g), _leaf(g, h))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one axis and then, on each side, the other; its gain and its table."""
    best = (-1.0, np.full(g.shape, _leaf(g, h)))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, a.shape[0]):
            gain, out = 0.0, np.empty(a.shape)
            for part in (slice(0, k), slice(k, None)):
                u, v = a[part].sum(axis=0), b[part].sum(axis=0)
                _, m = _split(u, v)
                for cut in (slice(0, m), slice(m, None)) if m else (slice(0, None),):
                    out[part, cut] = _leaf(u[cut], v[cut])
                    gain += u[cut].sum() ** 2 / (v[cut].sum() + RIDGE)
            if gain > best[0]:
                best = (gain, out if axis == 0 else out.T)
    return best


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 200, rate: float = 0.1, bins: int = 48, n_pairs: int = 6, pair_bins: int = 8, pair_cycles: int = 30) -> Gam:
    """Fit on rows x with labels y (0 or 1). Rows of one label or none give a constant score."""
    if not len(y):
        return Gam(base=float(np.log(0.7 / 0.3)) + 1e-9)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    gam = Gam(base=float(np.log(mean / (1 - mean))))
    if len(np.unique(y)) < 2:
        return gam
    quantiles = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
    gam.edges, gam.coarse = quantiles(bins), quantiles(pair_bins)
    fine = [np.searchsorted(e, c, side="right") for e, c in zip(gam.edges, x.T)]
    gam.single = [np.zeros(len(e) + 1) for e in gam.edges]
    z = np.full(len(y), gam.base)
    for _ in range(cycles):
        for i, b in enumerate(fine):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b, y - p, len(gam.single[i])), np.bincount(b, p * (1 - p), len(gam.single[i])))
            gam.single[i] += step
            z += step[b]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(gam.coarse, x.T)]
    width = [len(e) + 1 for e in gam.coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell, n = 1 / (1 + np.exp(-z)), coarse[i] * width[j] + coarse[j], width[i] * width[j]
        return np.bincount(cell, y - p, n).reshape(width[i], width[j]), np.bincount(cell, p * (1 - p), n).reshape(width[i], width[j])

    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_pair_tree(*grids(*ij))[0])[:n_pairs]
    tables = {ij: np.zeros((width[ij[0]], width[ij[1]])) for ij in chosen}
    for _ in range(pair_cycles):
        for i, j in chosen:
            step = rate * _pair_tree(*grids(i, j))[1]
            tables[i, j] += step
            z += step[coarse[i], coarse[j]]
    gam.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return gam


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = 20_000, **options) -> Gam:
    """Fit on at most `rows` labelled documents, chosen by the hash of their id; held-out ids never take part.

    Null labels and ids are left out; of several labels for an id the smallest counts. The sample's ids are the
    only thing broadcast, its features the only thing collected: both are bounded by `rows` (repeated documents
    are cut to that number too).
    """
    clean = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    sample = clean.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.col(f"`{text}`").alias("__text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int64()), pa.array(features(raw, offs).tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = found.mapInArrow(run, "doc_id bigint, quality bigint, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.quality for r in got], dtype=float), **options)


def score_quality(df: DataFrame, gam: Gam, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """df with score and predicted. Null and empty texts are scored like any other; same-named columns go."""
    df = without(df, ["score", "predicted"])

    def run(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list]:
        s = gam.score(features(raw, offs))
        return np.ones(len(s), bool), [s, (s >= threshold).astype(np.int32)]

    return map_rows(df, text, {"score": "double", "predicted": "int"}, run)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op6: one row for each row of docs, repeated ones too. Null and empty texts are scored like any other
    (all features 0), a null doc_id is never held out, extra columns are not read, empty tables give an empty result; without
    labels all get one score."""
    docs = docs.select("doc_id", "text")

    def slim(gam: Gam) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, raw, offs in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(gam.score(features(raw, offs)))], names=["doc_id", "score"])

        return docs.mapInArrow(run, "doc_id bigint, score double")

    scored = slim(train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def drop_rejected(df: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of df that the classifier keeps, columns as they were, whatever they are called.

    Null and empty texts are judged by their features like any other, equal texts alike; a score of just `threshold` stays.
    """
    gam = train(df, labels)
    return map_rows(df, "text", {}, lambda raw, offs: (gam.score(features(raw, offs)) >= threshold, []))
