"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts and items are sequences of words. The CGK walk reads the window that starts at a word: at step j it emits
the word under the cursor and moves on if a random bit of (j, word) says so, which turns edit distance into
Hamming distance between walks. Each repetition samples a few steps of the walk and looks the emitted words up in
a table of the items' walks, started at several words of each item, so that edits in one part leave others to be
found. Candidates are verified by exact edit distance on words.

Words that no item has are one symbol: this changes no distance between an item and a text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows
from .textarrays import ALNUM, folded, lookup, mixed, slices, word_bounds, word_hashes


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edit distance between the item and any piece of text: (distance, start, end).

    Sellers' recurrence with free ends, a row for each item word; distances above `most` come back as most + 1.
    """
    width = len(text) + 1
    cost, begin = np.zeros(width, np.int64), np.arange(width)
    for i, w in enumerate(item.tolist(), 1):
        best = np.empty(width, np.int64)
        start = np.empty(width, np.int64)
        best[0], start[0] = i, 0
        swap, drop = cost[:-1] + (text != w), cost[1:] + 1
        take = swap <= drop
        best[1:], start[1:] = np.where(take, swap, drop), np.where(take, begin[:-1], begin[1:])
        # an added text word: a running minimum of (cost - place)
        key = (best - np.arange(width)) * (2 * width) + np.arange(width)
        low = np.minimum.accumulate(key)
        from_ = low % (2 * width)
        cost, begin = low // (2 * width) + np.arange(width), start[from_]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= most else (most + 1, 0, 0)


class Index:
    """Walk tables of the items, one for each repetition.

    Long and middling items have tables of their own, as a walk must mostly stay inside its item. Items of under
    `brief` words allow so few edits that one of (edits + 1) pieces is whole: their walks always move on, over one
    piece, and miss nothing. middle_walks: steps, samples and repetitions for items of under `middling` words.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, repetitions: int = 3, samples: int = 6, steps: int = 14, stride: int = 3, shortest: int = 8, brief: int = 10, middling: int = 51, middle_walks: tuple[int, int, int] = (8, 5, 5), seed: int = 7) -> None:
        raw = [np.frombuffer((t or "").encode(), np.uint8) for _, t in items]
        offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        lowered = folded(np.concatenate(raw) if raw else np.zeros(0, np.uint8))
        starts, ends, rows = word_bounds(lowered, offs, ALNUM)
        hashes = word_hashes(lowered, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.keys, inverse = np.unique(hashes, return_inverse=True)
        self.symbols = np.arange(1, len(self.keys) + 1, dtype=np.int32)  # 0: a word of no item, or no word
        self.words = [inverse[rows == k].astype(np.int32) + 1 for k in range(len(items))]
        self.ids = [i for i, _ in items]
        self.most = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        self.steps = max(steps, brief, middle_walks[0])
        rng = np.random.default_rng(seed)
        self.reps = []
        lengths = np.array([len(w) + self.steps for w in self.words], dtype=np.int64)
        padded = np.concatenate([*(np.append(w, np.zeros(self.steps, np.int32)) for w in self.words), np.zeros(1, np.int32)])
        begin = np.cumsum(lengths) - lengths
        pieces, middle, long = defaultdict(list), [], []
        for n, w in enumerate(self.words):
            if 0 < len(w) < brief:
                piece = max(1, len(w) // (self.most[n] + 1))
                pieces[piece] += [(n, k * piece) for k in range(self.most[n] + 1) if (k + 1) * piece <= len(w)]
            elif 0 < len(w) < middling:
                middle += [(n, o) for o in range(max(1, len(w) - shortest // 2))]
            elif len(w):
                long += [(n, o) for o in range(0, max(1, len(w) - shortest + 1), stride)]
        tables = [(e, piece, None) for piece, e in sorted(pieces.items())]
        tables += [(e, s, m) for e, s, m, times in ((middle, *middle_walks), (long, steps, samples, repetitions)) if e for _ in range(times)]
        for e, s, m in tables:
            entries = np.array(e, dtype=np.int64)
            moves = np.ones((s, len(self.keys) + 1), np.int8) if m is None else rng.integers(0, 2, (s, len(self.keys) + 1), dtype=np.int8)
            at = np.arange(s) if m is None else np.sort(np.concatenate(([0], 1 + rng.permutation(s - 1)[: m - 1])))
            cursor = begin[entries[:, 0]] + entries[:, 1]
            if m is not None:  # a walk that stays at its first words would find all places of a common word
                going = self.walk(np.arange(len(padded)), cursor, moves, at, padded)[-1] - cursor >= 2
                entries, cursor = entries[going], cursor[going]
            seen = self.walk(padded, cursor, moves, at)
            firsts = [np.isin(np.arange(len(self.keys) + 1), x) for x in seen]
            keys, inverse = np.unique(self.key(seen), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            edges = np.searchsorted(inverse[order], np.arange(len(keys) + 1))
            self.reps.append((moves, at, firsts, keys, edges, entries[order].astype(np.int32)))

    @staticmethod
    def key(seen: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(seen[0]), np.uint64)
        for s in seen:
            out = mixed(out ^ (s.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        return out

    @staticmethod
    def walk(emitted: np.ndarray, cursor: np.ndarray, moves: np.ndarray, at: np.ndarray, symbols: np.ndarray | None = None) -> list[np.ndarray]:
        """What stands in `emitted` under the cursors at the sampled steps, as `symbols` (by default the same) move them."""
        symbols, seen = emitted if symbols is None else symbols, []
        for j in range(int(at[-1]) + 1):
            if j in at:
                seen.append(emitted[cursor])
            cursor = cursor + moves[j][symbols[cursor]]
        return seen

    def candidates(self, symbols: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, word of the text where the item would start) for a padded array of symbols.

        A window is dropped as soon as a sampled word is none of those that items have at that sample.
        """
        starts = np.flatnonzero(symbols[: len(symbols) - self.steps])
        for moves, at, firsts, keys, edges, entries in self.reps:
            origin, cursor, seen, wanted = starts, starts, [], iter(firsts)
            for j in range(int(at[-1]) + 1):
                s = symbols[cursor]
                if j in at:
                    ok = next(wanted)[s]
                    origin, cursor, s, seen = origin[ok], cursor[ok], s[ok], [x[ok] for x in seen]
                    seen.append(s)
                cursor = cursor + moves[j][s]
            found = lookup(keys, np.arange(len(keys)), self.key(seen))
            for i in np.flatnonzero(found >= 0).tolist():
                for n, o in entries[edges[found[i]] : edges[found[i] + 1]].tolist():
                    yield n, int(origin[i]) - o

    def hits(self, symbols: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of the best verified place of each item in each row."""
        padded = np.append(symbols, np.zeros(self.steps + 1, np.int32))
        places, present = defaultdict(set), np.zeros(len(self.keys) + 1, bool)
        for n, p in self.candidates(padded):
            q = min(max(p, 0), len(rows) - 1)
            for r in {int(rows[q]), int(rows[min(q + len(self.words[n]) // 2, len(rows) - 1)])}:
                places[r, n].add(p)
        for (r, n), starts in places.items():
            lo, hi = np.searchsorted(rows, [r, r + 1])
            item, most, best, upto = self.words[n], self.most[n], None, -1
            for p in sorted(starts):
                a, b = max(lo, p - most), min(hi, p + len(item) + most)
                if b <= a or (p <= upto):
                    continue
                piece = symbols[a:b]
                present[piece] = True
                shared = np.count_nonzero(present[item])
                present[piece] = False
                if shared < len(item) - most:
                    continue
                d, s, e = edit_distance(item, piece, most)
                if d <= most and (best is None or d < best[0]):
                    best = (d, a + s, a + e)
                upto = p if d == 0 else upto
                if d == 0:
                    break
            if best:
                yield r, n, best[0], int(best[1] - lo), int(best[2] - lo)


def items_of(benchmark: DataFrame, words: int = 400_000) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `words` words at most, so that what is sent to executors is bounded (some 60 MB).

    A usual benchmark is one block, that is one pass over the documents; a larger one takes a pass for each block.
    """
    held, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = r.text.count(" ") + 1
        if held and size + n > words:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """One row for each document and item found in it: kept columns, item_id, item_words, distance, similarity,
    start_word and end_word of the closest place found.

    A document holds an item if a passage is within (1 - similarity) of the item's words in edits. Null texts and
    items without words match nothing; a null or repeated item_id is reported as it is; repeated documents are reported
    once each; of equally close places the first counts. Case (of A-Z and Latin-1) and punctuation do not count. Kept
    columns with one of the added names are left out. Empty tables give an empty result.
    """
    added = ("item_id", "item_words", "distance", "similarity", "start_word", "end_word")
    keep = tuple(c for c in keep if c.lower() not in added)
    slots = [f"k{i}" for i in range(len(keep))]
    cols = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, slots)], F.col(f"`{text}`").alias("__text"))
    spec = "".join(f"{c} {t}, " for c, t in cols.dtypes[:-1])

    def found_in(items: list[tuple[int, str]]) -> DataFrame:
        index = Index(items, **options)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, raw, offs in slices(batches, "__text"):
                lowered = folded(raw)
                starts, ends, rows = word_bounds(lowered, offs, ALNUM)
                if not len(starts):
                    continue
                symbols = lookup(index.keys, index.symbols, word_hashes(lowered, starts, ends), 0)
                got = list(index.hits(symbols, rows))
                if got:
                    r, n, d, s, e = (np.array(x) for x in zip(*got))
                    length = np.array([len(index.words[k]) for k in n])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c).take(pa.array(r)) for c in slots] + [pa.array([index.ids[k] for k in n], pa.int64()), pa.array(length), pa.array(d), pa.array(1 - d / length), pa.array(s), pa.array(e)],
                        names=[*slots, *added],
                    )

        return cols.mapInArrow(run, f"{spec}item_id bigint, item_words bigint, distance bigint, similarity double, start_word bigint, end_word bigint").toDF(*keep, *added)

    out = None
    for items in items_of(benchmark):
        more = found_in(items)
        out = more if out is None else out.unionByName(more)
    return found_in([]) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns as they were, whatever they are called.

    Null and empty texts stay; repeated documents go or stay together; an empty table or benchmark changes nothing.
    """

    def kept(df: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        index = Index(items, **options)

        def run(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list]:
            starts, ends, rows = word_bounds(lowered := folded(raw), offs, ALNUM)
            ok = np.ones(len(offs) - 1, bool)
            if len(starts):
                symbols = lookup(index.keys, index.symbols, word_hashes(lowered, starts, ends), 0)
                ok[[r for r, *_ in index.hits(symbols, rows)]] = False
            return ok, []

        return map_rows(df, text, {}, run)

    for items in items_of(benchmark):
        docs = kept(docs, items)
    return docs


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every (doc_id, item_id) with a passage at a similarity of 0.8 or more."""
    return find_leaks(docs.select("doc_id", "text"), benchmark)
