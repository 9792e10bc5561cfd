"""Periodic runs of words: Main and Lorentz's divide and conquer over interned word ids.

A run is a stretch of words with smallest period q, at least two periods long, which no neighbouring word extends. The
texts of a batch are halved together, level by level. At each midpoint two Z-functions (of the right half before the left
one, and of both read backwards) give for every period how far it reaches to both sides; where both reaches make up a
period there is a repetition. What the node's ends cut short is left to a node above, the rest is deduplicated by
interval with the smallest period. Time is n log n for any text, memory is a few arrays of the longest text's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without
from .textarrays import SPACED, slices, word_bounds

#: Shortest run that counts, in words.
LEAST = 12
#: Words of a match that are compared for all positions at once, before the Z-boxes take over.
NEAR = 24
#: Words of nodes that are worked on together.
CHUNK = 1 << 20


def _same(s: np.ndarray, a: int, b: int) -> int:
    """Length of the common stretch of s from a and from b > a; a mark that stands in b's string only ends it."""
    done, step = 0, 64
    while True:
        x, y = s[a + done : a + done + step], s[b + done : b + done + step]
        off = np.flatnonzero(x[: len(y)] != y)
        if len(off):
            return done + int(off[0])
        done, step = done + len(y), step * 2


def z_functions(s: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Z-function of each of the strings that s holds one after the other; each ends with a mark that it holds only once.
    At its head a string has 0."""
    base = np.repeat(heads, sizes)
    z = np.zeros(len(s), np.int64)
    at = np.flatnonzero(s == s[base])
    at = at[at != base[at]]
    for k in range(1, NEAR + 1):
        z[at] = k
        at = at[s[at + k] == s[base[at] + k]]
        if not len(at):
            return z
    # s[lo:hi] is the stretch that reaches furthest of those equal to the head of their string; inside it a position repeats
    # the one a multiple of d = lo - b earlier, and only where that one's match ends with the stretch can further words be alike
    c, step, head, lo, hi = 0, 64, -1, -1, -1
    while c < len(at):
        i, b = int(at[c]), int(base[at[c]])
        if b != head:
            head, lo, hi = b, b, b
        have = NEAR
        if i < hi:
            w = at[c : c + step]
            w = w[: int(np.searchsorted(w, hi))]
            r, room = (w - b) % (lo - b), hi - w
            inner = np.where(r == 0, hi - lo, z[b + r])
            even = np.flatnonzero((inner == room) & (s[b + room] == s[hi]))
            known = int(even[0]) if len(even) else len(w)
            z[w[:known]] = np.minimum(inner, room)[:known]
            c, step = c + known, 64 if len(even) else step * 2
            if not len(even):
                continue
            i = int(at[c])
            have = max(have, hi - i)
        z[i] = have + _same(s, b + have, i + have)
        c += 1
        if i + z[i] > hi:
            lo, hi = i, i + int(z[i])
    return z


def _halves(x: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Z-functions of right # left, and of left # right read backwards, for each node, and where the nodes' strings begin."""
    sizes = hi - lo + 2
    heads = np.cumsum(sizes) - sizes
    t = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    out = []
    for first, there, back in ((hi - mid, mid, 1), (mid - lo, mid - 1, -1)):
        second = lo if back == 1 else hi - 1
        f = np.repeat(first, sizes)
        place = np.where(t < f, np.repeat(there, sizes) + back * t, np.repeat(second, sizes) + back * (t - f - 1))
        s = x[np.clip(place, 0, len(x) - 1)]
        s[heads + first] = -1
        s[heads + sizes - 1] = -2
        out.append(z_functions(s, heads, sizes))
    return out[0], out[1], heads


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners 0 0 1 1 1 and numbers 1 2 1 2 3."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def _crossing(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the repetitions of each node that touch both of its halves or end at its midpoint."""
    mid = (lo + hi) // 2
    fore, aft, heads = _halves(x, lo, mid, hi)
    # a whole period in the right half: the words from the midpoint come again p words later
    j, p = _spread(hi - mid)
    ahead = fore[heads[j] + p]
    behind = aft[heads[j] + (mid - lo)[j] + 1 + (hi - mid)[j] - p]
    deep = np.flatnonzero(behind >= p)
    behind[deep] += aft[heads[j[deep]] + p[deep]]
    ok = (ahead + behind >= p) & (ahead + behind + p >= least)
    yield mid[j[ok]] - behind[ok], mid[j[ok]] + p[ok] + ahead[ok], p[ok]
    # or in the left half: the words up to the midpoint stand p words earlier as well
    j, p = _spread(mid - lo)
    behind = aft[heads[j] + p]
    ahead = fore[heads[j] + (hi - mid)[j] + 1 + (mid - lo)[j] - p]
    deep = np.flatnonzero(ahead >= p)
    ahead[deep] += fore[heads[j[deep]] + p[deep]]
    ok = (ahead + behind >= p) & (ahead + behind + p >= least)
    yield mid[j[ok]] - p[ok] - behind[ok], mid[j[ok]] + ahead[ok], p[ok]


def find(x: np.ndarray, offs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of `least` words or more in texts x[offs[k]:offs[k+1]] of word ids
    from 0, by text, start and period; starts count from 0 in each text."""
    found: list[np.ndarray] = []
    lo, hi = offs[:-1].astype(np.int64), offs[1:].astype(np.int64)
    while True:
        big = hi - lo >= max(least, 2)
        lo, hi = lo[big], hi[big]
        if not len(lo):
            break
        parts = np.searchsorted(np.cumsum(hi - lo), np.arange(CHUNK, int((hi - lo).sum()) + CHUNK, CHUNK)) + 1
        for a, b in zip([0, *parts[:-1].tolist()], parts.tolist()):
            if a < min(b, len(lo)):
                found += [np.column_stack(f) for f in _crossing(x, lo[a:b], hi[a:b], least) if len(f[0])]
        mid = (lo + hi) // 2
        lo, hi = np.column_stack([lo, mid]).ravel(), np.column_stack([mid, hi]).ravel()
    if not found:
        return np.zeros((0, 4), np.int64)
    start, end, q = np.concatenate(found).T
    text = np.searchsorted(offs, start, side="right") - 1
    # texts without words share their offset with the next text; the last of them is the one that holds the word
    first, last = offs[text], offs[text + 1]
    open_left = (start > first) & (x[np.maximum(start - 1, 0)] == x[np.maximum(start - 1, 0) + q])
    open_right = (end < last) & (x[np.minimum(end, len(x) - 1)] == x[np.minimum(end, len(x) - 1) - q])
    whole = ~(open_left | open_right)
    text, start, end, q, first = (v[whole] for v in (text, start, end, q, first))
    order = np.lexsort((q, end, start))
    text, start, end, q, first = (v[order] for v in (text, start, end, q, first))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    out = np.column_stack([text, start - first, end - start, q])[new]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


@dataclass
class Words:
    """The words of some texts: ids by text, and the bytes of the distinct words."""

    ids: np.ndarray
    offs: np.ndarray
    raw: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(raw: np.ndarray, offs: np.ndarray) -> Words:
        """Interned words [^\\x20\\x09-\\x0D]+ of texts raw[offs[k]:offs[k+1]]; ids are exact, no hashes."""
        starts, ends, rows = word_bounds(raw, offs, SPACED)
        body = raw[SPACED[raw]] if len(raw) else raw
        upto = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=upto[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        known = words.dictionary
        at = np.zeros(len(offs), np.int64)
        np.cumsum(np.bincount(rows, minlength=len(offs) - 1), out=at[1:])
        bounds = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1] if len(known) else np.zeros(1, np.int64)
        data = known.buffers()[2]
        return Words(words.indices.to_numpy().astype(np.int64), at, np.frombuffer(data, np.uint8) if data is not None else raw[:0], bounds)

    def folded(self, on: np.ndarray, g: np.ndarray) -> Words:
        """The texts that are `on` made periodic: word i >= a becomes word a + (i - a) % p with a = g % n and
        p = 1 + (n - a) // (3 + g % 8), for their n words."""
        n = np.diff(self.offs)
        on = on & (n > 0)
        a = g % np.maximum(n, 1)
        p = 1 + (n - a) // (3 + g % 8)
        k = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(self.ids)) - self.offs[k]
        to = np.where(on[k] & (i >= a[k]), a[k] + (i - a[k]) % p[k], i)
        return Words(self.ids[self.offs[k] + to], self.offs, self.raw, self.ends)

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts made of the kept words, with one space between words."""
        kept = np.flatnonzero(keep)
        ids = self.ids[kept]
        size = self.ends[ids + 1] - self.ends[ids] + 1
        upto = np.zeros(len(kept) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        out = np.full(int(upto[-1]), 0x20, np.uint8)
        for lo in range(0, len(kept), CHUNK):
            ids_, size_, to = ids[lo : lo + CHUNK], size[lo : lo + CHUNK] - 1, upto[:-1][lo : lo + CHUNK]
            within = np.arange(int(size_.sum())) - np.repeat(np.cumsum(size_) - size_, size_)
            out[np.repeat(to, size_) + within] = self.raw[np.repeat(self.ends[ids_], size_) + within]
        return out, upto[np.searchsorted(kept, self.offs)]


def repeated(words: Words, runs: np.ndarray) -> np.ndarray:
    """Mask of the words that a run holds after its first period."""
    steps = np.zeros(len(words.ids) + 1, np.int64)
    at = words.offs[runs[:, 0]] + runs[:, 1]
    np.add.at(steps, at + runs[:, 3], 1)
    np.add.at(steps, at + runs[:, 2], -1)
    return np.cumsum(steps[:-1]) > 0


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with `runs` (start word, length, period; by start, then period) and `collapsed`, the text whose runs are reduced
    to their first period, words joined by one space.

    Null and empty texts have no runs and collapse to an empty text; repeated rows are judged each for itself; columns
    named runs or collapsed are replaced, whatever their case; an empty table gives an empty result.
    """
    df = without(df, ["runs", "collapsed"])
    names, at = df.columns, df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    spec = ", ".join(f"{c} {t}" for c, t in [*plain.dtypes, ("runs", RUNS), ("collapsed", "string")])
    out_names = [*plain.columns, "runs", "collapsed"]
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, f"c{at}"):
            words = Words.of(raw, offs)
            runs = find(words.ids, words.offs, least)
            out, upto = words.joined(~repeated(words, runs))
            body = [out[a : max(a, b - 1)].tobytes().decode() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            cuts = np.searchsorted(runs[:, 0], np.arange(len(offs)))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(item)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(body, pa.string())], names=out_names)

    return plain.mapInArrow(each, spec).toDF(*names, "runs", "collapsed")


def run_report(df: DataFrame) -> DataFrame:
    """The contract of op11: texts made periodic by their ids, then digests of what find_runs finds; one row a document.

    A null doc_id has no digits to hash, so its text stays as it is. Nulls and empty texts have no runs. Only doc_id and
    text are read, so other columns cannot clash.
    """
    h = F.crc32(F.col("doc_id").cast("string")).cast("long")
    narrow = df.select("doc_id", F.col("text").alias("body"), h.alias("h"))
    spec = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, "body"):
            h = part.column("h").fill_null(1).to_numpy()
            words = Words.of(raw, offs).folded(h % 10 == 0, h // 10)
            runs = find(words.ids, words.offs)
            out, upto = words.joined(~repeated(words, runs))
            cuts = np.searchsorted(runs[:, 0], np.arange(len(offs))).tolist()
            best, listed = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = runs[a:b].tolist()
                best.append(min(own, key=lambda r: (-r[2], r[1], r[3]))[1:] if own else (None, None, None))
                listed.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for _, s, n, q in own).encode()).hexdigest())
            start, length, period = zip(*best)
            power = [None if q is None else 1000 * n // q for n, q in zip(length, period)]
            body = [hashlib.sha256(out[a : max(a, b - 1)]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            number = lambda v: pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), number(np.diff(cuts)), number(start), number(length), number(period), number(power), pa.array(listed, pa.string()), pa.array(body, pa.string())], names=[c.split()[0] for c in spec.split(", ")])

    return narrow.mapInArrow(each, spec)
