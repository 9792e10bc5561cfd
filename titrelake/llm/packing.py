"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Documents become token ids in the tasks that read them (each distinct word is encoded once a task), long ones are cut into
pieces. Only narrow rows of pieces move: they are dealt into groups of bounded size, and each group is packed on its own,
longest piece first. A piece goes where the sum over residual gaps of the squared number of open sequences with that gap
becomes smallest. Sequences that a group leaves half empty are opened again and their pieces packed anew together with
those of other groups, until one group is left.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, cut_table, without
from .textarrays import LOWER, SPACED, slices

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
FOLDER = "/opt/tokenizers"
#: Pieces that are packed together, and words that a task remembers.
GROUP, MEMORY, MARKED = 8192, 1 << 20, 128
#: ASCII bytes by kind: 1 letters, 2 digits, 3 others; 0 for apostrophes and bytes of longer characters, which join their neighbours.
KIND = np.full(256, 3, np.uint8)
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
KIND[0x30:0x3A] = 2
KIND[0x27] = 0
KIND[0x80:] = 0


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str = VOCABULARY, folder: str = FOLDER) -> str:
    """Path of a public tokenizer's file, given by the module in `folder`."""
    if folder not in sys.path:
        sys.path.append(folder)
    import public_tokenizers

    return public_tokenizers.path(name)


def units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the stretches that are encoded on their own: words between ASCII white space, cut where ASCII letters,
    digits and other characters meet and between digits. There the tokenizer splits as well, and nothing else joins."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside, kind = SPACED[raw], KIND[raw]
    cut_ = np.ones(len(raw) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut_[1:-1] = (inside[:-1] != inside[1:]) | ((a > 0) & (b > 0) & ((a != b) | (a == 2)))
    cut_[offs] = True
    at = np.flatnonzero(cut_)
    at = at[:-1][inside[at[:-1]]], at[1:][inside[at[:-1]]]
    return *at, np.searchsorted(offs, at[0], side="right") - 1


class Encoder:
    """Token ids of texts by a tokenizer of lower-cased words that drops white space: ids of a text are those of its units in a row.

    Each distinct unit is encoded once and remembered, up to `memory` units; then the memory starts anew. A slice with the
    tokenizer's marks for special tokens (`<|`) is encoded text by text, as such a token is one unit, in its own case only.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.model, self.memory = tokenizer(path), memory
        self.stop, token = next((i, t) for i, t in self.model.get_added_tokens_decoder().items() if t.special)
        self.mark = token.content.encode()
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > self.memory:
            self.known, self.pool, self.at = {}, self.pool[:0], np.zeros(1, np.int64)
        new = [w for w in words if w not in self.known]
        if not new:
            return
        # many units are encoded as one text, a special token after each, which tells their ids apart
        ids = np.concatenate([np.asarray(self.model.encode_batch_fast([(self.mark.join(new[k : k + MARKED]) + self.mark).decode()], add_special_tokens=False)[0].ids, np.uint32) for k in range(0, len(new), MARKED)])
        ends = np.flatnonzero(ids == self.stop)
        self.at = np.concatenate([self.at, self.at[-1] + ends - np.arange(len(ends))])
        self.pool = np.concatenate([self.pool, ids[ids != self.stop]])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def encode(self, raw: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts raw[offs[k]:offs[k+1]], each followed by `end`, and where each text's ids begin."""
        if len(raw) and np.any((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)):
            texts = [raw[a:b].tobytes().decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            ids = [[*self.model.encode(t, add_special_tokens=False).ids, end] for t in texts]
            return np.fromiter((t for x in ids for t in x), np.uint32), np.cumsum([0, *map(len, ids)])
        starts, ends, rows = units(raw, offs)
        upto = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=upto[1:])
        body = np.ascontiguousarray(LOWER[raw[SPACED[raw]]]) if len(raw) else raw
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(body)]).dictionary_encode()
        said = words.dictionary.to_pylist()
        self._learn(said)
        number = np.fromiter((self.known[w] for w in said), np.int64, len(said))[words.indices.to_numpy()]
        size = self.at[number + 1] - self.at[number]
        total = np.ones(len(offs) - 1, np.int64)
        np.add.at(total, rows, size)
        begin = np.zeros(len(offs), np.int64)
        np.cumsum(total, out=begin[1:])
        out = np.full(int(begin[-1]), end, np.uint32)
        said_ids = np.ones(len(out), bool)
        said_ids[begin[1:] - 1] = False
        out[said_ids] = self.pool[np.repeat(self.at[number] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return out, begin


def pieces(df: DataFrame, text: str = "text", most: int = SEQUENCE, end: int = END, path: str | None = None, ids: bool = True) -> DataFrame:
    """A row for each piece of each document: df's columns without the text, then task and nth (which tell pieces apart), piece
    (from 0), start (ids of the document before it), length, ids_crc32 (of little-endian 32-bit ids) and, if wanted, ids.

    Null and empty texts are the end id alone; repeated rows stay apart; documents of over `most` ids are cut into pieces of
    `most`, the last may be shorter. Columns of df with the added names are replaced.
    """
    added = {"task": "int", "nth": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"} | ({"ids": "array<bigint>"} if ids else {})
    df = without(df, list(added))
    names, at = df.columns, df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    keep = [c for c in plain.columns if c != f"c{at}"]
    types = dict(plain.dtypes)
    spec = ", ".join([f"{c} {types[c]}" for c in keep] + [f"a{i} {t}" for i, t in enumerate(added.values())])
    file = path or vocabulary()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nth, task = Encoder(file), 0, TaskContext.get().partitionId()
        for part, raw, offs in slices(batches, f"c{at}", 1 << 22):
            out, begin = encoder.encode(raw, offs, end)
            total = np.diff(begin)
            count = -(-total // most)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * most
            length = np.minimum(most, total[row] - start)
            first = begin[row] + start
            crc = [zlib.crc32(out[a:b].astype("<u4", copy=False)) for a, b in zip(first.tolist(), (first + length).tolist())]
            made = [pa.array(np.full(len(row), task, np.int32)), pa.array(nth + np.arange(len(row))), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                made.append(pa.ListArray.from_arrays(pa.array(np.append(first, begin[-1]).astype(np.int32)), pa.array(out.astype(np.int64))))
            nth += len(row)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).take(pa.array(row)) for c in keep] + made, names=[*keep, *(f"a{i}" for i in range(len(added)))])

    return plain.mapInArrow(each, spec).toDF(*[names[int(c[1:])] for c in keep], *added)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """The bin of each length, in the given order: with N[g] open bins of gap g, the sum of N[g]**2 over 0 < g < size is kept
    as small as it can be; of equal sums the smallest gap is filled, a new bin comes last."""
    n = np.zeros(size + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    home, made = np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        best = 2 * n[size - s] + 1 if s < size else 1  # of a new bin
        gaps = n[s:size]
        open_ = np.flatnonzero(gaps)
        if len(open_):
            # gap g becomes g - s: N[g - s] grows (a full bin counts for nothing) and N[g] shrinks
            cost = 2 * (np.where(open_ == 0, 0, n[open_]) - gaps[open_]) + np.where(open_ == 0, 1, 2)
            k = int(cost.argmin())
            if cost[k] <= best:
                g = s + int(open_[k])
                home[i] = bins[g].pop()
                n[g] -= 1
                n[g - s] += 1
                bins[g - s].append(home[i])
                continue
        home[i], made = made, made + 1
        if s < size:
            n[size - s] += 1
            bins[size - s].append(home[i])
    return home


def _packed(size: int, last: bool, slack: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "task", "nth"], ascending=[False, True, True], ignore_index=True)
        part["sequence_id"] = (np.int64(key[0]) << 24) + sum_of_squares(part["length"].to_numpy(), size)
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        of = part.groupby("sequence_id")["length"].agg(["sum", "size"]).sort_values("sum", kind="stable")
        loose = of.index[(of["sum"] < size - slack) & (of["size"].cumsum() <= len(part) / 4)]
        part["again"] = False if last else part["sequence_id"].isin(loose)
        return part[["task", "nth", "length", "sequence_id", "offset", "again"]]

    return run


def pack(df: DataFrame, size: int = SEQUENCE, group: int = GROUP, slack: float = 0.005) -> DataFrame:
    """df (rows with task, nth and length, at most `size`) with sequence_id and offset; lengths of a sequence stand one after
    the other without gaps and sum to at most `size`. df should be written out, as it is read several times.

    Groups take some `group` rows each, whatever their content: repeated rows and frequent lengths are dealt out like any
    others. Of each group the emptiest sequences, if they lack more than `slack` of their size, are packed anew with those of
    others: as many as hold a quarter of its rows at most, so that each pass has a quarter of the rows of the one before.
    """
    left = df.select("task", "nth", "length")
    n, base, placed = left.count(), 0, None
    while n:
        groups = -(-n // group)
        dealt = left.withColumn("g", F.pmod(F.xxhash64("task", "nth", F.lit(base)), F.lit(groups)) + base)
        out = cut(dealt.groupBy("g").applyInPandas(_packed(size, groups == 1, int(slack * size)), "task int, nth bigint, length bigint, sequence_id bigint, offset bigint, again boolean"))
        now = out.where("NOT again").select("task", "nth", "sequence_id", "offset")
        placed = now if placed is None else placed.unionByName(now)
        left, base = out.where("again").select("task", "nth", "length"), base + groups
        n = left.count() if groups > 1 else 0
    if placed is None:
        return df.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return df.join(placed, ["task", "nth"]).select(*[F.col(f"`{c}`") for c in df.columns], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed pieces (with ids, sequence_id and offset) as whole sequences, each bounded by its size."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def pack_documents(df: DataFrame, text: str = "text", size: int = SEQUENCE, end: int = END, path: str | None = None, ids: bool = True) -> DataFrame:
    """pieces() of all documents with their sequence_id and offset; an empty table gives an empty result."""
    return pack(cut_table(pieces(df, text, size, end, path, ids)), size)


def pack_report(df: DataFrame) -> DataFrame:
    """The contract of op12, one row for each piece; only doc_id and text are read."""
    out = pack_documents(df.select("doc_id", "text"), ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
