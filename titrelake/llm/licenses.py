"""License scan: an exact containment join of text blocks (runs of neighbouring lines) with license templates.

Tokens are ordered by their frequency in the whole corpus, rare first. A block that contains a share t of a
template of n tokens has at least one of its n - ceil(t*n) + 1 rarest tokens (prefix filter) and at least
ceil(t*n) words (length filter), and what follows the first shared token must suffice for the rest (positional
filter). What is left is verified. The filters lose nothing.

A block is a line and those after it until these have as many words as the template: a notice that starts in the line
is in the block however it is wrapped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import ALNUM, LOWER, hash_word, lookup, slices, word_bounds, word_hashes

#: The contract's phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of well-known licenses and usual notices, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
)
#: Whole license texts and notices, by label.
WHOLE_TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))


class Vocabulary:
    """Ids of the words that templates and phrases use, and their hashes in sorted order."""

    def __init__(self, templates, phrases) -> None:
        self.words = sorted({w for _, t in templates for w in words_of(t)} | {w for p in phrases for w in p.split()})
        pairs = sorted((hash_word(w), i) for i, w in enumerate(self.words))
        self.keys = np.array([h for h, _ in pairs], dtype=np.uint64)
        self.ids = np.array([i for _, i in pairs], dtype=np.int32)
        self.id_of = {w: i for i, w in enumerate(self.words)}


class Page:
    """The words of some texts: which row, place in the row, line, and vocabulary id (-1: none)."""

    def __init__(self, vocabulary: Vocabulary, raw: np.ndarray, offs: np.ndarray, beyond: int = 8) -> None:
        lowered = LOWER[raw]
        self.starts, self.ends, self.rows = word_bounds(lowered, offs, ALNUM)
        self.n = np.bincount(self.rows, minlength=len(offs) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        ids = lookup(vocabulary.keys, vocabulary.ids, word_hashes(lowered, self.starts, self.ends))
        self.hits = np.flatnonzero(ids >= 0)
        data = lowered.tobytes()
        right = [data[a:b].decode() == vocabulary.words[i] for a, b, i in zip(self.starts[self.hits].tolist(), self.ends[self.hits].tolist(), ids[self.hits].tolist())]
        self.hits = self.hits[np.array(right, dtype=bool)]
        self.ids = np.full(len(ids) + beyond, -1, np.int32)
        self.ids[self.hits] = ids[self.hits]
        breaks = np.flatnonzero(raw == 10)
        self.line = np.searchsorted(breaks, self.starts) + self.rows  # rows part lines too


def corpus_counts(df: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """For each vocabulary word the number of lines of the corpus that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for _, raw, offs in slices(batches, text):
            page = Page(vocabulary, raw, offs)
            both = np.unique(page.line[page.hits] * len(total) + page.ids[page.hits])
            total += np.bincount(both % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["id", "n"])

    counts = df.select(F.col(f"`{text}`")).mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary.words), np.int64)
    for r in counts.collect():
        out[r.id] = r.n
    return out


class Join:
    """The templates as sets of tokens by global rank, with their prefixes, for one threshold."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, templates, threshold: float) -> None:
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.templates = [(label, sorted({int(self.rank[vocabulary.id_of[w]]) for w in words_of(t)})) for label, t in templates]
        self.need = [ceil(threshold * len(s) - 1e-9) for _, s in self.templates]
        self.by_prefix = defaultdict(list)
        for k, (_, s) in enumerate(self.templates):
            for place, token in enumerate(s[: len(s) - self.need[k] + 1]):
                self.by_prefix[token].append((k, place))
        self.words = [len(words_of(t)) for _, t in templates]
        self.in_prefix = np.zeros(len(counts), bool)
        self.in_prefix[list(self.by_prefix)] = True

    def matches(self, block: list[int], n_words: int) -> Iterator[tuple[int, float]]:
        """Templates (by number) contained in a block, given its vocabulary ranks in order and its word count."""
        tried = set()
        for at, token in enumerate(block):
            for k, place in self.by_prefix.get(token, ()):
                template = self.templates[k][1]
                if k in tried:
                    continue
                tried.add(k)
                if n_words < self.need[k] or 1 + min(len(template) - place - 1, len(block) - at - 1) < self.need[k]:
                    continue
                share = len(set(template).intersection(block))
                if share >= self.need[k]:
                    yield k, share / len(template)

    def runs(self, ranks: np.ndarray, hits: np.ndarray, first: list[int]) -> Iterator[tuple[int, int, float]]:
        """(template, line, containment) of the blocks of one text that contain a template and need their first line for it.

        ranks and hits: the vocabulary words and their places in the text; first: the place of each line's first word, and
        the text's length at last. A template's block from each line slides over the text: a word adds one distinct token to
        those starts (an interval of them) whose block holds it and no earlier one of its kind. Linear in the text for each
        template that has a prefix token there.
        """
        first = np.asarray(first)
        near = {k for token in np.unique(ranks[self.in_prefix[ranks]]).tolist() for k, _ in self.by_prefix[token]}
        for k in sorted(near):
            tokens, need = np.asarray(self.templates[k][1]), self.need[k]
            place = np.minimum(np.searchsorted(tokens, ranks), len(tokens) - 1)
            own = tokens[place] == ranks
            at, token = hits[own], place[own]
            if len(np.unique(token)) < need:
                continue
            end = np.minimum(len(first) - 1, np.searchsorted(first, first[1:] + self.words[k]))
            lo, hi = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[end])
            order = np.argsort(token, kind="stable")
            before = np.full(len(at), -1)
            same = token[order[1:]] == token[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            i = np.arange(len(at))
            enter = np.maximum(np.searchsorted(lo, before, side="right"), np.searchsorted(hi, i, side="right"))
            leave = np.searchsorted(lo, i, side="right")
            steps = np.zeros(len(first) + 1, np.int64)
            np.add.at(steps, enter, 1)
            np.add.at(steps, np.maximum(leave, enter), -1)
            rare = np.concatenate([[0], np.cumsum(token <= len(tokens) - need)])  # places of the prefix
            good = (rare[hi] > rare[lo]) & (first[end] - first[:-1] >= need) & (np.cumsum(steps)[: len(lo)] >= need)
            found: list[tuple[int, int, float]] = []
            for start in np.flatnonzero(good).tolist():
                reach = self._reach(at, token, int(lo[start]), int(hi[start]), len(tokens))
                held = reach[reach >= 0]
                best = len(held) / len(tokens)
                upto = int(np.searchsorted(first, held.max(), side="right"))
                if start + 1 < upto:
                    rest = self._reach(at, token, int(lo[start + 1]), int(np.searchsorted(at, first[upto])), len(tokens))
                    if np.count_nonzero(rest >= 0) == len(held):
                        continue
                if found and found[-1][1] > start:  # the rest of a notice that starts before, or its better part
                    if found[-1][2] >= best:
                        continue
                    found.pop()
                found.append((start, upto, best))
            yield from ((k, start, best) for start, _, best in found)

    @staticmethod
    def _reach(at: np.ndarray, token: np.ndarray, lo: int, hi: int, n: int) -> np.ndarray:
        """For each of n tokens its first place among the hits lo to hi, or -1."""
        out = np.full(n, -1)
        out[token[lo:hi][::-1]] = at[lo:hi][::-1]
        return out


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES + WHOLE_TEXTS, phrases=PHRASES, threshold: float = 0.9) -> DataFrame:
    """The kept columns with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches lists the blocks (their first line, label, containment) that contain a template to the threshold; score is the
    largest containment, 1 where a phrase stands, else 0. Null and empty texts give zero counts and empty labels. Each row
    is judged by itself, so repeated rows are reported once each; of blocks that overlap with equal containment the later
    start counts. Kept columns with one of the added names are left out. An empty table gives an empty result.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    keep = tuple(c for c in keep if c.lower() not in added)
    longest = max((len(p.split()) for p in phrases), default=1)
    vocabulary = Vocabulary(templates, phrases)
    join = Join(vocabulary, corpus_counts(df, text, vocabulary), templates, threshold)
    slots = [f"k{i}" for i in range(len(keep))]
    cols = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, slots)], F.col(f"`{text}`").alias("__text"))
    spec = "".join(f"{c} {t}, " for c, t in cols.dtypes[:-1])
    match = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in slices(batches, "__text"):
            page = Page(vocabulary, raw, offs, longest)
            n = len(offs) - 1
            base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            labels, base_labels, score, found = defaultdict(set), defaultdict(set), np.zeros(n), defaultdict(list)
            for phrase, label in phrases.items():
                ids = [vocabulary.id_of[w] for w in phrase.split()]
                at = page.hits[page.ids[page.hits] == ids[0]]
                for k, i in enumerate(ids[1:], 1):
                    at = at[page.ids[at + k] == i]
                at = at[page.rows[np.minimum(at + len(ids) - 1, len(page.rows) - 1)] == page.rows[at]] if len(at) else at
                for w in at.tolist():
                    r, place = int(page.rows[w]), w - int(page.first[page.rows[w]])
                    base[r] += 1
                    first[r] = place if first[r] < 0 else min(first[r], place)
                    last[r] = max(last[r], place)
                    base_labels[r].add(label)
                    score[r] = 1.0
            ranks = join.rank[page.ids[page.hits]] if len(page.hits) else np.zeros(0, np.int64)
            for r in np.unique(page.rows[page.hits[join.in_prefix[ranks]]]).tolist():
                lo, hi = page.first[r], page.first[r + 1]
                a, b = np.searchsorted(page.hits, [lo, hi])
                lines, starts = np.unique(page.line[lo:hi], return_index=True)
                for k, at, share in join.runs(ranks[a:b], page.hits[a:b] - lo, [*starts.tolist(), int(hi - lo)]):
                    labels[r].add(join.templates[k][0])
                    score[r] = max(score[r], share)
                    found[r].append({"line": int(lines[at] - lines[0]), "label": join.templates[k][0], "containment": share})
            none = pa.array(first < 0)
            empty = pa.scalar(None, pa.int64())
            text_of = lambda sets: pa.array([",".join(sorted(sets)) for sets in sets])
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in slots]
                + [pa.array(page.n.astype(np.int64)), pa.array(base), pa.compute.if_else(none, empty, pa.array(first)), pa.compute.if_else(none, empty, pa.array(last))]
                + [text_of([base_labels[r] for r in range(n)]), text_of([base_labels[r] | labels[r] for r in range(n)]), pa.array(score), pa.array([found[r] for r in range(n)], match)],
                names=[*slots, *added],
            )

    return cols.mapInArrow(run, f"{spec}n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<line: bigint, label: string, containment: double>>").toDF(*keep, *added)


def license_report(df: DataFrame) -> DataFrame:
    """The contract of op2."""
    return scan(df.select("doc_id", "text")).drop("matches")
