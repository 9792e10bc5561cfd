"""Vectorised text work on the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D] byte by byte; bytes of multi-byte characters are word bytes.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about `limit` bytes of text; gives (rows, bytes, offsets).

    Null texts count as empty. A text longer than the limit is a run of its own, never cut.
    """
    for batch in batches:
        i = batch.schema.get_field_index(column)
        texts = batch.column(i).cast(pa.large_binary())
        if not len(texts):
            continue
        if texts.null_count:
            texts = texts.fill_null(b"")
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            to = min(to, len(texts))
            yield batch.slice(at, to - at), raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (two bytes, C3 80 to C3 9E, without the times sign) lower-cased."""
    out = LOWER[raw]
    if len(raw) > 1:
        out[1:] += (((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) * 32).astype(np.uint8)
    return out


def word_bounds(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes of `kind` that stays inside a row."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = kind[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offs[(offs > 0) & (offs < len(raw))]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n or more."""
    size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            up = np.full(size, BASE, np.uint64)
            down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS.clear()
            _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a hash over all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial hash from prefix sums, then mixed."""
    up, down = powers(len(lowered) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(lowered) + 1, np.uint64)
        np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * up[: len(lowered)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts])


def hash_word(word: str) -> int:
    """The hash that word_hashes gives to this word."""
    raw = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def lookup(sorted_keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: int = -1) -> np.ndarray:
    """values[i] where sorted_keys[i] == h, else missing. A table on 16 hash bits rejects most misses early."""
    out = np.full(len(h), missing, values.dtype)
    if not len(sorted_keys) or not len(h):
        return out
    seen = np.zeros(1 << 16, bool)
    seen[(sorted_keys >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_keys, h[maybe]), len(sorted_keys) - 1)
    hit = sorted_keys[at] == h[maybe]
    out[maybe[hit]] = values[at[hit]]
    return out
