"""Packing: ids as the tokenizer gives them, exact round trip, no gaps, few sequences."""

import random
import zlib

import numpy as np
import pytest

from titrelake.llm import packing


@pytest.fixture(scope="module")
def model():
    return packing.tokenizer(packing.vocabulary())


def plain(model, text, end=1):
    return [*model.encode(text or "", add_special_tokens=False).ids, end]


def fits(rows, size=4096):
    """Offsets of each sequence are gapless and no sequence is too long."""
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return of


def test_units_give_the_same_ids(model):
    r = random.Random(0)
    letters = [*"aAbZ019'.,\"<|>-_ \t\n\x0b\xa0éÉßıİſĶ́​　Σς中文😀", "'s", "'T", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "x1y2", "..", "'re'"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    for step, memory in ((4000, 1 << 20), (1, 40), (7, 300)):
        encoder = packing.Encoder(packing.vocabulary(), memory)
        for k in range(0, 4000 if step > 1 else 500, step):
            some = raw[k : k + step]
            out, begin = encoder.encode(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]), 1)
            assert [out[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [plain(model, t) for t in texts[k : k + step]]


def test_sum_of_squares_takes_the_best_step():
    r = np.random.default_rng(0)
    lengths, size = r.integers(1, 31, 400), 30
    home = packing.sum_of_squares(lengths, size)
    full: list[int] = []

    def squares(levels):
        return sum(c * c for c in np.bincount([size - x for x in levels if 0 < x < size], minlength=1))

    for s, h in zip(lengths.tolist(), home.tolist()):
        options = [squares([*full[:b], full[b] + s, *full[b + 1 :]]) for b in range(len(full)) if full[b] + s <= size] + [squares([*full, s])]
        full[h:] = [full[h] + s, *full[h + 1 :]] if h < len(full) else [s]
        assert squares(full) == min(options) and full[h] <= size


def test_report_over_documents(spark, sf, model):
    from titrelake.llm.queries import QUERIES

    got = QUERIES["op12_packing"](spark, sf).collect()
    docs = {r.doc_id: plain(model, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, k): (k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), zlib.crc32(np.array(ids[k * 4096 : (k + 1) * 4096], "<u4"))) for d, ids in docs.items() for k in range(-(-len(ids) // 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len(fits(got)) <= -(-sum(map(len, docs.values())) // 4096) * 1.01 + 1


def test_edges_and_round_trip(spark, model):
    long = "word, 7 " * 3000
    rows = [(1, None, 5, "a"), (2, "", 5, "b"), (3, long, 6, None), (4, "same", 7, "c"), (4, "same", 7, "c"), (None, "ünïcode <|endoftext|>", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, Length int, piece string")
    out = packing.pack_documents(d).cache()
    assert out.columns == ["doc_id", "task", "nth", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = out.collect()
    fits(got)
    of = {r.sequence_id: list(r.ids) for r in packing.sequences(out).collect()}
    back = {}
    for r in got:
        assert of[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
        back.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    joined = {k: [t for _, ids in sorted(v) for t in ids] for k, v in back.items()}
    assert joined == {1: [1], 2: [1], 3: plain(model, long), 4: plain(model, "same") * 2, None: plain(model, rows[-1][1])}
    assert packing.pack_report(d.limit(0)).count() == 0


def test_many_groups_are_merged(spark):
    lengths = np.random.default_rng(1).integers(1, 400, 3000)
    d = spark.createDataFrame([(i % 7, i, int(n)) for i, n in enumerate(lengths)], "task int, nth long, length long")
    out = packing.pack(d, size=1000, group=100).collect()
    assert len(out) == 3000
    assert len(fits(out, 1000)) <= -(-int(lengths.sum()) // 1000) * 1.02 + 1 and len({r.sequence_id >> 24 for r in out}) > 30
