"""Passages inside long unpunctuated lines, and repeated lines."""

import random

import pytest

from titrelake.llm import substring


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_51_words_in_unpunctuated_lines(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [text(51) for _ in range(400)]
    rows = [(2 * k + late, f"{text(30)} {p} {text(30)}") for k, p in enumerate(passages) for late in (0, 1)]
    got = substring.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 800, 2))
    assert all(r.n_words >= 26 for r in got)


def test_text_that_repeats_itself_is_not_cut_at_every_word():
    assert len(list(substring.units_of(b"ab " * 1200))) <= 110 and len(list(substring.units_of(b"ab cd " * 600))) <= 220


def test_whole_repeated_lines(spark):
    long = "a first sentence of this text has a good many words so that it makes a passage of its own today."
    rows = [
        (1, "Follow us. Read more here today.\nalpha beta\n" + long + "\none two three four five six"),
        (2, "new\n  follow us.  Read more here today.\nalpha beta\nother text\n" + long),
        (3, "one two three four five six and more"),
        (4, long + "\none two three four five six\none two three four five six"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = sorted((r.doc_id, text[r.doc_id][r.start : r.end], r.kept_doc_id) for r in substring.repeat_report(d).collect())
    line = "one two three four five six"
    assert got == sorted([(2, "follow us.  Read more here today.", 1), (2, long, 1), (4, f"{long}\n{line}\n{line}", 1)])
    kept = {r.doc_id: r.text for r in substring.remove_repeats(d).collect()}
    assert "follow" not in kept[2] and "alpha beta" in kept[2] and kept[1] == text[1] and kept[3] == text[3] and not kept[4].strip()
