"""Items of every length at the similarity's limit, with evenly spread edits."""

import random

import numpy as np
import pytest

from titrelake.llm import decontamination


def spread(words, kind, shift):
    """The words with as many evenly spread edits as the limit allows; 0 is a word of no item."""
    most = int(0.2 * len(words) + 1e-9)
    at = {min(len(words) - 1, shift + round(k * len(words) / most)) for k in range(most)}
    parts = {"change": lambda w: [0], "insert": lambda w: [w, 0], "delete": lambda w: []}
    return [x for k, w in enumerate(words) for x in (parts[kind](w) if k in at else [w])]


@pytest.mark.parametrize("kind", ["change", "insert", "delete"])
def test_evenly_spread_edits_at_the_limit(kind):
    rng = random.Random(8)
    lengths = [n for n in range(20, 61) for _ in range(15)]
    index = decontamination.Index([(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate(lengths)])
    lost = []
    for n, w in enumerate(index.words):
        s = np.array([0] * 9 + spread(w.tolist(), kind, rng.randrange(5)) + [0] * 9, np.int32)
        if not any(h[1] == n for h in index.hits(s, np.zeros(len(s), np.int64))):
            lost.append(len(w))
    assert len(lost) <= 2, lost
