"""The chain against enumeration, and pages of a generator that the training never sees."""

import itertools
import random

import numpy as np
import pytest

from titrelake.llm import html


@pytest.fixture(scope="module")
def chain():
    return html.train()


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_and_marginals_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 5, 9):
        e, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {y: sum(e[i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        assert tuple(html.Chain(moves=moves.tolist()).decode(e.tolist())) == max(weight, key=weight.get)
        z = sum(np.exp(w) for w in weight.values())
        p, pairs = html._marginals(e, moves)
        assert np.allclose(p, [sum(np.exp(w) for y, w in weight.items() if y[i]) / z for i in range(n)])
        want = np.zeros((2, 2))
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += np.exp(w) / z
        assert np.allclose(pairs, want)


def test_fit_follows_the_likelihood():
    """Weights where the gradient of the likelihood is near zero: expected and seen features agree."""
    pages = [([["bias", "x"], ["bias"], ["bias", "x"]], [1, 0, 1]), ([["bias"], ["bias", "x"]], [0, 1]), ([["bias", "x"]], [0]), ([["bias"]], [1])]
    c = html.fit(pages * 20, epochs=60)
    for f in ("bias", "x"):
        gap = 0.0
        for page, y in pages:
            p, _ = html._marginals(np.array([sum(c.weights[g] for g in fs) for fs in page]), np.array(c.moves))
            gap += sum(a - b for fs, a, b in zip(page, y, p) if f in fs)
        assert abs(gap) < 0.3


def other_page(rng):
    """A page in a layout and vocabulary of its own: plain English words, nested wrappers, utility classes."""
    vocab = "river stone light winter market engine garden paper north signal copper train forest table winter bridge letter music road harbour field glass".split()
    line = lambda a, b: " ".join(rng.choice(vocab) for _ in range(rng.randint(a, b))).capitalize() + "."
    para = lambda: " ".join(line(6, 18) for _ in range(rng.randint(2, 6)))
    kept, body = [], []
    head = line(3, 8)[:-1]
    kept.append(head)
    body.append(f'<div class="u-mb-4"><h1 class="text-3xl font-bold">{head}</h1></div>')
    for _ in range(rng.randint(3, 9)):
        p = para()
        kind = rng.random()
        if kind < 0.7:
            kept.append(p)
            body.append(f'<p class="leading-7">{p}</p>')
        elif kind < 0.85:
            items = [line(3, 9) for _ in range(3)]
            kept += items
            body.append("<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>")
        else:
            body.append(f'<div class="ad-slot" id="ad-{rng.randint(1, 9)}"><span>Advertisement</span><p>{line(4, 9)}</p></div>')
    links = "".join(f'<li><a href="/{w}">{w.capitalize()}</a></li>' for w in rng.sample(vocab, 5))
    notice = f'<div id="cookie-consent" role="dialog"><p>We use cookies to improve this site. {line(4, 9)}</p><button>Accept</button></div>'
    replies = "".join(f'<div class="comment"><b>{w}</b><p>{line(5, 14)}</p></div>' for w in rng.sample(vocab, 2))
    page = (
        f"<html lang=en><head><title>{head} - Site</title><link rel=stylesheet href=x.css></head><body class=antialiased>"
        f'{notice if rng.random() < 0.5 else ""}<header class="site-header"><a href="/">The Daily Site</a><nav><ul>{links}</ul></nav></header>'
        f'<div class="container grid"><main id="content"><article itemscope>{"".join(body)}</article><section id="comments"><h3>Comments</h3>{replies}</section></main>'
        f'<aside class="sidebar"><h4>Related</h4><ul>{links}</ul></aside></div><footer class="site-footer"><p>Copyright 2024 The Daily Site. All rights reserved.</p></footer></body></html>'
    )
    return page, " ".join(kept)


def test_pages_of_another_generator(chain):
    rng = random.Random(12)
    good = 0
    for _ in range(100):
        page, article = other_page(rng)
        got, want = set(html.main_text(page, chain).split(". ")), set(article.split(". "))
        good += len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert good >= 90


def test_whole_blocks_count(chain):
    """What tells a block may stand anywhere in it, and a long article may use such words."""
    calm = "The old bridge was built of stone and the road went on to the north. " * 20
    late = html.Block("x " * 400 + "subscribe newsletter sign up " * 40, frozenset(), 0.0)
    assert "says-ask" in html.text_features(late) and "says-ask" not in html.text_features(html.Block(calm + "They share a comment.", frozenset(), 0.0))
    words = "a" * 500 + " sidebar"
    assert any(".side" in b.place for b in html.blocks(f'<div class="{words}">x</div>'))
    page = f"<nav><a href=x>Menu</a></nav><article><p>{calm}They share a cookie.</p></article><footer>&copy; x</footer>"
    assert html.main_text(page, chain) == " ".join((calm + "They share a cookie.").split())
