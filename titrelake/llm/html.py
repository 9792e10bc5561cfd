"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

Blocks are runs of text between block-level tags. Their features are the tags and class words of their ancestors
and properties of the text; the chain learns from labelled pages that `labelled_page` writes from many templates
(fixed seed, invented words), by gradient steps on the likelihood. Viterbi decoding picks the article's blocks.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the HTML standard by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup svg time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text to the end tag or the page's end; of xmp it is shown.
RAW = "script|style|textarea|iframe"
#: Left out with all that is in them, if they have an end tag.
HOLDERS = ("noscript", "template", "svg", "select")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKED = frozenset("nav header footer aside article main section form ul ol table figure figcaption head title blockquote pre button fieldset dialog menu address details h1 h2 h3 h4 h5 h6 li td p div body a".split())
MARKS = {t: ("<" + t,) for t in MARKED}
#: Words in class, id or role attributes, by what they tell.
FAMILIES = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner doubleclick taboola outbrain affiliate",
    "nav": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toc topbar tabs skip links",
    "comment": "comment comments reply replies respond disqus discussion feedback reviews thread",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer privacy toast",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular share sharing social tags tagcloud complementary rail meta more teaser promobox",
    "foot": "footer foot copyright colophon contentinfo legal bottom",
    "head": "header masthead logo branding hero site top",
    "form": "form search login register contact",
    "main": "article articles post entry content story body main text maintext prose page",
}
FAMILY = {w: k for k, ws in FAMILIES.items() for w in ws.split()}
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<xmp\b[^>]*>(?P<xmp>.*?)(?:</xmp\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
HELD = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW}|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>{'|'.join(HOLDERS)})(?![^\s/>])(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role|data-testid|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Words that speak of what surrounds an article, counted in the whole block.
TELLS = {
    "copyright": ("©", "all rights reserved", "copyright"),
    "cookie": ("cookie", "consent", "privacy"),
    "ask": ("subscribe", "sign up", "log in", "newsletter", "share", "follow us", "advert", "sponsored", "read more", "click here"),
    "reply": ("reply", "comment", " says:", " wrote:"),
}


@dataclass
class Block:
    """A leaf block: its text with spaces squeezed, and the features of its place."""

    text: str
    place: frozenset[str]
    link_share: float


def _place_words(tag: str, attrs: str) -> tuple[str, ...]:
    out = ["<" + tag] if tag in MARKED else []
    if attrs and "=" in attrs:
        for m in NAMES.finditer(attrs):
            value = m[1] or m[2] or m[3] or ""
            for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                if w in FAMILY:
                    out.append("." + FAMILY[w])
        if HIDDEN.search(attrs):
            out.append(".hidden")
    return tuple(out)


def _held(html: str) -> dict[int, int]:
    """Where the elements of HOLDERS start and end; without those that have no end tag or are closed in themselves."""
    out, opened = {}, {t: [] for t in HOLDERS}
    for m in HELD.finditer(html):
        if not m["tag"]:
            continue
        starts = opened[m["tag"].lower()]
        if not m["end"]:
            if m["tag"].lower() != "svg" or not m["attrs"].endswith("/"):
                starts.append(m.start())
        elif starts:
            out[starts.pop()] = m.end()
    return out


def blocks(html: str | None, known: dict | None = None) -> list[Block]:
    """The leaf blocks of a page in order; broken markup is read as browsers do, near enough: unclosed elements end
    with an ancestor, stray end tags are ignored, an unclosed comment or script runs to the end, an unclosed svg does not.
    known: a memo of places, kept from page to page."""
    html, out = html or "", []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    in_link = False
    at = 0
    known = {} if known is None else known

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            joined = " ".join((unescape(joined) if "&" in joined else joined).split())
            if joined:
                path = tuple([ws for _, ws in stack if ws])
                parent = next((t for t, _ in reversed(stack) if t not in INLINE), "")
                place = known.get((parent, path))
                if place is None:
                    if len(known) > 20_000:
                        known.clear()
                    place = known[parent, path] = frozenset(w for ws in path for w in ws) | {"^" + (parent if parent in MARKED else "other")}
                out.append(Block(joined, place, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    held = None
    for m in iter(lambda: TOKEN.search(html, at), None):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            linked += len(piece) if in_link else 0
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["xmp"]:
                flush()
                text.append(m["xmp"].replace("&", "&amp;"))
                linked += len(m["xmp"]) if in_link else 0
                flush()
            continue
        tag = tag.lower()
        closing = m["end"] or m["end2"]
        if tag in HOLDERS and not closing:
            held = _held(html) if held is None else held
            if m.start() in held:
                at = held[m.start()]
                continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
        elif tag not in VOID:
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag in CLOSES_P or tag in SAME:
                ends = {"p"} if tag in CLOSES_P else SAME[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if not attrs.endswith("/") or tag not in INLINE:
                stack.append((tag, _place_words(tag, attrs) if attrs else MARKS.get(tag, ())))
        if tag == "a" or in_link:
            in_link = any(t == "a" for t, _ in stack)
    if at < len(html):
        text.append(html[at:])
    flush()
    return out


def place_features(place: frozenset[str]) -> list[str]:
    """Features that a block's ancestors give."""
    inner = ["inside" + w for w in place if w[0] == "."] + ["in-body"] if "<article" in place or "<main" in place else []
    return ["bias", *place, *inner]


def text_features(b: Block) -> list[str]:
    """Features of a block's text."""
    low, words = b.text.lower(), b.text.count(" ") + 1
    f = [f"words{min(6, words.bit_length())}", f"links{int(b.link_share * 3.999)}", "stop" if b.text[-1] in ".!?…\"”" else "no-stop"]
    for k, told in TELLS.items():  # one such word in a long block tells little
        n = sum(low.count(w) for w in told if w in low)
        if n:
            f.append(f"says-{k}" if 40 * n >= words else f"mentions-{k}")
    return f


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    return [place_features(b.place) + text_features(b) for b in page]


@dataclass
class Chain:
    """Weights of features for `article`, and of the four transitions (from, to)."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def emissions(self, page: list[Block], known: dict | None = None) -> list[float]:
        """Weight of `article` for each block; known: a memo of the weights of places."""
        get, out = self.weights.get, []
        known = {} if known is None else known
        for b in page:
            place = known.get(b.place)
            if place is None:
                if len(known) > 20_000:
                    known.clear()
                place = known[b.place] = sum(get(f, 0.0) for f in sorted(place_features(b.place)))
            out.append(place + sum(get(f, 0.0) for f in text_features(b)))
        return out

    def decode(self, e: list[float]) -> list[int]:
        """The likeliest labels given the blocks' weights (Viterbi); ties to `not article`."""
        if not e:
            return []
        (a, b), (c, d) = self.moves
        s0, s1, back = 0.0, e[0], []
        for x in e[1:]:
            f0, f1 = s1 + c > s0 + a, s1 + d > s0 + b
            back.append((f0, f1))
            s0, s1 = (s1 + c if f0 else s0 + a), (s1 + d if f1 else s0 + b) + x
        out = [int(s1 > s0)]
        for f0, f1 in reversed(back):
            out.append(int(f1 if out[-1] else f0))
        return out[::-1]


def _marginals(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of `article` for each block, and expected counts of the transitions (forward-backward)."""
    n = len(e)
    emit = np.column_stack([np.zeros(n), e])
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = emit[0]
    for i in range(1, n):
        a[i] = np.logaddexp.reduce(a[i - 1][:, None] + moves, axis=0) + emit[i]
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp.reduce(moves + emit[i + 1] + b[i + 1], axis=1)
    z = np.logaddexp.reduce(a[-1])
    pairs = np.exp(a[:-1, :, None] + moves + (emit[1:] + b[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return np.exp(a[:, 1] + b[:, 1] - z), pairs


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 5, rate: float = 0.5, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by AdaGrad steps, page after page."""
    names = sorted({f for page, _ in pages for fs in page for f in fs})
    at = {f: i for i, f in enumerate(names)}
    w, g2, moves, m2 = np.zeros(len(names)), np.full(len(names), 1e-2), np.zeros((2, 2)), np.full((2, 2), 1e-2)
    coded = [([np.array([at[f] for f in fs]) for fs in page], np.array(y)) for page, y in pages if page]
    for _ in range(epochs):
        for page, y in coded:
            p, pairs = _marginals(np.array([w[fs].sum() for fs in page]), moves)
            grad = np.zeros(len(names))
            for fs, d in zip(page, y - p):
                grad[fs] += d
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            on = np.flatnonzero(grad)
            g2[on] += grad[on] ** 2
            w[on] += rate * (grad[on] - decay * w[on]) / np.sqrt(g2[on])
            m2 += (seen - pairs) ** 2
            moves += rate * (seen - pairs) / np.sqrt(m2)
    return Chain({f: float(x) for f, x in zip(names, w)}, moves.tolist())


def labelled_page(rng: random.Random) -> tuple[str, str]:
    """A page and its article text, from random templates: where the article is, what surrounds and interrupts it."""
    syllables = "ba con del es fir gor han il jun ka lor men nis ol per qua ri su ten ur vo wen".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda lo, hi: (" ".join(word() for _ in range(rng.randint(lo, hi)))).capitalize() + rng.choice([".", ".", ".", "", "!!"])
    para = lambda: " ".join(sentence(1, 14) for _ in range(rng.randint(1, 6)))
    link = lambda: f'<a href="/{word()}">{rng.choice([word(), word() + " " + word(), word().capitalize()])}</a>'
    pick, some = rng.choice, lambda p: rng.random() < p
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"
    named = lambda names: f'{pick(["class", "class", "id"])}="{pick(names.split())}{pick(["", "", "-box", " clearfix", "-1"])}"'
    ad = lambda: pick([f'<div {named(FAMILIES["ad"])}>{para()}</div>', f'<aside {named(FAMILIES["ad"])}><p>{para()}</p></aside>', f'<!-- {word()} --><div class="ad">{sentence(3, 12)}</div>'])
    notice = lambda: pick([f'<div {named(FAMILIES["notice"])}><p>{para()}</p><button>{word()}</button></div>', f'<div role="alert">{para()}</div>', f'<dialog><p>We use cookies. {para()}</p></dialog>', f'<section {named(FAMILIES["notice"])}>{para()}</section>'])
    side = lambda: pick([f"<aside><h3>{sentence(1, 4)}</h3>{pick([menu(), '<p>' + para() + '</p>'])}</aside>", f'<div {named(FAMILIES["side"])}><h4>{sentence(1, 3)}</h4>{menu()}<p>{para()}</p></div>', f'<aside {named(FAMILIES["side"])}><p>{para()}</p></aside>'])
    form = lambda: f'<form action="/{word()}"><label>{word()}</label><input name="q"><p>{sentence(2, 9)}</p><button>{word()}</button></form>'

    def comments() -> str:
        each = lambda: pick([f"<p><b>{word()}</b> {pick(['says:', 'wrote:', ''])} {para()}</p>", f'<li><div {named(FAMILIES["comment"])}><p>{para()}</p></div></li>', f"<article><p>{para()}</p></article>", f'<div class="comment">{para()}</div>'])
        return pick([f'<section {named(FAMILIES["comment"])}><h3>{pick(["Comments", "Replies", word()])}</h3>{"".join(each() for _ in range(rng.randint(1, 5)))}</section>', f'<div {named(FAMILIES["comment"])}><ul>{"".join(each() for _ in range(rng.randint(1, 4)))}</ul></div>'])

    head = pick(["", f"<header>{pick([menu(), sentence(2, 8), '<h1>' + word() + '</h1><p>' + sentence(3, 9) + '</p>'])}</header>", f'<div {named(FAMILIES["head"])}><p>{sentence(2, 8)}</p></div>'])
    nav = pick([f"<nav>{menu()}</nav>", f'<div {named(FAMILIES["nav"])}>{menu()}</div>', f'<ul class="menu"><li>{link()}</li><li>{link()}</li></ul>'])
    foot = pick([f"<footer>&copy; {word()}.example &middot; {para()}</footer>", f'<div {named(FAMILIES["foot"])}><p>{para()}</p>{menu()}</div>', f"<footer><p>{para()}</p>{menu()}</footer>", ""])
    title, parts, kept = sentence(3, 12), [], []

    def body(text: str, form_: str) -> None:
        kept.append(text)
        parts.append(form_)

    if some(0.8):
        parts.append(pick(["<h1>{}</h1>", "<header><h1>{}</h1></header>", '<h1 class="title">{}</h1>', "<h2>{}</h2>"]).format(title))
        kept.append(title)
    for _ in range(rng.choice([1, 1, 2, rng.randint(1, 12), rng.randint(3, 12)])):
        t = pick([para(), para(), sentence(1, 3), para() + " " + para()])
        shape = rng.random()
        if shape < 0.55:
            body(t, pick(["<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p><em>{}</em></p>", '<p class="intro">{}</p>', "<div>{}</div>", "<div><p>{}</p></div>"]).format(t))
        elif shape < 0.65:
            body(t, f"<blockquote><p>{t}</p></blockquote>")
        elif shape < 0.75:
            items = [sentence(1, 12) for _ in range(rng.randint(2, 5))]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            kept.extend(items)
        elif shape < 0.82:
            body(t, f"<h2>{t}</h2>" if len(t) < 90 else f"<section><p>{t}</p></section>")
        elif shape < 0.9:
            w = word()
            body(f"{t} {w}", f'<p>{t} <a href="/{w}">{w}</a></p>')
        else:
            body(t, f"<table><tr><td>{t}</td></tr></table>" if some(0.5) else f"<pre>{t}</pre>")
        if some(0.12):
            parts.append(pick([ad, side, notice, form])())
    if some(0.2):
        parts.append(comments())
    inner = "".join(parts)
    text_class = pick(FAMILIES["main"].split())
    whole = pick([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f'<div class="{text_class}">{inner}</div>', f"<main>{inner}</main>", f'<div id="{text_class}"><article class="post">{inner}</article></div>', f'<section class="{text_class}">{inner}</section>', f'<div class="wrap"><div class="{text_class}">{inner}</div></div>'])
    before = [x() for x in (ad, notice, side, form) if some(0.25)]
    after = [x() for x in (ad, side, comments, notice, form) if some(0.25)]
    rng.shuffle(before)
    rng.shuffle(after)
    top = [head, nav] if some(0.7) else [nav, head]
    page = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(top)}{"".join(before)}{whole}{"".join(after)}{foot}</body></html>'
    return (page[: -len("</body></html>")] if some(0.2) else page), " ".join(" ".join(kept).split())


def align(found: list[Block], article: str) -> list[int] | None:
    """1 for each block of the article: the blocks whose texts, joined by one space, are the whole article; None if
    there are no such blocks. Of several ways the one with the latest blocks, as menus may hold an article's first word."""
    fits = lambda b, at: "<title" not in b.place and article.startswith(b.text, at) and article[at + len(b.text) :][:1] in ("", " ")
    spelt = [{0}]  # the lengths of the article that the blocks so far can spell
    for b in found:
        starts = [at + (at > 0) for at in spelt[-1]]
        spelt.append(spelt[-1] | {at + len(b.text) for at in starts if fits(b, at)})
    at, out = len(article), [0] * len(found)
    if at not in spelt[-1]:
        return None
    for i in range(len(found) - 1, -1, -1):
        start = at - len(found[i].text)
        before = max(0, start - 1)
        if before + (before > 0) == start and before in spelt[i] and fits(found[i], start):
            out[i], at = 1, before
    return out


def train(pages: int = 600, seed: int = 11) -> Chain:
    """Fit on `pages` labelled pages. Pages whose article is not made of whole blocks would teach nothing: left out."""
    rng, data = random.Random(seed), []
    for _ in range(pages):
        page, article = labelled_page(rng)
        found = blocks(page)
        labels = align(found, article)
        if labels is not None:
            data.append((features(found), labels))
    return fit(data)


def main_text(html: str | None, chain: Chain, places: dict | None = None, weights: dict | None = None) -> str:
    """The page's article; the two memos may be kept from page to page."""
    found = blocks(html, places)
    return " ".join(b.text for b, on in zip(found, chain.decode(chain.emissions(found, weights))) if on)


def extract(df: DataFrame, html: str = "html", chain: Chain | None = None) -> DataFrame:
    """df without the html column, with text (the main text; empty if none or null) and n_chars, its code points.

    Columns named text or n_chars are replaced. Any other columns are kept. Pages are read whole, however long; repeated
    rows are extracted once each; an empty table gives an empty result.
    """
    model = chain or train()

    @F.pandas_udf("string")
    def texts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, weights = {}, {}
        for pages in it:
            yield pd.Series([main_text(p, model, places, weights) for p in pages], dtype=object)

    keep = [c for c in df.columns if c.lower() not in ("text", "n_chars", html.lower())]
    out = df.select(*[F.col(f"`{c}`") for c in keep], texts(F.col(f"`{html}`")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def page_report(df: DataFrame) -> DataFrame:
    """The contract of op9."""
    return extract(df.select("page_id", "url", "html"))
