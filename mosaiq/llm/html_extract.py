"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_blocks``). Each block becomes a vector:
its tag path (names, classes, ids) and its words, both hashed with signs, and a few
shares. A bidirectional LSTM in numpy reads the whole sequence, so each block is
classified in the light of all others; blocks labelled as main text are joined.

The model is trained here, on pages made by rule: menus, headers, notices, adverts,
forms, sidebars, comments and footers around and inside articles, with many spellings
of tags and classes and random words, so it learns markup and shapes rather than a
vocabulary. Seeds are fixed; the weights (some 20,000 numbers) go to tasks as they are.

Tags may be unclosed or crossed (``html_blocks`` says how they are read).
Null or empty html, and pages without main text, give an empty text. Nothing is cut
or dropped by length: a page of any number of blocks is read as one sequence.
Repeated rows are read alike; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.llm.html_blocks import PATH_DIMS, Block, leaf_blocks, slot

WORD_DIMS, SHARES = 24, 8
#: Numbers of a path's vector count up to this; more happens in pages with many unclosed tags.
MOST_MARKS = 4
DIGIT = re.compile(r"\d")
DIMS, HIDDEN = PATH_DIMS + WORD_DIMS + SHARES, 24
PAGES, BATCH, EPOCHS, RATE = 2400, 24, 8, 0.025
#: Probability from which a block is main text: leaving out a paragraph is worse than taking in a line.
CHOSEN = 0.3
#: Pages labelled together, and the most blocks (padding counted) of such a batch.
SLICE, CELLS = 128, 60_000


#: Slots of words seen by this worker; started over when there are many.
_WORDS: dict[str, tuple[int, float]] = {}
MOST_WORDS = 200_000


def vectors(blocks: list[Block]) -> np.ndarray:
    """``(blocks, DIMS)`` inputs of a page."""
    x = np.zeros((len(blocks), DIMS), np.float32)
    if len(_WORDS) > MOST_WORDS:
        _WORDS.clear()
    for k, b in enumerate(blocks):
        words, sums, n = b.text.lower().split(), [0.0] * WORD_DIMS, len(b.text)
        for w in words:
            place = _WORDS.get(w)
            if place is None:
                place = _WORDS[w] = slot(w.strip(".,;:!?()"), WORD_DIMS)
            sums[place[0]] += place[1]
        x[k, :PATH_DIMS] = np.clip(b.path, -MOST_MARKS, MOST_MARKS)
        x[k, PATH_DIMS:-SHARES] = sums
        x[k, PATH_DIMS:-SHARES] /= len(words)
        x[k, -SHARES:] = (
            np.log1p(len(words)) / 4, b.link_chars / n, sum(map(b.text.count, ".!?")) / len(words), len(DIGIT.findall(b.text)) / n,
            float("©" in b.text), min(b.depth, 50) / 10, k / len(blocks), 1.0,
        )
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """The bidirectional LSTM over ``(pages, steps, DIMS)``. Both directions run as one, stacked on the first axis."""

    def __init__(self, parameters: list[np.ndarray]):
        self.parameters = parameters

    @staticmethod
    def fresh(rng: np.random.Generator) -> "Labeller":
        b = np.zeros((2, 1, 1, 4 * HIDDEN))
        b[..., HIDDEN : 2 * HIDDEN] = 1  # what is remembered at first
        made = [rng.normal(0, 0.15, (2, 1, DIMS, 4 * HIDDEN)), rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)), b, rng.normal(0, 0.2, (2, HIDDEN, 1)), np.zeros(1)]
        return Labeller([p.astype(np.float32) for p in made])

    @staticmethod
    def _both(x: np.ndarray) -> np.ndarray:
        return np.stack([x, x[:, ::-1]])

    def _states(self, x: np.ndarray, mask: np.ndarray, keep: bool) -> np.ndarray:
        """``(2, pages, steps, HIDDEN)``, the second read backwards; masked steps leave a state as it is."""
        w, u, b = self.parameters[:3]
        inputs, masks = x @ w + b, self._both(mask)[..., None]
        h = c = np.zeros((2, x.shape[1], HIDDEN), np.float32)
        hs, self.kept = np.zeros((*inputs.shape[:3], HIDDEN), np.float32), []
        for t in range(x.shape[2]):
            z = inputs[:, :, t] + h @ u
            gates, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            m = masks[:, :, t]
            fresh = f * c + i * g
            squashed = np.tanh(fresh)
            if keep:
                self.kept.append((i, f, o, g, c, h, squashed, m))
            c, h = np.where(m, fresh, c), np.where(m, o * squashed, h)
            hs[:, :, t] = h
        return hs

    def probabilities(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        self.x = self._both(x)
        self.hs = self._states(self.x, mask, keep)
        told = (self.hs @ self.parameters[3][:, None])[..., 0]
        return _sigmoid(told[0] + told[1][:, ::-1] + self.parameters[4])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        error = ((self.probabilities(x, mask, True) - y) * mask / mask.sum()).astype(np.float32)
        errors, u = self._both(error)[..., None], self.parameters[1]
        d_hs = errors * self.parameters[3][:, None].swapaxes(-1, -2)
        du, dh, dc = np.zeros_like(u), np.zeros((2, len(x), HIDDEN), np.float32), np.zeros((2, len(x), HIDDEN), np.float32)
        dz_all = np.zeros((*self.hs.shape[:3], 4 * HIDDEN), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, c, h, squashed, m = self.kept[t]
            dh = dh + d_hs[:, :, t]
            d_out = dh * m
            d_cell = dc * m + d_out * o * (1 - squashed**2)
            dz_all[:, :, t] = dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), d_out * squashed * o * (1 - o), d_cell * i * (1 - g**2)], axis=2)
            du += h.swapaxes(-1, -2) @ dz
            dh, dc = dh * ~m + dz @ u.swapaxes(-1, -2), dc * ~m + d_cell * f
        flat = dz_all.reshape(2, -1, 4 * HIDDEN)
        dw = self.x.reshape(2, -1, DIMS).swapaxes(-1, -2) @ flat
        dv = self.hs.reshape(2, -1, HIDDEN).swapaxes(-1, -2) @ errors.reshape(2, -1, 1)
        return [dw[:, None], du, flat.sum(1)[:, None, None], dv, error.sum(keepdims=True)[0]]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, DIMS), np.float32), np.zeros((len(pages), steps), bool)
    for k, page in enumerate(pages):
        x[k, : len(page)], mask[k, : len(page)] = page, True
    return x, mask


# Spellings of the parts of pages that training pages are made of.
MAIN = ("article", "main", 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'div id="main"', 'div class="story text"', "main|article", 'div class="page"|article', 'section class="body"|div class="post-content"')
MENUS = ("nav|ul", 'ul class="menu"', 'div class="navbar"|ul', 'div id="nav"|ul', 'div class="topbar menu"|ul', "header|nav|ul", 'div class="breadcrumbs"|ul', 'ul role="navigation"', 'div class="links"|ul')
HEADERS = ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header top"', 'div role="banner"')
NOTICES = ('div class="cookie-banner"', 'div class="notice"', 'div id="consent"', 'div class="alert popup"', 'div class="modal overlay"', 'section class="cookies"', 'div role="alert"', 'div class="subscribe"', "dialog")
ADVERTS = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="banner-ad"', 'div class="sponsored"', 'section class="promo"', 'aside class="ad"', 'div class="advertisement"')
SIDEBARS = ("aside", 'div class="sidebar"', 'aside class="widget"', 'div id="sidebar"', 'div class="related"', 'section class="related-posts"', 'div class="share social"', 'div class="widget recent"', 'div class="tags"')
COMMENTS = ('section id="comments"', 'div class="comments"', 'div id="disqus" class="comment-list"', 'section class="replies discussion"', 'ol class="comment-list"', 'div class="reader-comments"')
FOOTERS = ("footer", 'div class="footer"', 'div id="footer"', 'div class="copyright legal"', 'div role="contentinfo"', 'div class="bottom site-info"')
NEUTRAL = ("wrap", "container", "row", "col", "inner", "page", "site", "layout", "grid", "wrapper", "box", "outer", "holder", "app", "root", "")
CUES = {"notice": "cookie cookies accept privacy policy consent subscribe newsletter", "advert": "buy offer sale sponsored advertisement shop", "comment": "reply says likes report thanks ago", "footer": "copyright rights reserved contact terms", "form": "search name email submit send sign"}


def training_page(rng: random.Random) -> tuple[str, list[int]]:
    """An invented page and the labels of its blocks in order (1: main text)."""
    labels: list[int] = []
    alphabet = rng.choice(("thernontisuldmagc", "éèleauxontreimdsp", "schungeitbodrkäüß", "ciónasdelmosrgueñ", "приветмондлас", "abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9)))

    def prose(a: int, b: int, cue: str = "") -> str:
        out = [word() for _ in range(rng.randint(a, b))]
        for w in CUES.get(cue, "").split():
            if rng.random() < 0.25:
                out.insert(rng.randrange(len(out) + 1), w)
        if rng.random() < 0.1:
            out = [w + rng.choice(("###", "$$$", "&amp;&amp;", "!!")) for w in out]
        out[0] = out[0].capitalize()
        marks = [w + rng.choice((".", ",", "")) if rng.random() < 0.2 else w for w in out]
        return " ".join(marks) + rng.choice((".", ".", ""))

    def block(tag: str, text: str, label: int) -> str:
        labels.append(label)
        if rng.random() < 0.15:
            text = f"<{(t := rng.choice(('b', 'em', 'strong', 'span')))}>{text}" + (f"</{t}>" if rng.random() < 0.7 else "<br>")
        return f"<{tag}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag.split()[0]}>")

    def inside(spec: str, body: str) -> str:
        for part in reversed(spec.split("|")):
            body = f"<{part}>{body}</{part.split()[0]}>"
        return body

    def menu() -> str:
        return inside(rng.choice(MENUS), "".join(block("li", f'<a href="/{word()}">{prose(1, 2)}</a>', 0) for _ in range(rng.randint(2, 9))))

    def box(specs: tuple, cue: str, a: int = 3, b: int = 18, most: int = 3) -> str:
        spec = rng.choice(specs)
        if rng.random() < 0.6:
            labels.append(0)
            return inside(spec, prose(a, b, cue))
        tags = ("p", "p", "div", "h3", "li") if "ol " not in spec else ("li",)
        return inside(spec, "".join(block(rng.choice(tags), prose(a, b, cue), 0) for _ in range(rng.randint(1, most))))

    def form() -> str:
        labels.extend([0, 0])
        return inside(rng.choice(("form", 'form class="search"', 'div class="contact"|form')), f"<label>{prose(1, 3, 'form')}</label><input type=text><button>{prose(1, 2, 'form')}</button>")

    def footer() -> str:
        labels.append(0)
        return inside(rng.choice(FOOTERS), ("&copy; " if rng.random() < 0.6 else "") + word() + ".example.com &middot; " + prose(2, 14, "footer"))

    def neutral() -> str:
        """A container that tells nothing: of a usual name, an invented one, or none."""
        name = rng.choice((rng.choice(NEUTRAL), word()))
        return rng.choice(("div", "div", "div", "section", "center")) + (f' {rng.choice(("class", "class", "id"))}="{name}"' if name else "")

    def links(tag: str, most: int) -> str:
        """A list of links inside an article."""
        items = [block("li", f'<a href="/{word()}">{prose(1, 9)}</a>' + (" " + prose(1, 12) if rng.random() < 0.3 else ""), 1) for _ in range(rng.randint(2, most))]
        return f"<{tag}>{''.join(items)}</{tag}>"

    def table() -> str:
        rows = range(rng.randint(1, 5))
        return "<table>" + "".join("<tr>" + "".join(block(rng.choice(("td", "td", "th")), prose(1, 6), 1) for _ in range(rng.randint(2, 3))) + "</tr>" for _ in rows) + "</table>"

    def article() -> str:
        out = [block(rng.choice(("h1", "h1", "h2")), prose(3, 16), 1)] if rng.random() < 0.9 else []
        if out and rng.random() < 0.15:
            out[0] = f"<header>{out[0]}{block('p', prose(2, 12), 1) if rng.random() < 0.5 else ''}</header>"
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 14, 25))):
            kind = rng.random()
            if kind < 0.64:
                text = prose(1, 90 if rng.random() < 0.75 else 5)
                if rng.random() < 0.12:
                    text += f' <a href="/{word()}">{prose(1, 8)}</a>'
                out.append(block("p", text, 1))
            elif kind < 0.7:
                out.append(block(rng.choice(("h2", "h3", "h4")), prose(1, 8), 1))
            elif kind < 0.76:
                out.append("<ul>" + "".join(block("li", prose(1, 16), 1) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.8:
                out.append(links(rng.choice(("ul", "ol")), 7))
            elif kind < 0.85:
                out.append(block(rng.choice(("blockquote", "pre", "figcaption", "dd", "dt")), prose(3, 40), 1))
            elif kind < 0.88:
                out.append(table())
            elif kind < 0.92:
                out.append(box(ADVERTS, "advert"))
            elif kind < 0.94:
                out.append(box(SIDEBARS, ""))
            else:
                out.append(block("div", prose(10, 60), 1))
        if rng.random() < 0.12:
            out.append(box(COMMENTS, "comment", 2, 40, 6))
        body = "".join(out)
        place = rng.random()
        if place < 0.62:
            body = inside(rng.choice(MAIN[:1] * 8 + MAIN), body)
        if place > 0.45:
            for _ in range(rng.randint(place < 0.95, 3)):
                body = inside(neutral(), body)
        return body

    title = prose(3, 10)
    before = [part for part, chance in ((menu, 0.85), (lambda: box(HEADERS, "", 1, 8), 0.4), (lambda: box(NOTICES, "notice"), 0.3), (lambda: box(ADVERTS, "advert"), 0.6), (form, 0.2), (lambda: box(SIDEBARS, ""), 0.2)) if rng.random() < chance]
    after = [part for part, chance in ((lambda: box(COMMENTS, "comment", 2, 40, 8), 0.4), (lambda: box(SIDEBARS, "", 2, 12, 6), 0.4), (form, 0.2), (lambda: box(ADVERTS, "advert"), 0.3), (lambda: box(NOTICES, "notice"), 0.2), (menu, 0.2)) if rng.random() < chance]
    rng.shuffle(before)
    rng.shuffle(after)
    ends = [footer] if rng.random() < 0.85 else []
    boxed = lambda html: inside(neutral(), html) if rng.random() < 0.12 else html
    body = "".join(boxed(part()) if part is not article else part() for part in [*before, article, *after, *ends])
    for _ in range(rng.choice((0, 0, 1, 2))):
        body = inside(neutral(), body)
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>", labels


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, ...]:
    """The model's parameters, by Adam on the training pages."""
    rng, made = random.Random(11), []
    for _ in range(PAGES):
        html, labels = training_page(rng)
        blocks = leaf_blocks(html)
        if len(blocks) != len(labels):
            raise AssertionError("labels and blocks of a training page differ")
        made.append((vectors(blocks), np.array(labels, np.float32)))
    made.sort(key=lambda page: len(page[1]))
    batches = [made[k : k + BATCH] for k in range(0, PAGES, BATCH)]
    order = np.random.default_rng(5)
    model = Labeller.fresh(order)
    first, second, step = [np.zeros_like(p) for p in model.parameters], [np.zeros_like(p) for p in model.parameters], 0
    for epoch in range(EPOCHS):
        for k in order.permutation(len(batches)):
            x, mask = padded([page for page, _ in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for row, (_, labels) in enumerate(batches[k]):
                y[row, : len(labels)] = labels
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, m, v, g in zip(model.parameters, first, second, model.gradients(x, mask, y)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(model.parameters)


def labelled(pages: list[list[Block]], model: Labeller) -> list[np.ndarray]:
    """Which blocks of each page are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order, at = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= CELLS:
            end += 1
        x, mask = padded([vectors(pages[k]) for k in order[at:end]])
        for k, p in zip(order[at:end], model.probabilities(x, mask)):
            out[k] = p[: len(pages[k])] > CHOSEN
        at = end
    return out


def main_text(html: Column) -> Column:
    """The main text of a string column of pages, its blocks joined by newlines."""
    parameters = [np.array(p) for p in trained()]

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Labeller(parameters)
        for part in parts:
            texts = []
            for at in range(0, len(part), SLICE):
                pages = [leaf_blocks(p or "") for p in part[at : at + SLICE]]
                texts += ["\n".join(b.text for b, is_main in zip(page, mains) if is_main) for page, mains in zip(pages, labelled(pages, model))]
            yield pd.Series(texts, dtype=object)

    return extract(html)
