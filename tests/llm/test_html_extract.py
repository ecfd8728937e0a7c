import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import html_extract as h
from mosaiq.llm.html_blocks import leaf_blocks
from mosaiq.llm.queries import op8_html_extraction


def test_blocks():
    page = "<!DOCTYPE html><head><title>t</title></head><body><p>A <b>b&amp;<br>c<p>two\n\n <a href='>'>link</a><ul><li>x<li>y</ul>tail<!-- <p>no --><script>'</p>'</script><div class=\"Ad box\">z</div></body>"
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["A b& c", "two link", "x", "y", "tail", "z"]
    assert blocks[1].link_chars == 4 and [b.depth for b in blocks] == [2, 2, 3, 3, 1, 2]
    again = [b for b in leaf_blocks('<body><div id="box" class=ad>z</div><div>z</div>')]
    assert (blocks[5].path == again[0].path).all() and (again[0].path != again[1].path).any()
    assert leaf_blocks("") == [] and leaf_blocks("</p></div>plain < text")[0].text == "plain < text" and leaf_blocks("<p>a<script>never ends")[0].text == "a"


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_text_that_is_not_shown():
    assert texts("<svg><text>s<p>one</p><noscript><p>no</p></noscript><p>two") == ["one", "two"]
    assert texts("<noscript>never ended<p>one") == ["one"] and texts("<template><p>no</p><p>no</p></template><p>one") == ["one"]
    assert texts("<svg><svg>a</svg>b</svg><p>one <svg/>two") == ["one two"] and texts("<svg><foreignObject><p>no</p></foreignObject></svg>yes") == ["yes"]
    assert texts("<style>p{}</style >a<textarea><p>no</textarea\n>b<script>x</script") == ["a", "b"] and texts("<!-- <p>no") == []
    assert texts("1 <2 and a <b or <c> d") == ["1 <2 and a <b or d"]


@pytest.mark.parametrize(
    "page",
    ["<a" * 100_000, "<div>" * 50_000 + "x", "<div>x" * 50_000, '<a "' * 50_000, "<a \"<a' \"" * 50_000, "<span>" * 50_000 + "<li>x" * 50_000, "<a><div></a>" * 30_000 + "x", "</script" * 50_000, "<script>" * 50_000, "<svg>" * 30_000 + "<p>x" * 30_000, "<!x" * 50_000 + ">", "</b>x" * 50_000],
)
def test_broken_pages_are_read_in_linear_time(page):
    at = time.process_time()
    blocks = leaf_blocks(page)
    assert time.process_time() - at < 10 and sum(len(b.text) for b in blocks) <= len(page)
    assert time.process_time() - at < 10 and np.isfinite(h.vectors(blocks)).all()


class Plain(HTMLParser):
    """Text of the article element by the standard library's parser, without the operator's code."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.out = False, [""]
        self.feed(page)
        self.close()
        self.text = "\n".join(t for t in (" ".join(x.split()) for x in self.out) if t)

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.out[-1] += " "
        elif tag not in ("b", "i", "em", "a", "span"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag not in ("b", "i", "em", "a", "span"):
            self.out.append("")

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_query_takes_articles(spark, sf_dir, size):
    at = sf_dir.replace("0.001", size)
    pages = {r.page_id: r for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    rows = op8_html_extraction(spark, at).collect()
    assert len(rows) == len(pages)
    right = 0
    for r in rows:
        right += r.text == Plain(pages[r.page_id].html).text
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert right >= 0.995 * len(rows)


def test_pages_by_hand():
    """Articles in containers that tell nothing, in none, with link lists, tables and comments; none of these pages is the generator's."""
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice("the storm moved east over hills and farms while people waited for news from town about roads".split()) for _ in range(40)) + "."
    a, b, c = prose(), prose(), prose()
    nav, foot = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul></nav>", "<footer>&copy; 2020 Example. All rights reserved.</footer>"
    main = f"<h1>Storm over the hills</h1><p>{a}</p><p>{b}</p><p>{c}</p>"
    expected = ["Storm over the hills", a, b, c]
    pages = {
        nav + f'<div class="wrap">{main}</div>' + foot: expected,
        nav + main + foot: expected,
        f'<div id="page"><div class="header"><div class="logo">Example News</div>{nav}</div><div class="container"><div class="row"><div class="col-8">{main}</div><div class="sidebar"><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></div></div></div>{foot}</div>': expected,
        nav + f"<article><h1>Storm</h1><p>{a}</p><ul><li><a href=a>A map of the roads that are closed</a></li><li><a href=b>Where to find help</a></li></ul><p>{b}</p></article>" + foot: ["Storm", a, "A map of the roads that are closed", "Where to find help", b],
        nav + f"<main><h1>Rain</h1><p>{a}</p><table><tr><th>Town</th><th>Rain</th></tr><tr><td>North</td><td>12 mm</td></tr></table><p>{b}</p></main>" + foot: ["Rain", a, "Town", "Rain", "North", "12 mm", b],
        nav + f'<article><h1>Storm</h1><p>{a}</p><p>{b}</p><section class="comments"><div>Ann says: great report, thanks a lot</div><div>Bob says: I was there, it was wet.</div></section></article>' + foot: ["Storm", a, b],
        '<div class="cookie-notice">We use cookies. Accept all?</div>' + nav + f'<div class="main-content"><h1>Storm</h1><p>{a}</p><div class="ad">Buy cheap umbrellas now</div><p>{b}</p></div><form><label>Email</label><button>Subscribe</button></form>' + foot: ["Storm", a, b],
    }
    model = h.Labeller(list(h.trained()))
    for page, parts in pages.items():
        blocks = leaf_blocks(f"<html><head><title>t</title></head><body>{page}</body></html>")
        assert [x.text for x, is_main in zip(blocks, h.labelled([blocks], model)[0]) if is_main] == parts, page


def test_unseen_pages_of_many_spellings():
    model, rng, wrong, n = h.Labeller(list(h.trained())), random.Random(99), 0, 0
    for _ in range(150):
        html, labels = h.training_page(rng)
        wrong += (h.labelled([leaf_blocks(html)], model)[0] != np.array(labels)).sum()
        n += len(labels)
    assert wrong < 0.03 * n


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = h.Labeller.fresh(rng)
    model = h.Labeller([p.astype(np.float64) for p in model.parameters])
    x, mask = rng.normal(0, 1, (2, 5, h.DIMS)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    y = rng.integers(0, 2, (2, 5)).astype(float)

    def loss():
        p = model.probabilities(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for p, g in zip(model.parameters, model.gradients(x, mask, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-2
        up = loss()
        p[at] -= 2e-2
        down = loss()
        p[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.03 * abs(g[at]) + 1e-4


def test_odd_rows(spark):
    pages = [None, "", "no tags at all", "<nav><ul><li><a href=x>only</a></li></ul></nav>", "<article>" + "<p>word one two three.</p>" * 5000 + "</article>", "<article><p>same</p></article>", "<article><p>same</p></article>"]
    df = spark.createDataFrame([(None if k == 1 else k, p, "x") for k, p in enumerate(pages)], "page_id long, html string, text string")
    rows = df.select("html", h.main_text(F.col("html")).alias("t")).collect()
    got = {r.html: r.t for r in rows}
    assert len(rows) == 7 and got[None] == "" and got[""] == "" and got[pages[4]].count("\n") == 4999 and got[pages[5]] == "same"
    assert df.where("false").select(h.main_text(F.col("html"))).count() == 0
