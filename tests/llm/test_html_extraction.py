from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest

from tidemark.llm import html_extraction as H
from tidemark.llm import page_generator as G
from tidemark.llm.block_labeller import Labeller, padded
from tidemark.llm.html_blocks import blocks, vectors


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><ul><li><a href="/a>b">A&amp;B</a><li>C</ul></nav>
    <p>one &lt;two&gt;<br>three  <b>four<p>five &eacute;&#33; 1 < 2<script>var t="</p>";</script> six</p>tail<table><tr><td>x<td>y</table><select><option>n</select></body>"""
    assert [b.text for b in blocks(page)] == ["A&B", "C", "one <two> three four", "five é! 1 < 2 six", "tail", "x", "y"]
    assert [b.links for b in blocks(page)][:2] == [7, 0]
    assert blocks(page)[3].path == ("html", "body", "p")
    assert [b.path[-1] for b in blocks('<DIV class="Side-Bar x" id=main>a</DIV>')] == ["div side bar x main"]
    for broken in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", '<a href="x', "a" * 100_000):
        blocks(broken)
    assert [b.text for b in blocks("plain")] == ["plain"]


def test_unclosed():
    """What no `>` follows is text; an unclosed comment or script takes the rest of the page."""
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<p>a<b <p") == ["a<b <p"]
    assert texts("<p>a<!-- b > c") == texts("<p>a<!-- b c") == texts("<p>a<script>b > c") == ["a"]
    assert texts("<p>a</p>b <!-- c") == ["a", "b"]
    assert texts("<p>a<script b") == ["a<script b"]


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<script " * 130_000, "<!-- " * 200_000, "<a '\">" * 150_000, "<div>x" * 100_000, "<x>" * 100_000 + "</y>" * 100_000, "<ul><li><ul>" + "<x>" * 50_000 + "<li></li>" * 50_000],
    ids=["open tags", "open scripts", "open comments", "odd quotes", "nested", "nothing to close", "deep lists"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    vectors(blocks(page))
    assert time.process_time() - began < 15  # the square would take hours


def test_gradients():
    rng = np.random.default_rng(0)
    model = Labeller(hidden=3, inputs=5)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = padded([rng.normal(size=(n, 5)) for n in (4, 2, 3)])
    y = (rng.random(mask.shape) < 0.5).astype(float)
    _, grads = model.gradients(x, mask, y)
    for name, w in model.w.items():
        flat, at = w.reshape(-1), rng.integers(w.size)
        old, e = flat[at], 1e-3
        flat[at] = old + e
        up = model.gradients(x, mask, y)[0]
        flat[at] = old - e
        down = model.gradients(x, mask, y)[0]
        flat[at] = old
        assert abs((up - down) / (2 * e) - grads[name].reshape(-1)[at]) < 2e-3, name


def test_padding_changes_nothing():
    model = Labeller(hidden=4, inputs=5)
    rng = np.random.default_rng(1)
    pages = [rng.normal(size=(n, 5)).astype(np.float32) for n in (1, 6, 3)]
    x, mask = padded(pages)
    for p, own in zip(model.probabilities(x, mask), pages):
        alone = model.probabilities(*padded([own]))[0]
        assert np.allclose(p[: len(own)], alone, atol=1e-5)


def test_held_out_pages(model):
    make = G.Pages(4242)
    right = total = 0
    for _ in range(150):
        x, y, _ = G.example(make.page())
        flags = model.label([x])[0]
        right, total = right + int((flags == (y > 0.5)).sum()), total + len(y)
    assert right / total > 0.98


def test_query(spark, sf_dir, model):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    exact = 0
    for r in H.op1_html_extraction(spark, sf_dir).collect():
        body = pages[r.page_id]
        body = body[body.index("<article>") : body.index("</article>")].replace("<b>", "").replace("<br>", " ")
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:article|h1|p)>", body)]
        exact += r.text == "\n\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)
    assert exact >= 0.98 * len(pages)


def test_edges(spark, model):
    text = "A long enough sentence, with several words in it, for an article."
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>{text}</p><p>{text}</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", page), (4, "u", "<nav>x</nav>"), (6, "u", "<div>x" * 20_000), (5, "u", page.replace("</p></article>", "</p>" + f"<p>{text}</p>" * 2000 + "</article>"))]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = sorted((tuple(r) for r in H.extract(frame, model).collect()), key=str)
    assert len(out) == len(rows)
    found = {r[0]: r for r in out}
    assert found[1][2:] == ("", 0) and found[2][2:] == ("", 0)
    assert found[3][2] == f"Title\n\n{text}\n\n{text}" == found[None][2]
    assert found[5][2].count(text) == 2002
    assert H.extract(frame.limit(0), model).collect() == []
