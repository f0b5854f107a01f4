"""Whole articles stay, whatever they hold and however they are framed; malformed pages are read in linear time."""

import time

import numpy as np
import pytest

from quillstone.llm import html_text
from tests.llm.conftest import prose
from tests.llm.test_tables import page

#: Parts of articles, each with what makes it odd: elements that training pages lack, and names that furniture uses as well.
PARTS = {
    "figure": '<figure><img src="a.png"><figcaption>{x}</figcaption></figure>', "hero": '<div class="hero"><p>{x}</p></div>', "message": '<div class="message"><p>{x}</p></div>',
    "tags": '<section id="tags"><h2>{y}</h2><p>{z}</p></section>', "table": "<table><tr><th>{y}</th><th>{w}</th></tr><tr><td>{w}</td><td>{y}</td></tr></table>",
    "links": '<ul><li><a href="/1">{x}</a></li><li><a href="/2">{y}</a></li><li><a href="/3">{z}</a></li></ul>', "dl": "<dl><dt>{w}</dt><dd>{x}</dd><dt>{y}</dt><dd>{y}</dd></dl>", "ul": "<ul><li>{x}</li><li>{y}</li></ul>",
    "ol": "<ol><li>{x}</li><li>{z}</li></ol>", "pre": "<pre>{x}</pre>", "quote": "<blockquote>{x}</blockquote>", "h2": "<h2>{y}</h2>", "nested": "<section><h3>{y}</h3><p>{x}</p><section><p>{z}</p></section></section>",
    "warning": '<div class="warning">{z}</div>', "details": "<details><summary>{y}</summary><p>{z}</p></details>", "reader": '<div class="reader"><p>{z}</p></div>', "word": "<p>{w}</p>", "linked": '<p><a href="/x">{x}</a></p>',
}
FRAMES = ("<main><article>{}</article></main>", '<div class="content">{}</div>', "<div><div>{}</div></div>", '<div class="zq">{}</div>')
FURNITURE = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">{a}</div>', '<footer>&copy; {b}</footer>', '<section class="comments"><h2>Talk</h2><p>{a}</p><p>{b}</p></section>',
    '<div class="cookie-notice"><p>{a}</p></div><form><p>{b}</p></form>', '<aside class="sidebar"><p>{a}</p></aside>',
)


@pytest.fixture(scope="module")
def model():
    return html_text.train([page(k)[0] for k in range(120)])


def main_text(model, html):
    read = [html_text.Page(html)]
    parents, depth, first = html_text.tree(read)
    return read[0].text(html_text.decode(html_text.boosting.margins(model, html_text.describe(read, parents, depth, first)), parents, depth))


def one(k, n):
    return " ".join(prose(k, n).split())


@pytest.mark.parametrize("frame", FRAMES)
def test_nothing_of_an_article_is_lost(model, frame):
    for k, (name, part) in enumerate(PARTS.items()):
        b = 9000 + 100 * k
        paragraphs = [f"<p>{one(b + 10 + i, 60)}</p>" for i in range(6)]
        given = part.format(x=one(b + 1, 12), y=one(b + 2, 4), z=one(b + 3, 30), w=one(b + 4, 1))
        article = frame.format("".join([f"<h1>{one(b + 20, 6)}</h1>", *paragraphs[:3], given, *paragraphs[3:]]))
        whole = html_text.Page(article)
        want = whole.text([True] * len(whole.tags))
        before, after = (FURNITURE[j].format(a=one(b + 30, 9), b=one(b + 31, 25)) for j in (0, 1 + k % 4))
        assert main_text(model, f"<html><body>{before}{article}{after}</body></html>") == want, (frame, name)


def test_an_articles_own_header_stays(model):
    body = "".join(f"<p>{one(800 + k, 50)}</p>" for k in range(4))
    text = main_text(model, f"<body><header><p>{one(1, 3)}</p></header><article><header><h1>Own title here</h1></header>{body}</article></body>")
    assert text.split("\n")[0] == "Own title here" and len(text.split("\n")) == 5


@pytest.mark.parametrize("odd", ["<a " * 350_000, '<a "' * 250_000, "<" * 1_000_000, "<i>" * 120_000 + "</b>" * 120_000, "<b><div>" + "<i>" * 120_000 + "</b>" * 120_000, "<li><p>" * 60_000, "<!--" * 250_000, "<div>" * 50_000 + "</p>" * 200_000])
def test_malformed_pages_are_read_in_linear_time(odd):
    began = time.process_time()
    read = [html_text.Page(odd)]
    assert time.process_time() - began < 5
    parents, depth, first = html_text.tree(read)
    assert len(parents) == len(depth) == len(read[0].tags) and np.array_equal(first, [0])


def test_long_pages(spark, model):
    body = "".join(f"<p>{one(k, 200)}</p>" for k in range(600))
    pages = spark.createDataFrame([(1, "u", f"<body><nav><a href='#'>x</a></nav><article>{body * 3}</article></body>")], "page_id bigint, url string, html string")
    assert html_text.extract(pages, model).first().n_chars == 3 * sum(len(one(k, 200)) + 1 for k in range(600)) - 1
