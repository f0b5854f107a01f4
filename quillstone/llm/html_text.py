"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page is read into its block-level elements; inline elements belong to the
block around them. Each element is described by its tag, tokens of its
attributes, depth, the density of text and links in its subtree, what stands
above it, and how it compares with its siblings. Boosted trees, fitted on a
bounded sample of pages, give the odds that an element holds main text. A
dynamic programme over the tree then picks the most likely labels of all
elements together in which no element with main text lies under one without.
"""

from __future__ import annotations

import copy
import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import boosting
from quillstone.llm import kernels as K
from quillstone.llm.storage import bounded

NAME = "op8_html_text"
ORACLE = None
#: The trees are fitted on at most so many pages of at most so many characters, those with the smallest hash of their id.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 500_000

# How HTML's elements are read. Elements that are not listed are inline, as browsers have it: they belong to the block around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title button select textarea datalist".split())
RAW = frozenset("script style noscript template iframe noframes title textarea".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCK = CLOSES_PARAGRAPH | frozenset("html head body p li dt dd tr td th thead tbody tfoot caption legend summary dialog search center dir listing option optgroup frameset".split())
#: Elements of drawings and formulas, in which a slash ends an element without an end tag.
SELF_CLOSED = frozenset("circle ellipse line path polygon polyline rect stop use image g defs mspace mprescripts none animate".split())
SIBLINGS_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words that attributes of page furniture and of main text use.
FURNITURE = frozenset(
    "ad ads adbox advert advertisement alert author banner bar breadcrumb breadcrumbs byline comment comments consent contact cookie cookies copyright disclaimer discussion disqus feedback foot footer form gdpr head header "
    "hero legal login logo masthead menu message meta modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promotion reader recommend recommended related remark replies reply respond "
    "response responses search share sharing side sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar tracking warning widget".split()
)
#: Of these, words that main text uses of its parts as well; they label nothing.
AMBIGUOUS = frozenset("alert author bar byline head header hero legal message meta reader response responses share tags title warning".split())
SURE = FURNITURE - AMBIGUOUS
MAIN = frozenset("article articlebody body content entry main page post story text".split())
TAGS = ("article", "main", "section", "div", "p", "h", "list", "li", "nav", "header", "footer", "aside", "form", "table", "quote", "other")
_TAG_OF = {"ul": "list", "ol": "list", "menu": "nav", "dl": "list", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "fieldset": "form", "body": "other", "html": "other"} | {f"h{k}": "h" for k in range(1, 7)}
_NUMBER = {t: k for k, t in enumerate(TAGS)}
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The block-level elements of a page in document order, and its text in pieces.

    Element 0 is the page itself. pieces: (element, block, text), text outside
    dropped elements with its references decoded; a block ends where a
    block-level element starts or ends.
    """

    __slots__ = ("links", "named", "parents", "pieces", "tags")

    def __init__(self, source: str | None):
        self.tags, self.parents, self.named, self.links = ["html"], [-1], [""], [0]
        self.pieces: list[tuple[int, int, str]] = []
        if source:
            self._read(source)

    def _read(self, source: str) -> None:
        """Reads in time in proportion to the source, however it is malformed.

        No search goes back over what was read: markup that nothing closes is
        known from the place of the last closing bracket, and for each tag
        ``opened`` has the places of its open elements.
        """
        stack: list[tuple[str, int]] = [("", 0)]  # open elements: tag, and block-level element that holds their text
        blocks: list[int] = [0]  # the places of those that are block-level
        opened: dict[str, list[int]] = {}
        block = at = begin = dropped = anchors = 0
        last = source.rfind(">")

        def push(tag: str, owner: int) -> None:
            if tag in BLOCK:
                blocks.append(len(stack))
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, owner))

        def pop(down_to: int) -> None:
            nonlocal block, dropped, anchors
            while len(stack) > down_to:
                tag, _ = stack.pop()
                opened[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                    block += 1
                dropped -= tag in DROPPED
                anchors -= tag == "a"

        def add(text: str) -> None:
            if dropped or not text:
                return
            owner = stack[-1][1]
            self.pieces.append((owner, block, html_.unescape(text)))
            if anchors:
                self.links[owner] += len(text)

        while True:
            at = source.find("<", at)
            m = None
            if at >= 0 and (at < last or source.startswith(("<!", "<?"), at)):
                m = _MARKUP.match(source, at)
                if not m:
                    at += 1
                    continue
            add(source[begin : at if m else len(source)])
            if not m:
                break
            at = begin = m.end()
            end, tag, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if not tag:
                if m.group().startswith("<![CDATA["):
                    add(m.group()[9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if end:
                places = opened.get(tag)
                # an inline end tag closes nothing beyond its block
                if places and (tag in BLOCK or places[-1] > blocks[-1]):
                    pop(places[-1])
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = close.start() if close else len(source)
                gone = _MARKUP.match(source, at) if at < last else None
                at = begin = gone.end() if gone else at
                continue
            if tag in ("br", "hr"):
                add(" ")
                block += tag == "hr"
                continue
            if tag in VOID:
                continue
            if dropped and tag in BLOCK and tag not in ("html", "head"):
                while opened.get("head"):  # its end tag may be left out
                    pop(opened["head"][-1])
            if tag in CLOSES_PARAGRAPH and stack[blocks[-1]][0] == "p":
                pop(blocks[-1])
            if tag in SIBLINGS_CLOSE:
                for place in blocks[: -3 if len(blocks) > 2 else None : -1]:  # a paragraph may be open within
                    if stack[place][0] in SIBLINGS_CLOSE[tag]:
                        pop(place)
                        break
                    if stack[place][0] != "p":
                        break
            dropped += tag in DROPPED
            if tag not in BLOCK:
                push(tag, stack[-1][1])
                anchors += tag == "a"
                if rest.endswith("/") and tag in SELF_CLOSED:
                    pop(len(stack) - 1)
                continue
            block += 1
            self.tags.append(tag)
            self.parents.append(stack[-1][1])
            self.named.append(" ".join(_NAMED.findall(rest)) if "=" in rest else "")
            self.links.append(0)
            push(tag, len(self.tags) - 1)

    def text(self, keep: np.ndarray | list[bool]) -> str:
        """The blocks of the elements to keep, white space made single, a line each."""
        out: list[str] = []
        last, part = -1, []
        for owner, block, text in self.pieces:
            if keep[owner]:
                if block != last:
                    out.append("".join(part))
                    last, part = block, []
                part.append(text)
        out.append("".join(part))
        return "\n".join(s for t in out if (s := " ".join(t.split())))


FEATURES = (
    *(f"is_{t}" for t in TAGS), *(f"under_{t}" for t in TAGS), "furniture", "main", "ambiguous", "furniture_above", "main_above", "furniture_below", "depth", "siblings", "place", "from_end",
    "chars", "own_chars", "links", "marks", "elements", "density", "page_share", "parent_share", "sibling_chars", "sibling_links", "before_links", "after_chars",
    "in_core", "around_core", "up_links", "up_marks",
)


def tree(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents (-1 at roots), depths and first elements of all pages' elements laid end to end."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.cumsum(sizes) - sizes
    parents = np.concatenate([np.array(p.parents) + f for p, f in zip(pages, first, strict=True)])
    parents[first] = -1
    depth = np.zeros(len(parents), np.int64)
    for k, p in enumerate(parents.tolist()):
        if p >= 0:
            depth[k] = depth[p] + 1
    return parents, depth, first


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def describe(pages: list[Page], parents: np.ndarray, depth: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each element."""
    n = len(parents)
    sizes = np.diff(np.append(first, n))
    tags = np.array([_NUMBER.get(_TAG_OF.get(t, t), len(TAGS) - 1) for p in pages for t in p.tags])
    is_tag = np.zeros((n, len(TAGS)))
    is_tag[np.arange(n), tags] = 1
    furniture, main, unsure = np.zeros(n), np.zeros(n), np.zeros(n)
    k = 0
    for p in pages:
        for named in p.named:
            if named:
                words = {w.lower() for w in _TOKEN.findall(named)}
                furniture[k], main[k], unsure[k] = len(words & SURE), len(words & MAIN), len(words & AMBIGUOUS)
            k += 1
    chars, marks, links = np.zeros(n), np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first.tolist(), strict=True):
        links[f : f + len(p.links)] = p.links
        for owner, _, text in p.pieces:
            chars[f + owner] += len(text)
            marks[f + owner] += text.count(".") + text.count(",")
    own = chars.copy()
    sums = np.stack([chars, marks, links, np.ones(n), furniture], axis=1)
    levels = _levels(depth)
    for level in reversed(levels[1:]):
        np.add.at(sums, parents[level], sums[level])
    above = np.zeros((n, len(TAGS) + 2))
    mine = np.concatenate([is_tag, furniture[:, None], main[:, None]], axis=1)
    for level in levels[1:]:
        above[level] = above[parents[level]] + mine[parents[level]]
    chars, marks, links, count, below = sums.T
    up = np.where(parents >= 0, parents, np.arange(n))
    order = np.argsort(up * 2 + (parents >= 0), kind="stable")  # children of one parent in document order
    group, place = np.unique(up[order] * 2 + (parents[order] >= 0), return_inverse=True)
    starts = np.searchsorted(place, np.arange(len(group)))
    children = np.diff(np.append(starts, n))
    nth, siblings = np.empty(n), np.empty(n)
    nth[order], siblings[order] = np.arange(n) - starts[place], children[place]
    link_share = links / np.maximum(chars, 1)
    mean_chars, mean_links = np.empty(n), np.empty(n)
    for out, values in ((mean_chars, chars), (mean_links, link_share)):
        out[order] = (np.add.reduceat(values[order], starts) / children)[place]
    before, after = np.zeros(n), np.zeros(n)
    same = place[1:] == place[:-1]
    before[order[1:][same]] = link_share[order[:-1][same]]
    after[order[:-1][same]] = chars[order[1:][same]]
    page = np.repeat(chars[first], sizes)
    # the core of a page is its deepest element with at least half of its marks
    most = (2 * marks >= np.repeat(marks[first], sizes)) & (np.repeat(marks[first], sizes) > 0)
    core = np.zeros(n, bool)
    for f, size in zip(first.tolist(), sizes.tolist(), strict=True):
        own_most = np.flatnonzero(most[f : f + size])
        if len(own_most):
            core[f + own_most[np.argmax(depth[f + own_most])]] = True
    for level in levels[1:]:
        core[level] |= core[parents[level]]
    columns = [
        is_tag, above[:, :-2], furniture, main, unsure, above[:, -2], above[:, -1], below - furniture, depth, siblings, nth, siblings - nth, chars, own, link_share,
        marks / np.maximum(chars, 1), count, chars / count, chars / np.maximum(page, 1), chars / np.maximum(chars[up], 1), chars / np.maximum(mean_chars, 1), mean_links, before, after,
        core.astype(float), (most & ~core).astype(float), link_share[up], (marks / np.maximum(chars, 1))[up],
    ]
    return np.concatenate([c.reshape(n, -1) for c in columns], axis=1)


def decode(odds: np.ndarray, parents: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely labels of all elements in which one with main text never lies under one without."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    levels = _levels(depth)
    for level in reversed(levels[1:]):
        np.add.at(yes, parents[level], np.maximum(yes[level], no[level]))
        np.add.at(no, parents[level], no[level])
    label = yes > no
    for level in levels[1:]:
        label[level] &= label[parents[level]]
    return label


# -- training ---------------------------------------------------------------

#: Furniture by its names or elements, outside the article or within.
_INSERTS = (
    '<aside class="sidebar"><h3>{a}</h3><ul><li><a href="#">{b}</a></li><li><a href="#">{c}</a></li></ul></aside>', '<div class="cookie-notice"><p>{d}</p><button>OK</button></div>',
    '<section class="comments"><h2>{a}</h2><div class="comment"><p>{d}</p></div><div class="comment"><p>{e}</p></div></section>', '<form class="newsletter"><p>{a}</p><label>{b}</label><input type="text"></form>',
    '<div class="related-posts"><h3>{a}</h3><a href="#">{b}</a> <a href="#">{c}</a></div>', '<div id="sidebar"><p>{d}</p></div>', '<div class="sponsored"><p>{e}</p></div>', '<ol id="comments"><li>{d}</li><li>{e}</li></ol>',
    '<div role="navigation"><ul class="menu"><li><a href="#">{a}</a></li><li><a href="#">{b}</a></li></ul></div>', '<div class="notice"><p>{c}</p></div>', '<aside><p>{d}</p></aside>', '<form><p>{d}</p></form>',
    '<nav><a href="#">{a}</a> <a href="#">{b}</a></nav>', '<section id="comments"><p>{d}</p><p>{e}</p></section>', '<div class="ad">{c}</div>', '<div class="advertisement"><a href="#">{c}</a></div>',
    '<ul class="share-buttons"><li><a href="#">{b}</a></li><li><a href="#">{b}</a></li></ul>', '<div class="reader-comments"><div><b>{b}</b><p>{e}</p></div><div><b>{b}</b><p>{d}</p></div></div>', '<div id="cookie-banner">{c} <button>OK</button></div>',
    '<div class="comment-list"><table><tr><td>{b}</td><td>{d}</td></tr><tr><td>{b}</td><td>{e}</td></tr></table></div>', '<nav class="breadcrumb"><ol><li><a href="#">{b}</a></li><li>{b}</li></ol></nav>',
)
#: Furniture that stands around an article only.
_AROUND = (
    *_INSERTS, '<header class="site-header"><h1>{a}</h1><p>{b}</p></header>', '<header><p>{a}</p></header>', '<footer><p>{d}</p></footer>', '<footer class="footer">{c}<ul><li><a href="#">{b}</a></li><li><a href="#">{b}</a></li></ul></footer>',
    '<header><h2>{b}</h2><nav><ul><li><a href="#">{b}</a></li><li><a href="#">{b}</a></li><li><a href="#">{b}</a></li></ul></nav></header>', '<div id="footer"><p>{c}</p></div>',
)
#: Furniture that its links, forms and lengths give away without any name.
_SHAPED = (
    '<ul><li><a href="#">{a}</a></li><li><a href="#">{b}</a></li><li><a href="#">{a}</a></li></ul>', '<div><a href="#">{a}</a> <a href="#">{b}</a> <a href="#">{c}</a></div>',
    '<div><h3>{b}</h3><ul><li><a href="#">{b}</a></li><li><a href="#">{c}</a></li></ul></div>', '<form><p>{a}</p><label>{b}</label><input type="text"></form>',
    '<div><span>{b}</span> <a href="#">{b}</a></div>',
)
#: What articles hold besides paragraphs; {n} is a name.
_PARTS = (
    "<h2>{a}</h2><p>{e}</p>", "<h3>{b}</h3><p>{d}</p>", "<ul><li>{c}</li><li>{a}</li><li>{c}</li></ul>", "<ol><li>{d}</li><li>{a}</li></ol>", "<ul><li><p>{d}</p></li><li><p>{c}</p></li></ul>", "<ul><li>{b}<ul><li>{b}</li><li>{a}</li></ul></li></ul>",
    '<ul><li><a href="#">{a}</a></li><li><a href="#">{c}</a></li><li><a href="#">{a}</a></li></ul>', '<h2>{b}</h2><ul><li><a href="#">{a}</a>, {b}</li><li><a href="#">{c}</a> {b}</li></ul>', '<p><a href="#">{c}</a></p>', '<p>{c} <a href="#">{a}</a> {d} <a href="#">{b}</a></p>',
    "<table><tr><td>{b}</td><td>{b}</td></tr><tr><td>{b}</td><td>{b}</td></tr></table>", "<table><caption>{a}</caption><thead><tr><th>{b}</th><th>{b}</th></tr></thead><tbody><tr><td>{b}</td><td>{a}</td></tr><tr><td>{b}</td><td>{c}</td></tr></tbody></table>",
    '<div class="{n}"><table><tr><th>{b}</th><td>{a}</td></tr><tr><th>{b}</th><td>{a}</td></tr></table></div>', "<dl><dt>{b}</dt><dd>{c}</dd><dt>{b}</dt><dd>{d}</dd></dl>", "<pre>{c}</pre>", "<pre><code>{a}\n{c}</code></pre>",
    '<figure><img src="x.png"><figcaption>{c}</figcaption></figure>', '<figure class="{n}"><img src="x.png"><figcaption>{a}</figcaption></figure>', "<blockquote>{c}</blockquote>", "<blockquote><p>{d}</p></blockquote>",
    '<section id="{n}"><h2>{a}</h2><p>{e}</p><p>{d}</p></section>', '<section class="{n}"><p>{d}</p></section>', '<div class="{n}"><p>{d}</p></div>', '<div class="{n}">{d}</div>', '<div id="{n}"><h3>{b}</h3><p>{e}</p></div>', "<div>{d}</div>", "<div><p>{a}</p></div>",
    "<details><summary>{b}</summary><p>{d}</p></details>", "<p>{a}</p>", "<p>{b}</p><p>{e}</p>", '<div class="{n}"><h2>{b}</h2></div>', "<hr><p>{d}</p>", "<p>{b}<br>{a}<br>{b}</p>", "<center>{c}</center>",
)
_HEADS = ("<h1>{t}</h1>", "<h1>{t}</h1>", "<h2>{t}</h2>", "<header><h1>{t}</h1></header>", "<header><h2>{t}</h2></header>", "<header><h1>{a}</h1><p>{a}</p></header>", '<header class="{n}"><h1>{t}</h1><p>{c}</p></header>', '<div class="{n}"><h1>{t}</h1></div>')
#: Names of parts of articles: those that label nothing, and some that say nothing.
_NAMES = (*sorted(AMBIGUOUS), "box", "x1", "intro", "lead", "wide", "row", "column", "wrapper", "data", "figure", "chapter", "sources", "references", "history", "summary", "k-7", "block", "inner", "example", "code", "quote")
#: Every so many pages are also learned from without any telling element or attribute.
BARE_EVERY = 2
TELLING = frozenset("article main section nav header footer aside".split())
_HOLDERS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post-body">', "</div></div>"), ('<section class="story">', "</section>"), ("<main><article>", "</article></main>"),
    ("<div>", "</div>"), ('<div class="k7"><div>', "</div></div>"), ("<div id='wrap'><article class='entry'>", "</article></div>"),
)
#: Stands before all furniture of a made page while its elements are labelled.
_SIGN = "\ue000"


def _weak(page: Page) -> list[bool]:
    """Labels of a real page's elements: below an article or main element, or else one named as content, and not below furniture."""
    state, has = [], []
    semantic = any(t in ("article", "main") for t in page.tags)
    held = [False] * len(page.tags)
    for owner, _, text in page.pieces:
        held[owner] |= not text.isspace()
    for k, (tag, named) in enumerate(zip(page.tags, page.named, strict=True)):
        up = state[page.parents[k]] if k else 0
        words = {w.lower() for w in _TOKEN.findall(named)}
        if up < 0 or tag in ("nav", "aside", "form") or (up == 0 and tag in ("header", "footer")) or words & SURE:
            state.append(-1)
        elif up > 0 or tag in ("article", "main") or (not semantic and words & MAIN and tag != "body"):
            state.append(1)
        else:
            state.append(0)
        has.append(state[-1] > 0 and held[k])
    for k in range(len(has) - 1, 0, -1):
        has[page.parents[k]] |= has[k]
    return has


def _truth(page: Page) -> list[bool]:
    """Labels of a made page's elements, by where their text was put; the signs are taken out."""
    has = [False] * len(page.tags)
    for k, (owner, block, text) in enumerate(page.pieces):
        has[owner] |= _SIGN not in text and not text.isspace()
        if _SIGN in text:
            page.pieces[k] = (owner, block, text.replace(_SIGN, ""))
    for k in range(len(has) - 1, 0, -1):
        has[page.parents[k]] |= has[k]
    return has


def _varied(page: Page, keep: list[bool], number: int, shaped: bool = False) -> tuple[Page, list[bool]]:
    """Another page with the same main text and parts of all kinds in another frame, furniture around and inside it, and its labels."""
    draw = np.random.default_rng(number)
    blocks = page.text(keep).replace(_SIGN, "").split("\n")
    words = " ".join(blocks).split() or ["-"]
    if not shaped and draw.integers(0, 5) == 0:  # articles can be very short
        blocks = [" ".join(b.split()[:3]) for b in blocks[:2]]

    def some(least: int, most: int) -> str:
        a = int(draw.integers(0, len(words)))
        return html_.escape(" ".join(words[a : a + int(draw.integers(least, most))]))

    def one(kinds: tuple[str, ...], sign: str = "") -> str:
        class Fields(dict):  # every field of its own text
            def __missing__(self, key):
                if key == "n":
                    return _NAMES[int(draw.integers(len(_NAMES)))]
                return html_.escape(blocks[0]) if key == "t" else sign + some(*{"a": (1, 6), "b": (1, 4), "c": (2, 12), "d": (5, 60), "e": (8, 90)}[key])

        made = kinds[int(draw.integers(len(kinds)))]
        return re.sub(r"\{(.)\}", lambda m: Fields()[m.group(1)], made)

    start, end = _HOLDERS[int(draw.integers(len(_HOLDERS)))]
    inner = [f"<p>{html_.escape(b)}</p>" for b in blocks[1:]]
    if draw.integers(0, 2):  # articles of any length
        inner = [f"<p>{some(5, 120)}</p>" for _ in range(int(draw.integers(1, 14)))]
    for _ in range(int(draw.integers(0, 5))):
        inner.insert(int(draw.integers(0, len(inner) + 1)), one(_PARTS))
    inner.insert(0, one(_HEADS))
    for _ in range(0 if shaped else int(draw.integers(0, 3))):
        inner.insert(int(draw.integers(1, len(inner) + 1)), one(_INSERTS, _SIGN))
    around = [one(_SHAPED if shaped else _AROUND, _SIGN) for _ in range(int(draw.integers(1, 5)))]
    cut = int(draw.integers(0, len(around) + 1))
    body = "".join(around[:cut]) + start + "".join(inner) + end + "".join(around[cut:])
    for _ in range(int(draw.integers(0, 3)) if draw.integers(0, 3) == 0 else 0):
        body = f"<div>{body}</div>"
    made = Page(f"<html><body>{body}</body></html>")
    return made, _truth(made)


def _plain(page: Page) -> Page:
    """The page without attributes, its telling elements made plain ones: what is left to learn from is the shape of the tree."""
    out = copy.copy(page)
    out.tags = ["div" if t in TELLING else t for t in page.tags]
    out.named = [""] * len(page.named)
    return out


def train(sources: list[str]) -> dict:
    """Trees fitted on the sampled pages as they are, each with other parts in three other frames, and some in one whose elements and attributes tell nothing."""
    pages, labels = [], []
    for k, source in enumerate(sources):
        page = Page(source)
        own = _weak(page)
        pages.append(page)
        labels += own
        for turn in range(4 if k % BARE_EVERY == 0 else 3):
            made, truth = _varied(page, own, 4 * k + turn, turn == 3)
            pages.append(_plain(made) if turn == 3 else made)
            labels += truth
    if not labels:
        return {}
    return boosting.fit(describe(pages, *tree(pages)), np.array(labels, float))


def sample(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """The sources of at most ``most`` pages, those with the smallest hash of their id; nulls, empty ones and very long ones are left out."""
    pages = pages.filter(F.length("html").between(1, SAMPLE_CHARS))
    order = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(8))
    last = pages.select(order.alias("o")).orderBy("o").limit(most).agg(F.max("o")).first()[0]
    if last is None:
        return []
    return [r[0] for r in pages.filter(order <= last).select("html").orderBy(F.xxhash64("html"), "html").limit(most).collect()]


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty page, one without an element of main text, and every page
    under an empty model have the empty text. Repeated rows get equal results.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.slices(batches, "html"):
            read = [Page(s) for s in piece.column("html").to_pylist()]
            parents, depth, first = tree(read)
            if model:
                label = decode(boosting.margins(model, describe(read, parents, depth, first)), parents, depth)
            else:
                label = np.zeros(len(parents), bool)
            texts = [p.text(label[f : f + len(p.tags)]) for p, f in zip(read, first.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return bounded(own).mapInArrow(apply, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(sample(pages)))
