"""Top-k search and main-text extraction against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import boosting, html_text, top_k
from tests.llm.conftest import prose


def plain_top(rows, queries, k=5):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    own = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and ok(v)]
    out = []
    for q in sorted(set(queries)):
        for vector in [v for i, v in own if i == q][:1]:
            best = sorted((-int(v @ vector), i) for i, v in own if i != q and len(v) == len(vector))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(0, 0.2, 16).astype(np.float32).tolist()) for k in range(700)]
    rows += [(k, rows[3][1]) for k in range(700, 760)] + [(760, None), (761, [None] * 16), (762, [float("nan")] * 16), (763, []), (None, rows[0][1]), (764, [0.5, 0.25]), (800, [0.5, -0.25]), (850, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).withColumn("rank", F.lit(1)).withColumn("dim", F.lit("x"))
    queries = [i for i, _ in rows if i is not None and i % 50 == 0]
    for most in (8192, 64):
        monkeypatch.setattr(top_k, "SHARD_ROWS", most)
        found = top_k.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()
        assert sorted(map(tuple, found)) == plain_top(rows, queries)
    assert top_k.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_large_components_are_exact():
    draw = np.random.default_rng(2)
    for scale in (10**6, 2**31, 2**40):
        x = draw.integers(-scale, scale, (300, 8))
        ids = np.arange(300)
        q, i, s = top_k.best_of(ids, x, ids[:7], x[:7], 5)
        for k in range(7):
            exact = [sum(int(a) * int(b) for a, b in zip(x[k], x[j], strict=True)) for j in range(300) if j != k]
            assert s[q == k].tolist() == sorted((min(max(e, -(2**63)), 2**63 - 1) for e in exact), reverse=True)[:5]


def test_lists_are_read_only_as_far_as_needed():
    """Where one vector stands out a query stops early; the vectors that are left always hold its best."""
    draw = np.random.default_rng(6)
    x = draw.integers(-40, 40, (4000, 6))
    x[:40] += np.sign(x[:40]) * 400  # far out in every list
    own = np.zeros((20, 4000), bool)
    own[np.arange(20), np.arange(20)] = True
    left, read = top_k.read_lists(x, x[:20], own, 5)
    assert read.mean() < 0.6 and read.min() < 0.1 and left[read < 1].sum(axis=1).max() <= top_k.FEW
    for k in range(20):
        score = x @ x[k]
        score[k] = -(2**62)
        assert left[k][np.argsort(-score)[:5]].all()


def test_top_k_broadcasts_no_queries(spark):
    rows = [(k, [float((k * j) % 7) for j in range(4)]) for k in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = top_k.top_k(vectors, vectors.filter("vec_id % 50 = 0"))
    assert len(found._jdf.collectAsList()) == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    for x in ([[1, -(2**15)]], [[2**15, 0]], [[-(2**63), 2**63 - 1], [0, 1]]):
        x = np.array(x, np.int64)
        assert (top_k._unpacked(top_k._packed(x), *x.shape) == x).all()
    assert len(top_k._packed(np.array([[2**15 - 1]]))) == 2


def test_top_k_of_repeated_and_extreme_rows(spark):
    rows = [(50, [0.5, 0.5]), (50, [0.25, 0.5]), (1, [1e300, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [2.0**40, 2.0**40]), (2, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = [tuple(r) for r in top_k.top_k(vectors, vectors.filter("vec_id = 50")).orderBy("rank").collect()]
    high = 2**63 - 1
    assert found == [(50, 1, 1, high), (50, 2, 4, (2**48) * 64 + (2**48) * 128), (50, 3, 2, 256 * 192), (50, 4, 2, 256 * 192), (50, 5, 3, -256 * 64)]


def page(k: int) -> tuple[str, str]:
    """A page and its main text."""
    title, first, second = prose(k, 6).replace("\n", " "), prose(k + 500, 60), prose(k + 900, 40)
    html = (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        f'<!-- ad --><div class="ad">{prose(k + 50, 12)}</div><article><h1>{title}</h1><p><b>{first} &amp; more<br><p>{second}</p></article><footer>&copy; {prose(k + 70, 9)}</footer>'
    )
    text = "\n".join(" ".join(t.split()) for t in (title, first + " & more", second))
    return html, text


def test_html_text(spark):
    made = [page(k) for k in range(40)]
    rows = [(k, f"http://h/{k}", h) for k, (h, _) in enumerate(made)] + [(90, None, None), (91, "u", ""), (None, "u", "<p>"), (92, "u", "plain words"), (3, "http://h/3", made[3][0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    model = html_text.train(html_text.sample(pages))
    found = html_text.extract(pages, model).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    for k, (_, text) in enumerate(made):
        assert by[k] == text
    assert by[90] == by[91] == by[None] == ""
    frame = (
        '<body><header class="top"><h2>Site name</h2></header><div class="content"><h1>Title here</h1><p>{a}</p><p>{b}</p><div class="comments"><p>{c}</p></div></div>'
        '<aside><p>{d}</p></aside><div class="cookie-banner">We use cookies</div><form><p>Sign up to our letters</p></form></body>'
    )
    a, b, c, d = (" ".join(prose(k, 50).split()) for k in (301, 302, 303, 304))
    other = spark.createDataFrame([(1, "u", frame.format(a=a, b=b, c=c, d=d))], "page_id bigint, url string, html string")
    assert html_text.extract(other, model).first().text == f"Title here\n{a}\n{b}"
    assert html_text.extract(pages.limit(0), {}).collect() == [] and html_text.train([]) == {}


def words_of(text):
    from collections import Counter

    return Counter(text.split())


def test_frames_and_names_never_seen(spark):
    """Pages whose frame's elements and attributes are in no list: what is kept agrees with the article in its words."""
    made = [page(k) for k in range(40)]
    model = html_text.train([h for h, _ in made])
    draw = np.random.default_rng(5)
    right = kept = whole = 0
    for k in range(60):
        links = "".join(f'<li><a href="/{x}">{w}</a></li>' for x, w in enumerate(prose(k + 4000, 6).split()))
        paragraphs = [" ".join(prose(5000 + 10 * k + x, int(draw.integers(30, 70))).split()) for x in range(int(draw.integers(3, 7)))]
        head, title = " ".join(prose(k + 6000, 2).split()), " ".join(prose(k + 7000, 6).split())
        html = (
            f'<html><body><div class="qx1"><b>{head}</b><ul class="zr">{links}</ul></div><div class="wv{k % 5}"><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}</div>'
            f'<div class="plk"><ul>{links}</ul></div><div class="ooo"><a href="#">{head}</a> <a href="#">{title[:9]}</a></div></body></html>'
        )
        pages = html_text.Page(html)
        parents, depth, first = html_text.tree([pages])
        label = html_text.decode(html_text.boosting.margins(model, html_text.describe([pages], parents, depth, first)), parents, depth)
        got, want = words_of(pages.text(label)), words_of(" ".join([title, *paragraphs]))
        right += sum((got & want).values())
        kept += sum(got.values())
        whole += sum(want.values())
    assert right / kept > 0.9 and right / whole > 0.9, (right, kept, whole)


def plain_blocks(html):
    """The text blocks of well-formed markup by the standard library's reader."""
    from html.parser import HTMLParser

    out, part = [], []

    class Reader(HTMLParser):
        skip = 0

        def cut(self):
            out.append(" ".join("".join(part).split()))
            part.clear()

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title", "button", "head")
            if tag == "br":
                part.append(" ")
            elif tag in html_text.BLOCK or tag == "hr":
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title", "button", "head")
            if tag in html_text.BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                part.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    reader.cut()
    return "\n".join(t for t in out if t)


def test_reading_against_the_standard_library():
    draw = np.random.default_rng(11)
    inline = ["b", "i", "a", "span", "math", "mi", "object", "map", "svg", "custom-name", "code"]
    block = ["div", "section", "article", "ul", "dialog", "blockquote", "table"]

    def some(depth):
        kind = draw.integers(0, 6)
        if depth == 0 or kind < 2:
            return draw.choice(["word", " two words ", "x &lt; y", "caf&eacute;&nbsp;", "\n", "&#8212;"])
        inner = "".join(some(depth - 1) for _ in range(int(draw.integers(1, 4))))
        if kind == 2:
            tag = draw.choice(inline)
            return f"<{tag} class='k'>{''.join(draw.choice(['a', ' b ', '<br>']) for _ in range(3))}</{tag}>"
        if kind == 3:
            return draw.choice(["<hr>", "<br>", "<script>if (a<b) {}</script>", "<!-- note -->", "<button>OK</button>", "<img src='x'>"])
        tag = draw.choice(block)
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(400):
        html = "<html><head><title>t</title></head><body>" + "".join(some(4) for _ in range(4)) + "</body></html>"
        p = html_text.Page(html)
        assert p.text([True] * len(p.tags)) == plain_blocks(html), html


def test_inline_elements_stay_in_their_block():
    p = html_text.Page("<html><head><title>x</title><body><p>Let <math><mi>x</mi>=2</math> be <object>an object</object>, <map name=m>a map</map> <svg><path d='z'/><text>drawn</text></svg>.<dialog>d</dialog>")
    assert p.text([True] * len(p.tags)) == "Let x=2 be an object, a map drawn.\nd"


def test_labels_never_contradict():
    draw = np.random.default_rng(3)
    for _ in range(50):
        n = int(draw.integers(1, 9))
        parents = np.array([-1, *[int(draw.integers(0, k)) for k in range(1, n)]])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parents[k]] + 1
        odds = draw.normal(0, 2, n)
        label = html_text.decode(odds, parents, depth)
        best = max(
            (sum(-np.logaddexp(0, -o) if on else -np.logaddexp(0, o) for o, on in zip(odds, bits, strict=True)), bits)
            for bits in ([bool(x >> k & 1) for k in range(n)] for x in range(2**n)) if all(not bits[k] or bits[parents[k]] for k in range(1, n))
        )
        assert label.tolist() == best[1]


def test_boosting_learns():
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert np.mean((boosting.margins(boosting.fit(x[:1500], y[:1500]), x[1500:]) > 0) == y[1500:]) > 0.95


def test_reading_of_markup():
    p = html_text.Page("<div>a<p>b<p>c<b>d</b></div>e<ul><li>f<li>g</ul><script>x</script>h<!-- n -->i &lt;<![CDATA[j]]><div><p>k</div>l")
    assert p.text([True] * len(p.tags)) == "a\nb\ncd\ne\nf\ng\nhi <j\nk\nl"
