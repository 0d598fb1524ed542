"""Main text of pages with known answers, parsing of broken markup, and gradients."""

import html
import re

import numpy as np
import pytest

from factorlake.llm import html as H


def article(page):
    """What the generated pages hold in their article."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)>", re.sub(r"</?b>", "", inner).replace("<br>", "\n"))
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@pytest.fixture(scope="module")
def labeller(spark, sf):
    return H.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def test_pages(spark, sf, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = H.extracted(pages, labeller).select("html", "text").collect()
    assert sum(r.text != article(r.html) for r in rows) == 0


@pytest.mark.parametrize(("before", "inside", "after"), [
    ('<header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>', "", '<footer>&copy; 2024</footer>'),
    ('<div class="cookie-notice"><p>We use cookies.</p></div><div class="menu"><a href="/a">A</a></div>', "", '<aside class="sidebar"><p>Read this too.</p></aside>'),
    ('<form class="search"><label>Search</label><button>Go</button></form>', '<div class="advert">Buy now.</div>', '<section class="comments"><p>Nice text!</p><p>Indeed.</p></section>'),
    ('<div class="banner">Big sale today.</div>', '<div class="share"><a href="/f">Share</a></div>', '<div id="comments"><p>First!</p></div><div class="footer"><p>Imprint</p></div>'),
])
@pytest.mark.parametrize("box", ["article", "main"])
def test_furniture_goes(labeller, before, inside, after, box):
    texts = ["And therhean is the is esndha reedes ha.", "Ble oninti oner thheathe. Thedanon thea.", "Retiwh erre &amp; thntbleea\n from  erreou."]
    body = f"<h1>{texts[0]}</h1><p>{texts[1]}</p>{inside}<p>{texts[2]}<br>End of it.</p>"
    page = f"<html><head><title>Title</title></head><body>{before}<{box}>{body}</{box}>{after}</body></html>"
    want = f"{texts[0]}\n\n{texts[1]}\n\nRetiwh erre & thntbleea from erreou. End of it."
    assert H.main_texts(labeller, [page]) == [want]


def test_blocks():
    page = "<p>a<b>b</b> c<p>d &lt; &amp;amp; &#233;<br>e<script>var t='</p>';</script>f<!-- <p>x</p> --><div class='x y'><a href='>'>g</a> h"
    assert [(t, n) for _, t, n in H.blocks(page)] == [("ab c", 0), ("d < &amp; é ef", 0), ("g h", 1)]
    assert [p for p, _, _ in H.blocks(page)][:2] == [("p",), ("p",)]
    for bad in ("", "<", "<p", "text <b", "<p>x</div></p>", "</p>", "<!-- open", "<script>never ends", "a < b > c", "&", "&#xZZ;", "<p title=\"un"):
        H.blocks(bad)
    assert H.blocks("a < b")[0][1] == "a < b"
    assert [t for _, t, _ in H.blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")] == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>one</p><svg><p>two</p><p>three</p></article>", ["one", "two", "three"]),
    ("<article><p>one</p><object><p>two</p><canvas>three</article><p>four", ["one", "two", "three", "four"]),
    ("<p>one <math><mi>x</mi><mo/>+<mn>1</mn></math> two</p><p>three", ["one x+1 two", "three"]),
    ("<p>one<svg viewBox='0'><title>icon</title><path d='M0'/><text>two</text></svg> three</p>", ["onetwo three"]),
    ("<p>one</p><noscript><p>two</p></noscript><video>three</video><p>four<svg/>five</p>", ["one", "two", "three", "fourfive"]),
    ("<p>one</p><iframe src=x><p>two</p></iframe><p>three</p><iframe src=y><p>four</p>", ["one", "three", "four"]),
    ("<p>one</p><svg><title>open<p>two</p>", ["one", "open", "two"]),
    ("<p>one</p><style>p { }</style><p>two</p><script>x<p>three</p>", ["one", "two"]),
])
def test_only_code_is_no_text(page, want):
    assert [t for _, t, _ in H.blocks(page)] == want


def test_text_of_embedded_elements_stays(labeller):
    texts = ["And therhean is the is esndha reedes ha.", "Ble oninti oner thheathe. Thedanon thea.", "Retiwh erre thntbleea from erreou."]
    for kind in ("noscript", "svg", "object", "canvas", "template"):
        for close in (f"</{kind}>", ""):
            page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>{texts[0]}</p><{kind}><p>{texts[1]}</p>{close}<p>{texts[2]}</p></article><footer><p>Imprint</p></footer></body></html>"
            assert H.main_texts(labeller, [page]) == ["\n\n".join(texts)], (kind, close)
    page = f"<html><body><noscript>Please enable JavaScript.</noscript><nav><a href=/>Home</a></nav><article><p>{texts[0]}</p><p>{texts[1]}</p></article></body></html>"
    assert H.main_texts(labeller, [page]) == ["\n\n".join(texts[:2])]


def test_odd_rows(spark, labeller):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (None, "u", "<article><p>x</p>"), (3, "u", "no tags at all"), (4, "u", "<article>" + "<p>A long text, again.</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    got = H.extracted(df, labeller).collect()
    assert len(got) == 6
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == ""
    assert by[4] == "\n\n".join(["A long text, again."] * 5000)
    assert H.extracted(df.limit(0), labeller).count() == 0
    assert H.fit(df.limit(0)) is not None


def test_gradients():
    rng = np.random.default_rng(1)
    model = H.Labeller(rng)
    pages = [H.blocks(f"<div class=a><p>one {i}</p><p>two words</p></div>" * (i + 1)) for i in range(3)]
    f = H.features(pages, H.PathIds(), H.WordIds())
    sizes = np.array([len(p) for p in pages])
    labels = rng.integers(0, 2, sizes.sum()).astype(float)

    def loss():
        z = model.run(model.inputs(f), sizes)
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    grads = model.gradients(f, model.inputs(f), sizes, labels)
    for name in ("xf", "hf", "cb", "hb", "out", "direct", "path", "word"):
        rows, g = grads[name] if isinstance(grads[name], tuple) else (None, grads[name])
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        where = (rows[at[0]], *at[1:]) if rows is not None else at
        before, step = model.p[name][where], 1e-5
        model.p[name][where] = before + step
        up = loss()
        model.p[name][where] = before - step
        down = loss()
        model.p[name][where] = before
        assert abs((up - down) / (2 * step) - g[at]) < 1e-5 + 1e-3 * abs(g[at]), name
