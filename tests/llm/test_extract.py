import html
import re

import numpy as np
import pytest

from netloom.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p > b {}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>not this</p> --><div class="cookie-notice">We use cookies.</div>
<article><h1>Title  here</h1><p>First &amp; <b>second</b>&nbsp;part,<br>a line.<p>Unclosed   paragraph with <a title="a > b" href='x'>a link</a> in it.<div class="ad">Buy now</div>
<ul><li>one item of the list<li>two items of the list</ul></article><aside><p>See also this.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot, thanks.</p></div></section><form><p>Subscribe</p></form><footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_blocks():
    texts = [t for _, t, _ in extract.blocks(PAGE)]
    assert texts == ["t", "Site", "Home", "We use cookies.", "Title here", "First & second part,", "a line.", "Unclosed paragraph with a link in it.", "Buy now", "one item of the list",
                     "two items of the list", "See also this.", "Comments", "I liked this article a lot, thanks.", "Subscribe", "© us"]
    assert extract.blocks(None) == extract.blocks("") == extract.blocks("<!-- open") == extract.blocks("<script>x") == []
    assert [t for _, t, _ in extract.blocks("a < b <p>c")] == ["a < b", "c"]
    assert len(extract.blocks("<p>x" * 30_000)) == 30_000
    assert extract.blocks("<p " + "a='" * 50_000)  # no closing quote: still linear


@pytest.mark.parametrize("page, want", [
    ('<p>one</p><svg class="i"/><p>two</p><p>three</p>', ["one", "two", "three"]),
    ("<p>one <svg viewBox='0 0 1 1'><g><path d='M0'/></g></svg> two</p><p>three", ["one two", "three"]),
    ("<p>a</p><svg><style/><text>label</text></svg><p>b</p><svg><path/><p>c</p>", ["a", "label", "b", "c"]),
    ('<svg-icon name="x"></svg-icon><p>b</p><object-viewer>c</object-viewer><template-x/><p>d</p><script-x>e</script-x><p>f', ["b", "c", "d", "e", "f"]),
    ("<p>so <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds</p><math/><p>b", ["so a=2 holds", "b"]),
    ("<p>a</p><object data='x'><p>instead</p></object><canvas>old</canvas><p>b</p><object><canvas><template><p>c</p>", ["a", "instead", "old", "b", "c"]),
    ("<p>a</p><script>x</scripts><p>y</p></script ><p>b</p><STYLE>z</style\n><p>c<iframe src='x'>d</iframe> e<noembed>f</noembed><noframes>g", ["a", "b", "c e"]),
])
def test_only_raw_text_is_dropped(page, want):
    assert [t for _, t, _ in extract.blocks(page)] == want


def test_an_article_with_drawings_and_formulas(model):
    page = PAGE.replace("<p>First", '<svg class="i"/><object data="o"></object><math/><p>First')
    assert extract.main_texts([page], model, extract.Features()) == extract.main_texts([PAGE], model, extract.Features())


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    m = extract.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, n = r.normal(size=(3, 5, extract.DIMS)), np.array([5, 2, 4])
    y = (r.random((3, 5)) > 0.5).astype(float)
    mask = np.arange(5) < n[:, None]

    def loss():
        z = m.run(x, n)
        return float((np.where(mask, np.log1p(np.exp(z)) - y * z, 0)).sum() / mask.sum())

    g = m.gradients(x, n, y)
    for k in m.w:
        at = tuple(int(r.integers(s)) for s in m.w[k].shape)
        m.w[k][at] += 1e-4
        up = loss()
        m.w[k][at] -= 2e-4
        down = loss()
        m.w[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-4


def test_main_text_in_several_layouts(model):
    for page in (PAGE, PAGE.replace("article>", "main>")):
        assert extract.main_texts([page], model, extract.Features()) == [
            "Title here\nFirst & second part,\na line.\nUnclosed paragraph with a link in it.\none item of the list\ntwo items of the list"]


def test_whole_table_and_odd_rows(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = extract.extract(pages, model).join(pages, ["page_id", "url"]).collect()
    good = 0
    for r in out:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"<(?:/?p|/?h1|br)>", re.sub("</?b>", "", inner))]
        good += "\n".join(x for x in parts if x) == r.text and r.n_chars == len(r.text)
    assert len(out) == 250 and good >= 247
    odd = spark.createDataFrame([(1, None, None, "k"), (2, "u", "", "k"), (2, "u", "", "k"), (3, "u", "<div>" * 3000 + "x", "k")], "page_id bigint, url string, html string, text string")
    rows = extract.extract(odd, model).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert extract.extract(odd.limit(0)).collect() == []
