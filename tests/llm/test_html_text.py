import re
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from keystrata.llm import html_text as h


@pytest.fixture(scope="module")
def net():
    return h.train()


def article(page):
    """The plain reading of the test tables' template: blocks inside <article>."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inside)
    texts = (" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_gradient_is_right():
    net, rng = h.BiLstm(3, 5, 3), np.random.default_rng(0)
    x, mask, y = rng.normal(size=(4, 3, 5)), np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool), rng.integers(0, 2, (4, 3))
    _, g = net.gradient(x, mask, y)
    for i in rng.choice(len(net.flat), 25):
        net.flat[i] += 1e-5
        up = net.gradient(x, mask, y)[0]
        net.flat[i] -= 2e-5
        down = net.gradient(x, mask, y)[0]
        net.flat[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_blocks_of_broken_markup():
    got = [(b.text, [p[0] for p in b.path]) for b in h.blocks('<p>a &amp; <b>b<br>c<p>d <i>e</i>\n f<ul><li>g<li>h</ul><!-- x > --><script>"</p>"</script><div class="ad">i</div> j < k <style>z')]
    assert got == [("a & b c", ["p"]), ("d e f", ["p"]), ("g", ["ul", "li"]), ("h", ["ul", "li"]), ("i", ["div"]), ("j < k", [])]
    assert h.blocks("") == [] and h.blocks("<!-- never closed <p>x") == []


def test_pages_of_the_tables(net):
    t = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    got = h.main_texts(net, t)
    wrong = sum(a != article(p) for a, p in zip(got, t, strict=True))
    print("wrong pages", wrong, "of", len(t))
    assert wrong == 0


def test_other_layouts(net):
    page = '<html><body><header>Site name</header><ul class="nav"><li><a href="/">Home</a><li><a href="/b">More</a></ul><div class="content"><h1>A title</h1><p>First paragraph of real text.</p><p>Second one, with a <a href="#">link</a>.</p></div><div class="sidebar"><p>Read this too.</p></div><div class="comments"><p>I agree with all of it.</p></div><footer>All rights reserved.</footer></body></html>'
    assert h.main_texts(net, [page])[0] == "A title\nFirst paragraph of real text.\nSecond one, with a link."
    rng, right, total = np.random.default_rng(99), 0, 0
    for _ in range(200):
        p, labels = h.training_page(rng)
        b = h.blocks(p)
        if b and len(b) == len(labels):
            s, _ = net.forward(*h.padded([h.vectors(b)]))
            right += ((s[:, 0] > 0.5) == np.array(labels)).sum()
            total += len(b)
    print("held-out blocks", right / total)
    assert right / total > 0.97


def test_markup_that_is_never_closed():
    texts = lambda page: [b.text for b in h.blocks(page)]
    assert texts('<p title="a>One</p><p class="b">Two</p>') == ["One", "Two"]
    assert texts("<p data-x='a>b' title=\"c>d\">One</p>") == ["One"]
    for name in ("button", "select", "textarea", "canvas", "object", "iframe", "noscript"):
        assert texts(f"<div>a<{name}>Menu</div><p>One</p><div>b<{name}>x</{name}>c</div>") == ["a", "One", "b c"], name
    assert texts("<p>a <svg/> b <math/> c</p><p>d<svg><svg/><svg>x</svg></svg>e</p>") == ["a b c", "d e"]
    assert texts("<p>x<b><i><u><em><span>y<div>z") == ["xy", "z"] and [p[0] for p in h.blocks("<p>x<b><i><u><em><span>y<div>z")[1].path] == ["div"]
    assert texts("<button>" * 3 + "<p>One") == ["One"]


def test_every_word_counts():
    one, two = (h.vectors(h.blocks("<p>" + "word " * 400 + w))[0] for w in ("last", "cookies"))
    assert not np.array_equal(one, two)


def test_words_decide_where_classes_are_missing(net):
    """Pages without telling classes, labelled by words, shape and sequence."""
    rng, right, blind, total = np.random.default_rng(7), 0, 0, 0
    lo = (1 << h.PATH_BITS) + (1 << h.NEAR_BITS)
    for _ in range(200):
        p, labels = h.training_page(rng, named=0)
        b = h.blocks(p)
        if b and len(b) == len(labels):
            x = h.vectors(b)
            right += ((net.forward(*h.padded([x]))[0][:, 0] > 0.5) == np.array(labels)).sum()
            x[:, lo : lo + (1 << h.WORD_BITS)] = 0
            blind += ((net.forward(*h.padded([x]))[0][:, 0] > 0.5) == np.array(labels)).sum()
            total += len(b)
    print("blocks without classes", right / total, "without words too", blind / total)
    assert right / total > 0.96 and right > blind + 0.01 * total


def test_table_cases(spark, net):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<article>" + "<p>x y</p>" * 5000 + "</article>", "t"), (3, "u", "<article><p>z</article>", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars) for r in h.extract(df, net).collect())
    assert got[:2] == [(1, 0), (2, 0)] and got[3] == (3, 19999) and len(got) == 4
    assert h.extract(df.limit(0), net).count() == 0
