"""HTML extraction: the parser on awkward markup, the field's sums and decoding against enumeration, held-out accuracy."""

import html
import itertools
import math
import random
import re

import numpy as np
import pytest

from rulewright.llm import html_text as T
from rulewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in T.blocks(page)]


@pytest.mark.parametrize("page, want", [
    ("", []), ("  \n ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
    ("<p>a <b>b<br>c</p>d</b> e", ["a b c", "d e"]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
    ("<title>t</title><script>if (a<b) '</p>'</script><style>p{}</style><p>x<!-- <p>no</p> -->y", ["xy"]),
    ("<p title='a>b' data-x=\"c>d\">x</p>", ["x"]), ("1 < 2 and 3 > 2 <p>&lt;p&gt;", ["1 < 2 and 3 > 2", "<p>"]),
    ("<p>&eacute;&#233;&#xe9;&nbsp;&unknown; &am &ampb", ["ééé &unknown; &am &b"]),
    ("<p>a</p><script>never closed <p>b", ["a"]), ("<p>a<!-- never closed <p>b", ["a"]), ("<p>a<a href=x", ["a"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("<P>A</P><SCRIPT>x</SCRIPT><DIV>B</DIV>", ["A", "B"]),
    ("</p></div>x</ul>", ["x"]), ("<span>a</span><em>b</em>c", ["abc"]), ("<p>a<button>b</button>c", ["a b c"]),
    ("<?xml version='1'?><!DOCTYPE html><p>a<![CDATA[b]]>", ["a"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_ancestors():
    b = T.blocks('<div id="side-bar" class="adBox x1"><nav role=navigation><a href=#>Home</a> now</nav></div>')[0]
    assert T.ancestor_features(b.frame)[:1] == ["box:tag:nav"]
    assert {"tag:nav", "name:navigation", "tag:div", "name:side", "name:bar", "name:ad", "name:box"} <= set(T.ancestor_features(b.frame))
    assert b.linked == 4 and "links:3" not in T.text_features(b) and "cue:home" in T.text_features(b)
    assert "hidden" in T.tag_features("p", ' style="display: none"') and "hidden" in T.tag_features("p", " hidden")
    assert "hidden" not in T.tag_features("p", ' data-hidden="no"')


def score(m, found, states):
    s = m.start[states[0]] + sum(m.emission(b) for b, y in zip(found, states) if y)
    return s + sum(m.moves[a, b] for a, b in zip(states, states[1:]))


def test_decoding_finds_the_best_sequence():
    r = random.Random(2)
    found = T.blocks("".join(f"<{t}>{w}</{t}>" for t, w in [("h1", "Title"), ("p", "one two."), ("div", "ad"), ("p", "more"), ("li", "x"), ("p", "end.")]))
    for _ in range(30):
        weights = {f: r.gauss(0, 1) for b in found for f in T.text_features(b) + T.ancestor_features(b.frame)}
        m = T.Model(weights, np.array([r.gauss(0, 1) for _ in "ab"]), np.array([[r.gauss(0, 2) for _ in "ab"] for _ in "ab"]))
        for b in found:
            f = b.frame
            while f:
                f.score = f.inside = None
                f = f.up
        best = max(itertools.product([0, 1], repeat=len(found)), key=lambda y: score(m, found, y))
        assert tuple(map(int, m.decode(found))) == best


def test_gradient_is_that_of_the_likelihood():
    pages = [T.blocks(p) for p in ("<h1>A</h1><p>b c.</p><div class=ad>d</div>", "<p>x</p>", "<nav><a>m</a></nav><p>y z.</p>")]
    labelled = sorted(((b, [x.frame.tag in ("h1", "p") for x in b]) for b in pages), key=lambda x: len(x[0]))
    names = {}
    batch = T._Batch(labelled, names)
    r = np.random.default_rng(0)
    theta = r.normal(size=len(names) + 6)

    def likelihood(theta):
        total = 0.0
        m = T.Model({f: theta[i] for f, i in names.items()}, theta[-6:-4], theta[-4:].reshape(2, 2))
        for b, y in labelled:
            for x in b:
                f = x.frame
                while f:
                    f.score = f.inside = None
                    f = f.up
            total += score(m, b, [int(v) for v in y]) - math.log(sum(math.exp(score(m, b, s)) for s in itertools.product([0, 1], repeat=len(b))))
        return total

    got = batch.gradient(theta)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert got[i] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-5, abs=1e-4)


def plain(page):
    """What the given pages hold, read off their one layout."""
    inside = re.search("<article>(.*?)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def model(spark):
    return T.train(spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 5 <> 0"))


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op13_html_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.n_chars, r.url) == (plain(pages[r.page_id].html), len(r.text), pages[r.page_id].url)


def test_held_out_layouts(spark, model):
    """Pages that the model hasn't seen, in layouts of another seed."""
    held = [x for r in spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 5 = 0").collect() if (x := T.by_markup(r.html))]
    pools = [([b.text for b, y in zip(*x) if y], [b.text for b, y in zip(*x) if not y]) for x in held]
    r, other = random.Random(77), [t for _, o in pools for t in o]
    right = total = 0
    for main, _ in pools * 4:
        found, y = T.rebuilt(main, other, r)
        right += sum(a == b for a, b in zip(model.decode(found), y))
        total += len(y)
    assert right / total > 0.985


def test_hand_written_layout(model):
    page = """<!doctype html><html><head><title>Rivers of the north - Daily</title></head><body class="home">
    <header><a href="/">The Daily</a><nav><ul><li><a href="/a">World</a><li><a href="/b">Sport</a></ul></nav></header>
    <div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>
    <div id="wrapper"><div class="post-content"><h1>Rivers of the north</h1>
    <p>The river rises in the <a href="/h">hills</a> and runs west for a long way.</p>
    <div class="ad-slot">Buy our boots today.</div>
    <p>Its valley is &quot;wide&quot;
       &amp; green, and few people live there.</p><ul><li>It has three arms.</li></ul></div>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten lakes</a></li><li><a href="/2">Old maps</a></li></ul></aside>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>I went there last year and liked it a lot.</p></div></section>
    <form class="newsletter"><label>Email</label><input><button>Subscribe</button></form></div>
    <footer><p>&copy; The Daily. All rights reserved.</p></footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert model.extract(page) == ("Rivers of the north\nThe river rises in the hills and runs west for a long way.\n"
                                   'Its valley is "wide" & green, and few people live there.\nIt has three arms.')


def test_awkward_rows(spark, model):
    page = "<article><h1>A title here</h1><p>Some text with words in it.</p></article>"
    long = "<article>" + "<p>word and word again.</p>" * 50_000 + "</article>"
    rows = [(1, None, "u", "t"), (1, "", None, "t"), (None, page, "v", None), (2, page, "v", None), (2, page, "v", None), (3, long, None, None),
            (4, "<script>x", "", ""), (5, "<" * 100_000, None, None), (6, "<div>" * 20_000 + "x", None, None)]
    df = spark.createDataFrame(rows, "page_id int, html string, url string, text string").repartition(3)
    got = {(r.page_id, r.url): r.text for r in T.extract(df, model, carry=("url",)).collect()}
    assert got[1, "u"] == got[1, None] == got[4, ""] == ""
    assert got[None, "v"] == got[2, "v"] == "A title here\nSome text with words in it."
    assert got[3, None].count("\n") == 49_999
    assert T.extract(df, model).count() == len(rows) and T.extract(df.limit(0), model).collect() == []


def test_without_labelled_pages(spark):
    m = T.train(spark.createDataFrame([(1, "<p>x"), (2, None)], "page_id int, html string"))
    assert m.extract("<nav><a>Menu</a></nav><main><h1>Some words here</h1><p>More of the words are here.</p></main>") == "Some words here\nMore of the words are here."
    assert T.train(spark.createDataFrame([], "page_id int, html string")).weights == m.weights
