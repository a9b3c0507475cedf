"""Main-text extraction: exact marginals, tolerant parsing, held-out pages."""

import html
import re
from itertools import product

import numpy as np
import pytest

from logwarden.llm import dom, extraction, labelled_pages
from logwarden.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return extraction.fit()


def test_marginals_equal_enumeration():
    page = "<body><div class=ad>Buy it.</div><article><p>One two.<p>Three</article></body>"
    nodes = dom.parse(page)
    known = {f: k for k, f in enumerate(sorted({f for names in extraction.features(nodes) for f in names}))}
    r = np.random.default_rng(3)
    weights, potentials = r.normal(size=len(known)), r.normal(size=(4, 2, 2))
    forest = extraction.Forest([nodes, dom.parse("<p>x")], known)
    got, pairs = forest.marginals(weights, potentials)
    n = len(nodes)
    own = np.zeros(forest.count)
    for node, feature, value in zip(forest.node, forest.feature, forest.value):
        own[node] += weights[feature] * value
    total, share, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in product((0, 1), repeat=n):
        score = sum(own[k] * labels[k] for k in range(n))
        score += sum(potentials[extraction._kind(nodes[k])][labels[nodes[k].parent]][labels[k]] for k in range(1, n))
        p = np.exp(score)
        total += p
        share += p * np.array(labels)
        for k in range(1, n):
            both[k, labels[nodes[k].parent], labels[k]] += p
    assert np.allclose(got[:n, 1], share / total)
    assert np.allclose(pairs[1:n], both[1:] / total)


def texts(page):
    return [n.text for n in dom.parse(page) if not n.tag]


def test_parsing():
    assert texts("a<b>b</b>c <i> d\n e</i><br>f") == ["abc d e f"]
    assert texts("<p>one<p>two<ul><li>x<li>y</ul>z") == ["one", "two", "x", "y", "z"]
    assert texts("<script>var a='</p>';</script>x<style>p{}</style><textarea><p>no</textarea>") == ["x"]
    assert texts("x &amp; &lt;b&gt; &#233;&nbsp;&copy; &amp;amp;") == ["x & <b> é © &amp;"]
    assert texts("<!-- <p>no</p> -->yes<!-- open <p>gone") == ["yes"]
    assert texts("<p title='a>b' data=\"<p>\">in</p>a < b <3 <") == ["in", "a < b <3 <"]
    assert texts("<title>t</title><p>x</b></p></div>y") == ["x", "y"]
    assert texts("<head><meta a=1><p>body without an edge") == ["body without an edge"]
    assert texts("<b><p>one</b> two</p>three") == ["one two", "three"]
    assert texts("") == texts("<div></div><!DOCTYPE html>") == []
    assert texts("<select><option>a<option>b</select><button>c</button><svg><text>d</text></svg>e") == ["e"]


PAGES = {
    """<html><body><div id="top-bar"><a href="/">Home</a> <a href="/n">News</a></div><div class="cookie-banner"><p>We use cookies.
    By staying you accept.</p><button>OK</button></div><div class="wrapper"><div class="post-content"><h1>Rivers</h1>
    <p>The river   rose, slowly.</p><div class="ad-box"><p>Buy a boat today! It is cheap, and good.</p></div><p>Then it fell &amp; froze.</p>
    <ul><li>Cold water.<li>Ice.</ul></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>Great text, thank you so much.</p></div></div>
    </div><div class="sidebar"><h3>Related</h3><ul><li><a href=1>Lakes</a><li><a href=2>Seas</a></ul></div>
    <form class="newsletter"><p>Get our letter.</p><input name=m></form><div id="footer">&copy; 2020 Rivers Inc.</div></body></html>""":
        "Rivers\nThe river rose, slowly.\nThen it fell & froze.\nCold water.\nIce.",
    """<header><h2>Site</h2><nav><ul><li><a href=a>A</a></ul></nav></header><main><h1>Short</h1><p>Yes.</p></main>
    <aside><p>Other stories, which are long enough to look like text, are here.</p></aside><footer><p>All rights reserved.</p></footer>""":
        "Short\nYes.",
    "<nav><a href=1>One</a></nav><footer>&copy; x</footer>": "",
    "": "",
}


def test_pages_by_hand(model):
    for page, want in PAGES.items():
        assert model.texts([page]) == [want]


def test_held_out_layouts(model):
    pages, exact = labelled_pages.pages(150, seed=4_242), 0
    for page in pages:
        nodes = dom.parse(page)
        want = "\n".join(n.text for n, k in zip(nodes, extraction.labels(nodes)) if k and not n.tag)
        exact += model.texts([page]) == [want]
    assert exact >= 0.95 * len(pages)


def by_rule(page):
    """The article of a given page, whose layout is known: blocks of ``article``."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>|<br>", found[1]) if found else []
    shown = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return "\n".join(b for b in shown if b)


def test_query_on_given_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op12_extraction"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    right = sum(got[p["page_id"]]["text"] == by_rule(p["html"]) for p in pages)
    assert right >= 0.99 * len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_edges(spark, model):
    page = next(iter(PAGES))
    long_page = "<article>" + "<p>Some words, and more of them.</p>" * 60_000 + "</article>"
    deep = "<div>" * 3_000 + "<p>deep</p>"
    rows = [(1, "u", page, "a", 1), (1, "u", page, "a", 1), (None, None, None, None, 2), (2, "u", "", "x", 3), (3, "v", long_page, "", 4),
            (4, "w", deep, "", 5), (5, "w", "<" * 20_000 + "<a href=\"" * 2_000, "", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(df.repartition(3), model).collect()
    assert len(got) == len(rows)
    found = {r["id"]: r for r in got}
    assert found[1]["text"] == PAGES[page] and found[None]["text"] == "" and found[None]["url"] is None
    assert found[3]["text"].count("\n") == 59_999 and found[3]["n_chars"] == len(found[3]["text"])
    assert extraction.extract(df.limit(0), model).collect() == []
