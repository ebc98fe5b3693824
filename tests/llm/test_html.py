from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.llm import html_extract
from textmatch.llm.html_extract import (
    Trees,
    compose,
    decode,
    extract,
    features,
    fit_trees,
    labelled_pages,
    main_text,
    training_rows,
)
from textmatch.llm.html_tree import Node, parse


def leaves(html):
    return [x.text for x in parse(html) if x.tag == "#text"]


def test_reader():
    assert leaves("<p>a<br>b <b>c</b>&amp;&nbsp;d</p>e") == ["a b c& d", "e"]
    assert leaves("<p>one<p>two<div>three</div>four") == ["one", "two", "three", "four"]
    assert leaves("<p><b>x<br><p>y</p></p>z") == ["x", "y", "z"]
    assert leaves("a<script>var x='<p>no</p>';</script>b<!-- <p>no</p> -->c<style>p{}</style>") == ["a bc"]
    assert leaves("<head><title>t</title></head><body>x<textarea>no</textarea></body>") == ["x"]
    assert leaves("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert leaves("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert leaves('<p title="a > b">x</p>') == ["x"] and leaves("1 < 2 and <3") == ["1 < 2 and <3"]
    for broken in ("<", "<p", "<p a='", "</", "<!--", "<script>x", "<p ''''><", "&#xZZ;&bogus", "<a" * 2000):
        parse(broken)
    assert leaves(None) == leaves("") == []
    deep = parse("<div>" * 20_000 + "x")
    assert len(deep) == 20_002 and len(decode(deep, np.zeros(len(deep) - 1))) == len(deep)


def test_elements_without_text_take_no_other_text():
    assert leaves("<html><head><title>x</title><body><article><p>a</p>") == ["a"]
    assert leaves("<article><p>a <svg/> b</p><p>rest") == ["a b", "rest"]
    for tag in ("iframe", "select", "button", "noscript", "template", "svg", "textarea", "title"):
        assert leaves(f"<p>a</p><{tag}>no<p>b</p><div>c</div>") == ["a", "b", "c"]
        assert leaves(f"<p>a<{tag} />b</p><p>c") == ["a b", "c"]
        assert leaves(f"<p>a<{tag}>no</{tag}>b</p><p>c") == ["a b", "c"]
    assert leaves("<div><button>no</div><p>b</p><button><div>no</div></button>c") == ["b", "c"]
    assert leaves("<p>a</p><svg><p>b</p></svg><p>c</p><svg><g><svg>no</svg>no</g></svg>") == ["a", "b", "c"]
    assert leaves("<p>x <math><mi>y</mi></math> z</p><object><p>in</p></object>") == ["x y z", "in"]
    assert leaves("<object data=x><p>rest") == ["rest"]


def test_attributes():
    nodes = parse('<div class="sideBar main-col" id=top hidden><p style="display: none">x</div>')
    assert nodes[1].tokens == ("side", "bar", "main", "col", "top") and nodes[1].hidden
    assert nodes[2].hidden and features(nodes).shape == (3, html_extract.WIDTH)


def best_by_trying_all(nodes, odds):
    """The highest sum of log odds over choices closed under taking parents."""
    n = len(nodes)
    best = None
    for bits in range(1 << (n - 1)):
        chosen = [True] + [bool(bits >> i & 1) for i in range(n - 1)]
        if all(chosen[nodes[i].parent] or not chosen[i] for i in range(1, n)):
            score = sum(odds[i - 1] for i in range(1, n) if chosen[i])
            if best is None or score > best[0] + 1e-9:
                best = (score, chosen)
    return best


def test_decoding_is_the_best_closed_choice():
    rng = np.random.default_rng(1)
    for _ in range(60):
        nodes = [Node("#page", -1, 0)]
        for i in range(1, rng.integers(2, 11)):
            nodes.append(Node("div", int(rng.integers(0, i)), 0))
        odds = rng.normal(0, 3, len(nodes) - 1)
        chosen = decode(nodes, odds)
        score, _ = best_by_trying_all(nodes, odds)
        assert all(chosen[x.parent] or not c for x, c in list(zip(nodes, chosen))[1:])
        assert sum(o for o, c in zip(odds, chosen[1:]) if c) == pytest.approx(score)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return fit_trees(training_rows(pages, sample=40))


def article(html):
    """The blocks of the article of the given pages, by patterns."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
    blocks = (re.sub(r"<[^>]+>", "", x) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def test_given_pages(pages, trees):
    found = extract(pages, trees).collect()
    assert len(found) == pages.count()
    assert all(r.text == article(r.html) and r.n_chars == len(r.text) for r in found)


def test_held_out_composed_pages(pages, trees):
    """Pages of other articles, in templates that the model has not seen."""
    wrong = total = 0
    for r in pages.orderBy(F.xxhash64("page_id", "url").desc()).limit(40).collect():
        for nodes in labelled_pages(r.html + " ", variants=6)[1:]:
            chosen = decode(nodes, trees.log_odds(features(nodes)))
            pairs = [(c, x.label) for c, x in zip(chosen, nodes) if x.tag == "#text"]
            total += len(pairs)
            wrong += sum(bool(a) != bool(b) for a, b in pairs)
    assert wrong <= 0.01 * total


def test_an_unseen_page(trees):
    nodes = parse(
        """<body><header><h1>Site</h1><p>News every day.</p></header>
        <div id="nav-wrap"><a href=x>Home</a> <a href=y>About</a></div>
        <div class="cookie-banner"><p>We use cookies to improve this site. Accept.</p></div>
        <div class="container"><div class="main-col"><h1>The title</h1>
        <p>The first paragraph of the article says a lot in many words, and goes on.</p>
        <div class="advertisement">Buy now. Cheap.</div>
        <p>The second paragraph ends the story with some more words &amp; that is all.</p></div>
        <aside><h3>Popular</h3><ul><li><a href=1>Ten things</a></li></ul></aside></div>
        <div id="comments"><p>I loved this article very much, it was great, thanks.</p></div>
        <footer>Copyright</footer></body>"""
    )
    assert main_text(nodes, trees.log_odds(features(nodes))) == (
        "The title\n\nThe first paragraph of the article says a lot in many words, and goes on."
        "\n\nThe second paragraph ends the story with some more words & that is all."
    )


def test_edges(spark, trees):
    schema = "page_id long, url string, html string, n_chars string, rows string"
    rows = [(1, None, None, "x", "y"), (2, "u", "", "x", "y"), (None, None, "<nav><a>m</a></nav>", "x", "y")]
    rows += [(3, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>", "x", "y")] * 2
    found = extract(spark.createDataFrame(rows, schema), trees).collect()
    by_id = {r.page_id: r.text for r in found}
    assert by_id[1] == by_id[2] == "" and by_id[3].count("word") == 20_000 and len(found) == 5
    assert {r.rows for r in found} == {"y"}
    empty = spark.createDataFrame([], schema)
    assert fit_trees(training_rows(empty)) is None
    assert html_extract.extract_pages(empty).count() == 0


def test_composed_pages_are_fully_labelled():
    import random

    made = parse(compose(["One two. Three.", "Four <five>."], "Title", random.Random(1)), labels=True)
    html_extract._inherit(made)
    assert all(x.label in (0, 1) for x in made[1:]) and {x.label for x in made[1:]} == {0, 1}


def test_trees_equal_the_fitted_model(spark, pages):
    """The odds of the flat arrays are those of the model itself."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = training_rows(pages, sample=6).cache()
    trees = fit_trees(rows)
    vectors = rows.select("label", array_to_vector("features").alias("features"))
    model = GBTClassifier(
        maxIter=html_extract.TREES, maxDepth=html_extract.DEPTH, maxBins=32, stepSize=0.3, seed=html_extract.SEED
    ).fit(vectors)
    got = model.transform(vectors).select(vector_to_array("rawPrediction")[1].alias("m"), vector_to_array("features").alias("f")).collect()
    ours = trees.log_odds(np.array([r.f for r in got], np.float32))
    assert np.corrcoef(ours, [r.m for r in got])[0, 1] > 0.99
    assert np.mean((ours > 0) == (np.array([r.m for r in got]) > 0)) > 0.995
    assert isinstance(trees, Trees)


def test_pages_with_labels_of_their_own(spark):
    marks = ['data-label="Price"', "data-label", 'data-label=""', 'data-label="1"', 'data-label="0"']
    cells = "".join(f"<td {m}>cell {i}</td>" for i, m in enumerate(marks))
    page = f"<html><body><article><p>One two.</p><table><tr>{cells}</tr></table></article></body></html>"
    assert leaves(page) == ["One two.", *[f"cell {i}" for i in range(5)]]
    assert {x.label for x in parse(page)} == {None}
    assert [x.label for x in parse("<div data-label=1><p data-label=x>a", labels=True)][1:3] == [1, None]
    pages = spark.createDataFrame([(1, "u", page), (2, "u", page), (3, "u", None)], "page_id long, url string, html string")
    rows = extract(pages, fit_trees(training_rows(pages)), carry=["page_id"]).orderBy("page_id").collect()
    assert len(rows) == 3 and rows[0].text == rows[1].text and rows[2].text == ""
    assert "One two." in rows[0].text and "cell 4" in rows[0].text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "</p>" * 20_000 + "x",
        "<svg><p>" * 20_000 + "x" + "</svg>" * 20_000,
        "<noscript></p>" * 20_000 + "</noscript>" * 20_000 + "x",
        "<title>a" * 30_000 + "<p>x",
        "<ul><li><div>" + "<blockquote>" * 20_000 + "<li></li>" * 20_000 + "x",
    ],
)
def test_time_grows_with_the_page(page):
    import time

    begin = time.process_time()
    assert leaves(page)[-1].endswith("x")
    assert time.process_time() - begin < 5
