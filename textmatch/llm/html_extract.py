"""The main text of web pages: gradient-boosted trees over DOM nodes, decoded as a hierarchy.

Every block element and run of text is a node with features of its tag and attribute words, its
depth, the text, links and paragraphs below it, and its place among its siblings. A model of
boosted trees (fitted by Spark ML) gives the odds that a node belongs to the article. Decoding
chooses, by a pass up and a pass down the tree, the most likely assignment in which no node of
the article lies inside one that is not.

The model is fitted on ``SAMPLE_PAGES`` pages at most (those with the least hash of id and url)
that mark their article with ``article`` or ``main``. Each gives labelled pages: itself, and
``VARIANTS`` pages composed anew of its article and of menus, notices, adverts, sidebars, forms,
reader comments and footers around it, with other tags and attribute words or none. That is all
the model sees; extraction runs over every page and whole pages. Trees and texts stay with
their rows: nothing is shuffled.

Defined results: null and empty pages give an empty text, as does a page without an article.
Malformed markup never fails. Repeated rows are extracted each; an empty table gives no rows.
Other columns pass unchanged, those named as a result are replaced. If no page marks its
article, the composed pages alone, of all the paragraphs there are, teach the model.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from functools import lru_cache
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, scratch_path
from textmatch.llm.common import rows_with, table
from textmatch.llm.html_tree import Node, parse

SAMPLE_PAGES, VARIANTS = 160, 4
TREES, DEPTH, SEED = 16, 5, 7

# Attribute words that hint at a role. Fixed values.
HINTS = {
    "article": "article content main post entry story body text blog maincontent articlebody page prose",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager tabs topbar links skip",
    "header": "header masthead banner logo branding top hero toolbar",
    "footer": "footer foot bottom copyright colophon legal imprint credits contentinfo",
    "sidebar": "sidebar aside side widget rail complementary secondary column related recommended popular trending more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense adbox teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog warning message privacy disclaimer paywall",
    "form": "form search login signup subscribe subscription newsletter register contact signin input",
    "comments": "comment comments reply replies respond discussion disqus thread reviews feedback reader responses",
    "share": "share sharing social tools tags meta byline author toolbar print rating follow",
}
_HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
_LONG_HINTS = sorted((w for w in _HINT_OF if len(w) >= 5), key=lambda w: (-len(w), w))


@lru_cache(maxsize=20_000)
def hint_of(token: str) -> int | None:
    """The role of an attribute word, or of a longer word that begins or ends with one."""
    known = _HINT_OF.get(token)
    if known is None:
        for word in _LONG_HINTS:
            if token.startswith(word) or token.endswith(word):
                return _HINT_OF[word]
    return known


TAGS = {
    "article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "hgroup": 2, "footer": 3, "aside": 4,
    "form": 5, "fieldset": 5, "legend": 5, "dialog": 5, "ul": 6, "ol": 6, "dl": 6, "li": 7, "dt": 7,
    "dd": 7, "p": 8, "blockquote": 8, "pre": 8, "h1": 9, "h2": 9, "h3": 9, "h4": 9, "h5": 9, "h6": 9,
    "table": 10, "tr": 10, "td": 10, "th": 10, "tbody": 10, "#text": 11,
}
N_TAGS, N_HINTS = 13, len(HINTS)
BAD_TAGS = (1, 3, 4, 5)
NUMBERS = (
    "depth", "log_chars", "link_share", "log_nodes", "log_paragraphs", "chars_per_leaf", "ends_sentence",
    "place", "log_siblings", "like_siblings", "share_of_parent", "share_of_page", "hidden",
    "in_article", "in_header", "in_bad_tag", "in_bad_hint", "parent_chars_per_leaf", "parent_link_share",
)
WIDTH = N_TAGS + N_HINTS + len(NUMBERS)
_SENTENCE_END = re.compile(r"[.!?…:;。！？]['\"”»)]*$")


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node after the first."""
    n = len(nodes)
    chars, links, leaves, count, paragraphs, ends = ([0] * n for _ in range(6))
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        count[i] += 1
        if node.tag == "#text":
            chars[i], links[i], leaves[i] = len(node.text), node.link_chars, 1
            ends[i] = 1 if _SENTENCE_END.search(node.text) else 0
        elif node.tag == "p":
            paragraphs[i] += 1
        p = node.parent
        chars[p] += chars[i]
        links[p] += links[i]
        leaves[p] += leaves[i]
        count[p] += count[i]
        paragraphs[p] += paragraphs[i]
        ends[p] += ends[i]
    total = max(chars[0], 1)
    rows = np.zeros((n - 1, WIDTH), np.float32)
    kinds = [TAGS.get(x.tag, 12) for x in nodes]
    alike: list[dict[int, int]] = [{} for _ in range(n)]
    for i in range(1, n):
        mine = alike[nodes[i].parent]
        mine[kinds[i]] = mine.get(kinds[i], 0) + 1
    flags = [(0, 0, 0, 0)] * n
    place = [0] * n
    for i, node in enumerate(nodes):
        for k, child in enumerate(node.children):
            place[child] = k
    for i in range(1, n):
        node, p = nodes[i], nodes[i].parent
        row = rows[i - 1]
        kind = kinds[i]
        row[kind] = 1
        hints = {hint_of(t) for t in node.tokens} - {None}
        for h in hints:
            row[N_TAGS + h] = 1
        article, header, bad_tag, bad_hint = flags[p]
        siblings = len(nodes[p].children)
        row[N_TAGS + N_HINTS :] = (
            node.depth, math.log1p(chars[i]), links[i] / max(chars[i], 1), math.log1p(count[i]),
            math.log1p(paragraphs[i]), math.log1p(chars[i] / max(leaves[i], 1)),
            ends[i] / max(leaves[i], 1), place[i] / siblings, math.log1p(siblings),
            alike[p][kind] / siblings, chars[i] / max(chars[p], 1), chars[i] / total, node.hidden,
            article, header, bad_tag, bad_hint, math.log1p(chars[p] / max(leaves[p], 1)),
            links[p] / max(chars[p], 1),
        )
        flags[i] = (
            int(article or kind == 0 or 0 in hints),
            int(header or kind == 2),
            int(bad_tag or kind in BAD_TAGS or node.hidden),
            int(bad_hint or bool(hints - {0})),
        )
    return rows


class Trees:
    """Boosted regression trees as flat arrays."""

    def __init__(self, feature, threshold, left, right, value, roots, weights):
        self.feature, self.threshold = np.array(feature), np.array(threshold)
        self.left, self.right, self.value = np.array(left), np.array(right), np.array(value)
        self.roots, self.weights = roots, weights

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(rows), root)
            for _ in range(DEPTH):
                inner = self.left[at] >= 0
                small = rows[every, self.feature[at]] <= self.threshold[at]
                at = np.where(inner, np.where(small, self.left[at], self.right[at]), at)
            margin += weight * self.value[at]
        return 2 * margin  # the loss of Spark ML's classifier is in twice the margin


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """Which nodes are in the article: the likeliest choice closed under taking parents."""
    n = len(nodes)
    odds = np.clip(np.concatenate([[0.0], log_odds]), -12, 12)
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    inside, outside = yes, no
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        inside[p] += max(inside[i], outside[i])
        outside[p] += outside[i]
    chosen = [True] * n
    for i in range(1, n):
        chosen[i] = chosen[nodes[i].parent] and inside[i] > outside[i]
    return chosen


def main_text(nodes: list[Node], log_odds: np.ndarray) -> str:
    chosen = decode(nodes, log_odds)
    return "\n\n".join(x.text for x, c in zip(nodes, chosen) if c and x.tag == "#text")


# --- labelled pages ------------------------------------------------------------------------


def _label_marked(nodes: list[Node]) -> bool:
    """Label a page by its own ``article`` or ``main`` elements; whether it has one."""
    marked = [i for i, x in enumerate(nodes) if x.tag == "article"] or [
        i for i, x in enumerate(nodes) if x.tag == "main"
    ]
    for i in marked:
        nodes[i].label = 1
        p = nodes[i].parent
        while p > 0:
            nodes[p].label, p = 1, nodes[p].parent
    for i in range(1, len(nodes)):
        if nodes[i].label is None:
            above = nodes[i].parent
            inherited = nodes[above].label == 1 and any_above(nodes, i, set(marked))
            nodes[i].label = int(inherited and nodes[i].tag not in ("nav", "aside", "footer", "form"))
    return bool(marked)


def any_above(nodes: list[Node], i: int, marked: set[int]) -> bool:
    while i > 0:
        if i in marked:
            return True
        i = nodes[i].parent
    return False


def _inherit(nodes: list[Node]) -> None:
    """Below a labelled element its label holds; above, a page may hold both."""
    for i in range(1, len(nodes)):
        if nodes[i].label is None:
            above = nodes[nodes[i].parent].label
            nodes[i].label = 1 if above is None else above


def compose(paragraphs: list[str], title: str, rng: random.Random) -> str:
    """A page around ``paragraphs`` with the usual furniture; data-label marks what is what."""
    words = " ".join(paragraphs).split() or ["text"]

    def some(low: int, high: int) -> str:
        at, size = rng.randrange(len(words)), rng.randint(low, high)
        return escape(" ".join(words[at : at + size])) or "text"

    bare = rng.random() < 0.25  # a page without telling elements or attributes

    def attributes(role: str) -> str:
        how = rng.random()
        if bare or how < 0.2:
            return ""
        word = rng.choice(HINTS[role].split())
        if how < 0.4:
            word += rng.choice(["-box", "-wrap", "_list", " wide", "-area", "list", "block"])
        return f' {rng.choice(["class", "id", "class"])}="{word}"'

    def box(role: str, tags: str, inner: str) -> str:
        tag = "div" if bare else rng.choice(tags.split())
        marks = attributes(role)
        if tag in ("div", "section") and not marks and not bare:
            marks = f' class="{rng.choice(HINTS[role].split())}"'
        return f'<{tag}{marks} data-label="0">{inner}</{tag}>'

    def link_list(low: int, high: int) -> str:
        return "<ul>" + "".join(
            f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(rng.randint(low, high))
        ) + "</ul>"

    def remarks() -> str:
        tag = rng.choice(["div", "div", "li", "article"])
        one = lambda: f'<{tag}{attributes("comments")}><p><b>{some(1, 2)}</b></p><p>{some(4, 50)}.</p></{tag}>'
        return f"<h3>{some(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 4)))

    furniture = {
        "menu": lambda: box("menu", "nav nav div", link_list(3, 9)),
        "header": lambda: box("header", "header header div", rng.choice([f'<a href="/">{some(1, 3)}</a>', f"<h1>{some(1, 4)}</h1>"]) + f"<p>{some(2, 8)}.</p>"),
        "advert": lambda: box("advert", "div div aside section", rng.choice([some(3, 14), f"<p>{some(3, 20)}.</p>"])),
        "notice": lambda: box("notice", "div div section dialog", f"<p>{some(6, 30)}.</p>"),
        "sidebar": lambda: box("sidebar", "aside aside div", f"<h3>{some(1, 3)}</h3>" + rng.choice([link_list(2, 6), f"<p>{some(8, 40)}.</p>"])),
        "form": lambda: box("form", "form form div", f"<p>{some(2, 10)}</p><label>{some(1, 3)}</label><input>"),
        "share": lambda: box("share", "div ul", link_list(2, 5)),
        "comments": lambda: box("comments", "section div ol", remarks()),
        "footer": lambda: box("footer", "footer footer div", f"&copy; {some(1, 10)} &middot; {some(2, 14)}."),
    }
    first = ("menu", "share") if bare else ("header", "menu", "notice", "advert", "sidebar")
    then = ("share", "menu") if bare else ("share", "comments", "sidebar", "advert", "form", "notice")
    before = [furniture[k]() for k in first if rng.random() < 0.6]
    after = [furniture[k]() for k in then if rng.random() < 0.5]
    after += [furniture["footer"]()] if rng.random() < 0.9 and not bare else []
    rng.shuffle(before)
    body = [f"<h1>{escape(title)}</h1>"] if title and rng.random() < 0.8 else []
    if body and not bare and rng.random() < 0.2:
        body = [f"<header>{body[0]}</header>"]
    for text in paragraphs:
        style = rng.random()
        if style < 0.8:
            body.append(f"<p>{escape(text)}</p>")
        elif style < 0.88:
            body.append(f"<p><b>{escape(text)}<br><p>")
        elif style < 0.92:
            body.append(f"<h2>{escape(' '.join(text.split()[:6]))}</h2><p>{escape(text)}</p>")
        elif style < 0.95:
            body.append(f"<blockquote>{escape(text)}</blockquote>")
        elif style < 0.97:
            body.append(f"<p>{escape(text)}</p><figure><img src=x><figcaption>{some(3, 12)}.</figcaption></figure>")
        else:
            items = "".join(f"<li>{escape(x)}</li>" for x in text.split(". "))
            body.append(f"<ul>{items}</ul>")
        if rng.random() < 0.04 and not bare:
            body.append(furniture[rng.choice(["advert", "share", "notice", "form"])]())
    tag = "div" if bare else rng.choice(["article", "article", "main", "div", "section"])
    marks = attributes("article") if bare or tag != "div" else f' class="{rng.choice(HINTS["article"].split())}"'
    main = f'<{tag}{marks} data-label="1">{"".join(body)}</{tag}>'
    parts = [*before, main, *after]
    if rng.random() < 0.4:
        parts = [f'<div class="{rng.choice(["wrapper", "container", "site", "row"])}">', *parts, "</div>"]
    return f"<html><head><title>{escape(title)}</title></head><body>{''.join(parts)}</body></html>"


def labelled_pages(html: str, variants: int = VARIANTS) -> list[list[Node]]:
    """The page as it labels itself, and pages composed of its text."""
    nodes = parse(html)
    marked = _label_marked(nodes)
    leaves = [x for x in nodes if x.tag == "#text" and (x.label or not marked)]
    paragraphs = [x.text for x in leaves if nodes[x.parent].tag not in ("h1", "li", "a")]
    titles = [x.text for x in leaves if nodes[x.parent].tag == "h1"]
    out = [nodes] if marked else []
    if paragraphs:
        rng = random.Random(zlib.crc32(html.encode("utf-8", "replace")))
        for _ in range(variants):
            count = rng.choice([len(paragraphs), len(paragraphs), rng.randint(1, len(paragraphs))])
            made = parse(compose(paragraphs[:count], titles[0] if titles else "", rng), labels=True)
            _inherit(made)
            out.append(made)
    return out


def training_rows(
    pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES
) -> DataFrame:
    """(label, features) of the nodes of the labelled pages of a bounded sample."""
    order = F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns if c != html_col])
    chosen = (
        pages.where(F.length(html_col) > 0)
        .select(order.alias("order"), F.col(html_col).alias("html"))
        .orderBy("order", F.md5("html"))
        .limit(sample)
    )

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for html in columns[0].to_pylist():
            made = []
            for nodes in labelled_pages(html):
                labels = [float(x.label) for x in nodes[1:]]
                made += [[y, *row] for y, row in zip(labels, features(nodes).tolist())]
            out.append(made)
        return [pa.array(out, pa.list_(pa.list_(pa.float64())))]

    rows = T.ArrayType(T.ArrayType(T.DoubleType()))
    found = rows_with(chosen, ["html"], [T.StructField("rows", rows)], run, carry=[])
    return found.select(F.explode("rows").alias("r")).select(
        F.element_at("r", 1).alias("label"), F.slice("r", 2, WIDTH).alias("features")
    )


def fit_trees(rows: DataFrame) -> Trees | None:
    """Fit the model with Spark ML and read its trees back; None without rows of both labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    rows = materialize(rows, "nodes")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = rows.select("label", array_to_vector("features").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=SEED).fit(vectors)
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    nodes.sort(key=lambda r: (r.treeID, r.id))
    start: dict[int, int] = {}
    for i, r in enumerate(nodes):
        start.setdefault(r.treeID, i)
    return Trees(
        feature=[max(r.split.featureIndex, 0) for r in nodes],
        threshold=[
            r.split.leftCategoriesOrThreshold[0] if r.split.leftCategoriesOrThreshold else 0.0
            for r in nodes
        ],
        left=[start[r.treeID] + r.leftChild if r.leftChild >= 0 else -1 for r in nodes],
        right=[start[r.treeID] + r.rightChild if r.rightChild >= 0 else -1 for r in nodes],
        value=[r.prediction for r in nodes],
        roots=[start[t] for t in sorted(start)],
        weights=list(model.treeWeights),
    )


def extract(pages: DataFrame, trees: Trees | None, html_col: str = "html", carry=None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    handle = pages.sparkSession.sparkContext.broadcast(trees)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        model = handle.value
        trees_of = [parse(html) for html in columns[0].to_pylist()]
        rows = np.concatenate([np.empty((0, WIDTH), np.float32), *map(features, trees_of)])
        odds = model.log_odds(rows) if model is not None else np.zeros(len(rows))
        texts, at = [], 0
        for nodes in trees_of:
            texts.append(main_text(nodes, odds[at : at + len(nodes) - 1]))
            at += len(nodes) - 1
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return rows_with(pages, [html_col], fields, run, carry, slice_rows=64)


def extract_pages(pages: DataFrame, html_col: str = "html", carry=None) -> DataFrame:
    """Fit on a bounded sample of ``pages``, extract all of them."""
    return extract(pages, fit_trees(training_rows(pages, html_col)), html_col, carry)


def op8_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages, carry=["page_id", "url"])
