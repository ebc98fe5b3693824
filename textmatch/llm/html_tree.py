"""A forgiving reader of HTML: block elements as a tree, runs of text as its leaves.

Only elements that make blocks are nodes; inline markup is transparent, apart from links, whose
characters are counted. A block that may not be nested in its like closes the open one (a
paragraph by any block, list items, table cells); an end tag closes up to its start or is
ignored. Scripts, styles, titles, controls, graphics and the like and comments have no text. One
of them that isn't closed, or not within its block, has none up to the next block; one that
closes itself has none at all. Only a script or style that is never closed goes on to the end of
the page. Character references are decoded, white space within a run becomes one blank, and runs
without text are no leaves.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape

# Elements of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title".split())
SILENT = "noscript template svg iframe select button datalist annotation"
_SILENT_TAGS = frozenset(SILENT.split())
CLOSED_BY_ITSELF = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
# Names the label of an element in composed training pages; elsewhere it is as any attribute.
LABEL = "data-label"
SCOPES = frozenset("ul ol menu dl table body html article section div".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_SILENT = re.compile(rf"<(/?)({SILENT.replace(' ', '|')})(?=[\s/>])[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    """An element, or (``tag`` '#text') a run of text."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    hidden: bool = False
    label: int | None = None
    text: str = ""
    link_chars: int = 0
    children: list[int] = field(default_factory=list)


def _attributes(node: Node, source: str, labels: bool) -> None:
    words: list[str] = []
    for match in _ATTRIBUTE.finditer(source):
        name, value = match[1].lower(), unescape((match[2] or "").strip("\"'"))
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += _NAME.findall(_CAMEL.sub(" ", value).lower())
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            node.hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.hidden = True
        elif labels and name == LABEL and value in ("0", "1"):
            node.label = int(value)
    node.tokens = tuple(words)


def _silent_ends(html: str) -> dict[int, int]:
    """Where each silent element ends that is closed within the block it is in, by its start.

    A block's end tag inside it must not close a block from before it, and a graphic without
    foreign content holds no block at all. One pass finds the matching tags, a second one,
    in which each start waits until something speaks against it, the elements that fail.
    """
    pairs, starts = [], {}
    for match in _SILENT.finditer(html):
        tag = match[2].lower()
        if not match[1]:
            if not match[0].endswith("/>"):
                starts.setdefault(tag, []).append(match)
        elif starts.get(tag):
            start = starts[tag].pop()
            pairs.append((start.end(), match.start(), match.end(), start.start(), tag))
    if not pairs:
        return {}
    pairs.sort()
    foreign = [x.start() for x in re.finditer("foreignobject", html, re.I)]
    broken: dict[int, int] = {}  # where a block breaks out, by the end of the start tag
    waiting: list[int] = []  # ends of start tags, rising
    graphics: list[int] = []
    opened: dict[str, list[int]] = {}
    k = 0
    for match in _TAG.finditer(html):
        name = match[2].lower()
        if name not in BLOCKS:
            continue
        while k < len(pairs) and pairs[k][0] <= match.start():
            inner, low, _, _, tag = pairs[k]
            waiting.append(inner)
            if tag == "svg":
                at = bisect_left(foreign, inner)
                if at == len(foreign) or foreign[at] >= low:
                    graphics.append(inner)
            k += 1
        for inner in graphics:
            broken.setdefault(inner, match.start())
        graphics.clear()
        if not match[1]:
            opened.setdefault(name, []).append(match.start())
            continue
        begun = opened[name].pop() if opened.get(name) else -1
        while waiting and waiting[-1] > begun:
            broken.setdefault(waiting.pop(), match.start())
    return {start: end for inner, low, end, start, _ in pairs if broken.get(inner, low) >= low}


class _Open:
    """The open elements, innermost last, and where each kind of them is."""

    def __init__(self):
        self.nodes = [0]
        self.tags = [""]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in SCOPES:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def innermost(self, tags: tuple[str, ...], scoped: bool) -> int:
        """The place of the innermost of ``tags``, or 0; if ``scoped``, in the innermost scope."""
        at = max(self.places[t][-1] if self.places.get(t) else 0 for t in tags)
        return at if not scoped or not self.scopes or at >= self.scopes[-1] else 0

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()


def parse(html: str | None, labels: bool = False) -> list[Node]:
    """The nodes in page order; the first is the page. Parents come before their children.

    Only with ``labels``, for pages composed here, are labels read. The time grows with the
    length of the page, however its elements are nested.
    """
    nodes = [Node("#page", -1, 0)]
    open_ = _Open()
    text: list[str] = []
    links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if text:
            run = " ".join(unescape("".join(text)).split())
            if run:
                parent = open_.nodes[-1]
                leaf = Node("#text", parent, nodes[parent].depth + 1, text=run)
                leaf.link_chars = min(link_chars, len(run))
                nodes[parent].children.append(len(nodes))
                nodes.append(leaf)
            text.clear()
        link_chars = 0

    def close(tags: tuple[str, ...], scoped: bool = False) -> None:
        found = open_.innermost(tags, scoped)
        if found:
            flush()
            open_.cut(found)

    at = 0
    html = html or ""
    silent_ends = None
    endless: set[str] = set()  # raw elements that have no end tag from here on
    silent = False  # in an element without text that isn't closed, until the next block
    while match := _TOKEN.search(html, at):
        if match.start() > at and not silent:
            text.append(html[at : match.start()])
            if links:
                link_chars += match.start() - at
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            continue
        tag = tag.lower()
        ends = bool(match[1] or match[4])
        source = match[3] if match[2] else match[6]
        if tag in RAW or tag in _SILENT_TAGS:
            if ends:
                continue
            text.append(" ")
            itself = source.endswith("/")
            if tag in RAW:
                end = None if tag in endless else _RAW_END[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style") and not itself:
                    at = len(html)
                else:
                    endless.add(tag)
                    silent = silent or not itself
            elif not itself:
                if silent_ends is None:
                    silent_ends = _silent_ends(html)
                end = silent_ends.get(match.start(), -1)
                if end >= at:
                    at = end
                else:
                    silent = True
            continue
        if tag == "a":
            links = 0 if ends else 1
        elif tag in ("br", "hr", "img", "input"):
            text.append(" ")
        if tag not in BLOCKS:
            continue
        silent = False
        if ends:
            close((tag,))
            continue
        flush()
        close(("p",), True)
        if tag in CLOSED_BY_ITSELF:
            close(CLOSED_BY_ITSELF[tag], True)
        if tag == "hr":
            continue
        parent = open_.nodes[-1]
        node = Node(tag, parent, nodes[parent].depth + 1)
        if source and source.strip("/ "):
            _attributes(node, source, labels)
        nodes[parent].children.append(len(nodes))
        open_.push(len(nodes), tag)
        nodes.append(node)
    if at < len(html) and not silent:
        text.append(html[at:])
    flush()
    return nodes
