"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a flat sequence of text blocks in page order. Each block has its number of
words and the share of them inside links, the same of the block before and after, and what
encloses it: headings, lists, tables, and containers whose element, role, class or id name a
menu, header, footer, sidebar, advert, form, notice, comment section or the article. A decision
tree on these features, grown on a small labelled table, tells article blocks from the rest.

The labelled table is made from ``LABELLED``: page outlines in which every block is marked,
filled with words in several lengths.

Results for unusual input: a null page and a page without article blocks have an empty text;
broken markup is read as far as it goes, an unclosed comment, script, style, textarea or title
hides the rest;
rows that repeat are extracted alike; ids and urls may be null; no rows give no rows.
"""

from __future__ import annotations

import html
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements that begin and end blocks.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt
 fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main
 menu meta nav noscript object ol option optgroup p pre section select summary svg table tbody td textarea tfoot th
 thead title tr ul video audio canvas template""".split())
#: Elements whose content is not text of the page.
SILENT = set("script style noscript template svg title textarea select iframe object canvas head".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")
#: Those that contain their own kind, and those that hide the rest of a page when unclosed.
NESTED, HIDES_REST = ("svg", "template"), ("script", "style", "textarea", "title")
#: Elements that stay open until their end tag and pass their context on.
CONTAINER = set("""article aside body button center dialog details div dl dd fieldset figure footer form header
 label main menu nav ol section select table td th ul li blockquote""".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: What the names of elements, roles, classes and ids say.
NAMES = {
    "menu": "nav menu navbar navigation menubar breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead topbar sitename logo",
    "footer": "footer copyright colophon contentinfo legal imprint bottom",
    "aside": "aside sidebar complementary related widget recommended recommendations trending popular share sharing "
             "social teaser promo more tags",
    "advert": "ad ads advert adverts advertisement sponsor sponsored advertorial banner adsense adbox",
    "form": "form search newsletter subscribe signup login register button fieldset label dialog",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer warning paywall toast",
    "comments": "comment comments commentlist disqus reply replies respond discussion responses",
    "main": "article main content post entry story maincontent articlebody body text",
}
KINDS = list(NAMES)
_MEANS = {word: k for k, kind in enumerate(KINDS) for word in NAMES[kind].split()}
_ELEMENT = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 5, "button": 5, "label": 5, "fieldset": 5,
            "dialog": 6, "article": 8, "main": 8}
MAIN, HIDDEN = KINDS.index("main"), len(KINDS)
#: Names with such a word tell how a page is laid out, not what a container holds.
MODIFIERS = frozenset("has with without no not layout".split())
NAMED = 16
_WRAPPERS = sum(1 << KINDS.index(k) for k in ("menu", "header", "footer", "form", "notice"))
FEATURES = ["words", "links", "words before", "links before", "words after", "links after", "heading", "list", "cell",
            "sentence", "outside"] + KINDS + ["hidden"]
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RAW_TAG = {e: re.compile(rf"<(/?){e}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I) for e in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: int
    in_list: bool
    in_cell: bool
    kinds: int


def context(element: str, attributes: str, outer: int) -> int:
    """Bits of the container kinds in force inside an element.

    Kinds that elements and roles give stand in the low bits, those of class and id names
    ``NAMED`` bits higher. Names on body and of a main element itself say nothing but that it is
    main, nor do names with a word such as "no" or "has"; inside main, names of its wrappers no
    longer hold, and inside an article those that wrap no articles of their own.
    """
    hard = named = 0
    main = element == "main"
    if element in _ELEMENT:
        hard |= 1 << _ELEMENT[element]
    if attributes:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        for word in _NAME.findall(given.get("role", "")):
            if (k := _MEANS.get(word.lower())) is not None:
                hard |= 1 << k
                main |= word.lower() == "main"
        for name in f"{given.get('class', '')} {given.get('id', '')}".split():
            words = [w.lower() for w in _NAME.findall(name)]
            if not MODIFIERS.intersection(words):
                for k in {_MEANS[w] for w in words if w in _MEANS}:
                    named |= 1 << k
        if element == "body":
            named = 0
        elif main:
            named &= 1 << MAIN
        if _HIDDEN.search(given.get("style", "")) or given.get("aria-hidden") == "true" or re.search(
                r"(?:^|\s)hidden(?:\s|$)", attributes):
            hard |= 1 << HIDDEN
    if main:
        outer &= (1 << NAMED) - 1
    elif element == "article":
        outer &= ~(_WRAPPERS << NAMED)
    if (outer | outer >> NAMED) >> MAIN & 1:  # a header of the article itself is part of it
        hard, named = hard & ~(1 << KINDS.index("header")), named & ~(1 << KINDS.index("header"))
    return outer | hard | named << NAMED


class _Page:
    """Collects the blocks of one page."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.words = self.linked = 0
        self.link = self.heading = self.item = self.cell = 0
        self.stack: list[tuple[str, int]] = []

    def text(self, raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        self.parts.append(raw)
        n = len(raw.split())
        self.words += n
        if self.link:
            self.linked += n

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                bits = self.stack[-1][1] if self.stack else 0
                self.blocks.append(Block(text, max(1, self.words), self.linked, self.heading, self.item > 0,
                                         self.cell > 0, (bits | bits >> NAMED) & (1 << NAMED) - 1))
            self.parts, self.words, self.linked = [], 0, 0

    def open(self, element: str, attributes: str) -> None:
        if element == "a":
            self.link = 1
        elif element == "br":
            self.parts.append(" ")
        if element in BLOCK:
            self.flush()
            self.link = 0
            self.heading = int(element[1]) if len(element) == 2 and element[0] == "h" and element[1].isdigit() else 0
            self.item += element == "li"
            self.cell += element in ("td", "th")
        if element in CONTAINER and element not in VOID and not attributes.endswith("/"):
            self.stack.append((element, context(element, attributes, self.stack[-1][1] if self.stack else 0)))

    def close(self, element: str) -> None:
        if element == "a":
            self.link = 0
        if element in BLOCK:
            self.flush()
            self.heading = 0
            self.item = max(0, self.item - (element == "li"))
            self.cell = max(0, self.cell - (element in ("td", "th")))
        if element in CONTAINER:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == element:
                    del self.stack[i:]
                    break
        if element in ("ul", "ol"):
            self.item = sum(e == "li" for e, _ in self.stack)


def raw_end(page: str, element: str, attributes: str, at: int, unclosed: set[str]) -> int:
    """Where the page goes on after the start tag of a silent element that ends at ``at``.

    An svg that closes itself is empty; svg and template nest. Without an end tag, script, style,
    textarea and title hide the rest, the others nothing; ``unclosed`` remembers those, so that a
    page full of them is not searched again for each.
    """
    if element == "svg" and attributes.endswith("/"):
        return at
    if element in unclosed:
        return at
    depth, nests = 1, element in NESTED
    for mark in _RAW_TAG[element].finditer(page, at):
        if mark[1]:
            depth -= 1
        elif nests and not (element == "svg" and mark[2].endswith("/")):
            depth += 1
        if not depth:
            return mark.end()
    if element in HIDES_REST:
        return len(page)
    unclosed.add(element)
    return at


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    out, at, n = _Page(), 0, len(page)
    unclosed: set[str] = set()
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            out.text(page[at:])
            break
        if mark > at:
            out.text(page[at:mark])
        tag = _TAG.match(page, mark) or _LOOSE.match(page, mark)
        if not tag:
            out.text("<")
            at = mark + 1
            continue
        at = tag.end()
        if not tag[2]:
            continue
        element = tag[2].lower()
        if tag[1]:
            out.close(element)
            continue
        if element in RAW:
            out.flush()
            at = raw_end(page, element, tag[3], at, unclosed)
            continue
        out.open(element, tag[3])
    out.flush()
    return out.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, in the order of FEATURES."""
    rows = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        rows[i, 0], rows[i, 1] = b.words, b.linked / b.words
        rows[i, 6:10] = b.heading, b.in_list, b.in_cell, b.text[-1] in ".!?:;\"'”»)"
        kinds = b.kinds
        rows[i, 10] = kinds & ~(1 << MAIN) > 0
        k = 11
        while kinds:
            rows[i, k] = kinds & 1
            kinds >>= 1
            k += 1
    rows[1:, 2:4] = rows[:-1, 0:2]
    rows[:-1, 4:6] = rows[1:, 0:2]
    return rows


#: Page outlines. K marks a block of the article, D one that is not; "*" is a word, "**" some
#: words, "***" many.
LABELLED = [
    "<nav><ul><li><a>D*</a><li><a>D*</a><li><a>D**</a></ul></nav><div class=ad>D**</div>"
    "<article><h1>K**</h1><p><b>K***</b><br><p>K***</p><p>K*</p><p>K**</p></article><footer>D**</footer>",
    "<header><a>D*</a><p>D**</p></header><main><h1>K*</h1><p>K**</p><ul><li>K**</li><li>K*</li></ul><p>K***</p></main>"
    "<aside><h2>D*</h2><p>D***</p></aside><footer><p>D***</p><a>D*</a></footer>",
    "<div id=header><h1>D**</h1></div><div id=content><h2>K**</h2><p>K***</p><p>K** <a>**</a></p><blockquote>K**"
    "</blockquote></div><div id=sidebar><p>D***</p><ul><li><a>D**</a></ul></div><div class=copyright>D**</div>",
    "<div class=cookie-notice><p>D***</p><button>D*</button></div><article><header><h1>K**</h1></header><p>K***</p>"
    "<form><label>D**</label><p>D***</p></form><p>K**</p><div class=related><a>D**</a><p>D***</p></div></article>"
    "<section id=comments><h3>D*</h3><div class=comment><p>D***</p><p>D**</p></div></section>",
    "<ul><li><a>D*</a><li><a>D*</a><li><a>D*</a></ul><div><h1>K**</h1><p>K***</p><p>K***</p><p>K**</p></div><div>"
    "<a>D**</a> <a>*</a></div><div><a>D**</a></div>",
    "<div class=post><h1>K**</h1><table><tr><td>K*</td><td>K*</td></tr></table><pre>K***</pre><p>K**</p><aside><p>D**"
    "</p></aside><p>K***</p></div><div class=comments><p>D***</p></div><div class=advert><p>D***</p></div>",
    "<div><a>D*</a></div><div><p>K***</p></div><p>K***</p><p>K**</p><p>K***</p><div><a>D**</a></div>",
    "<div style='display:none'><p>D***</p></div><div role=main><p>K***</p><h2>K**</h2><p>K*</p></div>"
    "<div role=navigation><p>D**</p></div><div role=alert><p>D***</p></div><form><p>D**</p></form>",
    "<article><p>K**</p><p>K*</p><p>K* <a>*</a></p><p><a>K**</a></p><p>K***</p><nav><a>D**</a></nav><footer>D**"
    "</footer></article><div class=newsletter><p>D***</p></div><div class=social><a>D*</a></div>",
    "<body class=article><header>D***</header><menu><li>D*</menu><div class=banner>D***</div><p>K***</p><p>K***</p>"
    "<footer><p>D*</p></footer>",
    "<article><p>K*</p></article><div class=notice>D**</div><aside><a>D***</a></aside>",
    "<article><h1>K*</h1></article><div class=sponsored><p>D*</p></div>",
    "<h1>K**</h1><p>K**</p>",
    "<main><section><h2>K*</h2><p>K*</p></section><section class=comments><p>D***</p><p>D*</p></section></main>",
    "<body class=has-sidebar><div class=layout-no-sidebar><h1>K**</h1><p>K***</p><p>K**</p></div><div class=sidebar><p>D***"
    "</p></div></body>",
    "<div id=legal-news><main class=with-footer><p>K***</p><p>K*</p></main></div><div class=site-footer><p>D***</p></div>",
    "<div id=form-page><article><h1>K**</h1><p>K***</p></article></div><div class=sidebar><article><p>D***</p></article></div>",
]
LENGTHS = ((1, 4, 18), (2, 9, 45), (1, 14, 120), (3, 25, 70))


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the filled outlines."""
    rows, labels = [], []
    for outline, lengths, stop in itertools.product(LABELLED, LENGTHS, (".", "")):
        filled = re.sub(r"([KD]?)(\*{1,3})", lambda m: (m[1] + " " if m[1] else "") + "word " * lengths[len(m[2]) - 1]
                        + "end" + stop, outline)
        blocks = blocks_of(filled)
        rows.append(features(blocks))
        labels += [b.text[0] == "K" for b in blocks]
    return np.concatenate(rows), np.array(labels)


@dataclass
class Tree:
    """Nodes: feature (-1 for a leaf), limit, children for values up to and above it, share of articles."""

    feature: list[int]
    limit: list[float]
    low: list[int]
    high: list[int]
    share: list[float]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        feature, limit = np.array(self.feature), np.array(self.limit)
        low, high, every = np.array(self.low), np.array(self.high), np.arange(len(rows))
        while (inner := feature[node] >= 0).any():
            down = rows[every, np.maximum(feature[node], 0)] <= limit[node]
            node = np.where(inner, np.where(down, low[node], high[node]), node)
        return np.array(self.share)[node]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 16, least: int = 1) -> Tree:
    """A binary tree by the largest drop of Gini impurity."""
    tree = Tree([], [], [], [], [])

    def impurity(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = k / n
        return n * p * (1 - p)

    def add(own: np.ndarray, level: int) -> int:
        here = len(tree.feature)
        y = labels[own]
        for column, value in zip((tree.feature, tree.limit, tree.low, tree.high, tree.share),
                                 (-1, 0.0, -1, -1, float(y.mean()))):
            column.append(value)
        if level == depth or y.all() or not y.any():
            return here
        best = (1e-9, -1, 0.0)
        for f in range(rows.shape[1]):
            order = np.argsort(rows[own, f], kind="stable")
            v, k = rows[own, f][order], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
            if not len(cut):
                continue
            n = cut + 1
            gain = impurity(k[-1:], np.array([len(v)])) - impurity(k[cut], n) - impurity(k[-1] - k[cut], len(v) - n)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            return here
        down = rows[own, best[1]] <= best[2]
        tree.feature[here], tree.limit[here] = best[1], best[2]
        tree.low[here] = add(own[down], level + 1)
        tree.high[here] = add(own[~down], level + 1)
        return here

    add(np.arange(len(rows)), 0)
    return tree


def _extract(tree: Tree):
    def run(batches):
        for batch in batches:
            texts = []
            for page in batch.column("html").to_pylist():
                blocks = blocks_of(page)
                if not blocks:
                    texts.append("")
                    continue
                good = tree(features(blocks)) >= 0.5
                texts.append("\n".join([b.text for b, k in zip(blocks, good) if k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    texts = rows.mapInArrow(_extract(tree or grow(*labelled_table())), "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
