"""Main text of web pages: flat text blocks, judged by a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page.
OPAQUE = frozenset("audio button canvas datalist iframe math noscript object option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no sections.
TEXT_LEVEL = HEADINGS | frozenset("p li dd dt dl tr td th tbody thead pre hr ul ol caption figcaption figure blockquote legend summary".split())
#: Elements and ARIA roles that are not the article, and words of names of such containers.
CHROME_TAGS = frozenset("nav footer aside form dialog menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo "
    "promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets".split()
)
#: Words that such a name may have beside them; any other word makes it the name of something else.
NEUTRAL_WORDS = frozenset(
    "area articles bar block bottom box btn button buttons card center col column container content desktop fixed form global group head holder icon icons "
    "inline inner item items left links list main mobile outer page panel placeholder posts primary right row section secondary site slot small "
    "sticky text thread title top unit wrap wrapper".split()
)
#: Names of containers that hold an article: one word of each set, or one of these alone.
ARTICLE_WORDS = frozenset("article articlebody content main story".split())
ARTICLE_OWNERS, ARTICLE_PARTS = frozenset("article blog entry main page post story".split()), frozenset("body content text".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_name_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Labelled blocks. Each row: words, and the share of them in links; the same two of the block before and of the block
#: after; the share of the page's unlinked words that the block's section has, and the share of words in links there;
#: whether the block is a heading; whether its section is marked as something else; and whether it is main text.
LABELLED = (
    # paragraphs of the section that has most of the text, long and short, first and last
    (64, 0.0, 51, 0.0, 70, 0.0, 0.93, 0.00, 0, 0, 1), (38, 0.0, 12, 0.0, 24, 0.0, 0.88, 0.02, 0, 0, 1), (21, 0.1, 44, 0.0, 3, 0.0, 0.97, 0.04, 0, 0, 1),
    (1, 0.0, 47, 0.0, 66, 0.0, 0.91, 0.00, 0, 0, 1), (3, 0.0, 60, 0.0, 10, 0.0, 0.79, 0.01, 0, 0, 1), (5, 0.0, 31, 0.0, 12, 0.5, 0.71, 0.08, 0, 0, 1),
    (120, 0.05, 9, 0.0, 0, 0.0, 1.00, 0.05, 0, 0, 1), (2, 0.0, 18, 0.0, 11, 0.0, 0.62, 0.00, 0, 0, 1), (17, 0.3, 40, 0.0, 35, 0.0, 0.90, 0.06, 0, 0, 1),
    (12, 0.0, 2, 1.0, 40, 0.0, 0.85, 0.00, 0, 0, 1), (9, 0.0, 9, 0.0, 1, 1.0, 0.66, 0.00, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 1.00, 0.00, 0, 0, 1),
    (4, 0.0, 0, 0.0, 0, 0.0, 1.00, 0.00, 0, 0, 1), (8, 0.0, 6, 0.0, 2, 1.0, 0.58, 0.00, 0, 0, 1), (45, 0.0, 3, 1.0, 2, 1.0, 0.83, 0.10, 0, 0, 1),
    # its headings, items of lists, and a link that stands alone among its paragraphs
    (9, 0.0, 11, 0.0, 34, 0.0, 0.94, 0.00, 1, 0, 1), (12, 0.0, 2, 1.0, 60, 0.0, 0.90, 0.01, 1, 0, 1), (3, 0.0, 70, 0.0, 81, 0.0, 0.96, 0.00, 1, 0, 1),
    (11, 0.0, 1, 1.0, 21, 0.0, 0.64, 0.00, 1, 0, 1), (6, 0.0, 5, 0.0, 7, 0.0, 0.80, 0.03, 0, 0, 1), (4, 1.0, 50, 0.0, 42, 0.0, 0.92, 0.05, 0, 0, 1),
    (7, 0.9, 33, 0.0, 28, 0.0, 0.89, 0.07, 0, 0, 1), (2, 1.0, 25, 0.0, 19, 0.1, 0.76, 0.06, 0, 0, 1),
    # short text beside such a link
    (1, 0.0, 40, 0.0, 1, 1.0, 0.90, 0.08, 0, 0, 1), (3, 0.0, 30, 0.0, 2, 1.0, 0.85, 0.10, 0, 0, 1), (2, 0.0, 1, 1.0, 1, 1.0, 0.90, 0.12, 0, 0, 1),
    (1, 1.0, 1, 0.0, 28, 0.0, 0.88, 0.06, 0, 0, 1), (2, 1.0, 3, 0.0, 2, 0.0, 0.90, 0.10, 0, 0, 1), (4, 1.0, 2, 0.0, 33, 0.0, 0.80, 0.07, 0, 0, 1),
    (5, 0.0, 12, 0.2, 3, 1.0, 0.92, 0.18, 0, 0, 1), (3, 1.0, 6, 0.0, 14, 0.1, 0.86, 0.16, 0, 0, 1),
    (1, 0.0, 1, 1.0, 5, 0.2, 0.90, 0.10, 1, 0, 1), (1, 0.0, 2, 1.0, 6, 0.0, 0.85, 0.10, 0, 0, 1), (1, 0.0, 1, 1.0, 1, 0.0, 0.70, 0.00, 1, 0, 1),
    (2, 0.0, 3, 1.0, 4, 0.0, 0.80, 0.00, 1, 0, 1), (5, 0.0, 2, 1.0, 9, 0.0, 0.75, 0.00, 0, 0, 1), (4, 0.0, 6, 1.0, 30, 0.0, 0.95, 0.20, 1, 0, 1),
    (6, 0.2, 4, 1.0, 12, 0.0, 0.88, 0.15, 0, 0, 1), (3, 0.0, 5, 1.0, 0, 0.0, 0.82, 0.18, 0, 0, 1),
    # the same in articles of many links
    (60, 0.2, 45, 0.25, 70, 0.3, 0.95, 0.24, 0, 0, 1), (22, 0.1, 41, 0.3, 33, 0.2, 0.90, 0.26, 0, 0, 1), (3, 0.0, 52, 0.3, 40, 0.2, 0.92, 0.28, 0, 0, 1),
    (8, 0.0, 20, 0.3, 66, 0.25, 0.94, 0.21, 1, 0, 1), (6, 0.5, 60, 0.2, 50, 0.3, 0.89, 0.30, 0, 0, 1), (90, 0.4, 70, 0.35, 12, 0.3, 0.97, 0.36, 0, 0, 1),
    (2, 1.0, 38, 0.2, 29, 0.3, 0.85, 0.27, 0, 0, 1), (14, 0.3, 7, 0.0, 24, 0.4, 0.91, 0.33, 0, 0, 1), (5, 0.0, 3, 0.0, 8, 0.4, 0.80, 0.25, 0, 0, 1),
    (11, 0.6, 31, 0.2, 16, 0.1, 0.88, 0.19, 0, 0, 1), (50, 0.1, 40, 0.2, 5, 1.0, 0.90, 0.25, 0, 0, 1), (27, 0.0, 33, 0.0, 4, 1.0, 0.87, 0.20, 0, 0, 1),
    (18, 0.2, 22, 0.1, 3, 1.0, 0.80, 0.30, 0, 0, 1),
    # lists of links inside it, and the heading over one
    (2, 1.0, 2, 1.0, 3, 1.0, 0.88, 0.20, 0, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0.91, 0.15, 0, 0, 0), (7, 1.0, 2, 0.0, 8, 1.0, 0.80, 0.22, 0, 0, 0),
    (4, 1.0, 5, 1.0, 30, 0.0, 0.86, 0.18, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0.70, 0.30, 0, 0, 0), (9, 0.9, 8, 1.0, 7, 0.9, 0.93, 0.12, 0, 0, 0),
    (2, 0.0, 44, 0.0, 6, 1.0, 0.90, 0.15, 1, 0, 0), (1, 0.0, 20, 0.0, 3, 1.0, 0.82, 0.25, 1, 0, 0),
    # sections beside it: menus, single lines, adverts, footers and notices without a mark
    (1, 1.0, 0, 0.0, 1, 1.0, 0.00, 1.00, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0.00, 1.00, 0, 0, 0), (3, 1.0, 2, 1.0, 9, 0.0, 0.00, 1.00, 0, 0, 0),
    (9, 0.0, 1, 1.0, 11, 0.0, 0.03, 0.00, 0, 0, 0), (11, 0.1, 48, 0.0, 0, 0.0, 0.02, 0.10, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0.01, 0.40, 0, 0, 0),
    (14, 0.0, 2, 1.0, 10, 0.0, 0.12, 0.00, 0, 0, 0), (22, 0.2, 40, 0.0, 6, 1.0, 0.06, 0.25, 0, 0, 0), (30, 0.9, 3, 1.0, 5, 1.0, 0.01, 0.90, 0, 0, 0),
    (8, 0.0, 22, 0.0, 0, 0.0, 0.17, 0.00, 0, 0, 0), (6, 0.0, 3, 1.0, 14, 0.0, 0.10, 0.00, 0, 0, 0), (12, 0.0, 14, 0.0, 0, 0.0, 0.21, 0.00, 0, 0, 0),
    (25, 0.0, 60, 0.0, 31, 0.0, 0.08, 0.00, 0, 0, 0), (52, 0.0, 30, 0.0, 47, 0.0, 0.11, 0.00, 0, 0, 0), (2, 0.0, 70, 0.0, 25, 0.0, 0.05, 0.00, 1, 0, 0),
    (2, 0.0, 1, 1.0, 9, 0.0, 0.03, 0.00, 1, 0, 0), (1, 0.0, 2, 0.0, 13, 0.0, 0.05, 0.00, 1, 0, 0), (3, 0.0, 0, 0.0, 12, 0.0, 0.04, 0.00, 1, 0, 0),
    (3, 0.0, 5, 1.0, 2, 1.0, 0.02, 0.60, 1, 0, 0), (50, 0.7, 2, 1.0, 60, 0.8, 0.05, 0.75, 0, 0, 0), (16, 0.0, 9, 0.0, 20, 0.0, 0.14, 0.00, 0, 0, 0),
    (10, 0.0, 2, 1.0, 62, 0.0, 0.03, 0.00, 0, 0, 0), (24, 0.0, 0, 0.0, 90, 0.0, 0.06, 0.00, 0, 0, 0), (18, 0.0, 45, 0.0, 50, 0.0, 0.05, 0.00, 0, 0, 0),
    (13, 0.0, 30, 0.0, 40, 0.0, 0.04, 0.00, 0, 0, 0), (60, 0.0, 50, 0.0, 70, 0.0, 0.12, 0.00, 0, 0, 0), (71, 0.0, 20, 0.0, 5, 0.0, 0.19, 0.00, 0, 0, 0),
    (36, 0.0, 3, 1.0, 44, 0.0, 0.15, 0.00, 0, 0, 0), (48, 0.1, 7, 0.0, 38, 0.0, 0.20, 0.05, 0, 0, 0),
    # a title or a lead that stands outside it, and text in several sections
    (9, 0.0, 2, 1.0, 58, 0.0, 0.04, 0.00, 1, 0, 1), (6, 0.0, 1, 1.0, 40, 0.0, 0.08, 0.00, 1, 0, 1), (12, 0.0, 0, 0.0, 75, 0.0, 0.03, 0.00, 1, 0, 1),
    (3, 0.0, 1, 1.0, 64, 0.0, 0.05, 0.00, 1, 0, 1), (2, 0.0, 2, 1.0, 49, 0.0, 0.06, 0.00, 1, 0, 1),
    (60, 0.0, 45, 0.0, 52, 0.0, 0.34, 0.00, 0, 0, 1), (35, 0.0, 8, 0.0, 41, 0.0, 0.29, 0.00, 0, 0, 1), (28, 0.1, 50, 0.0, 3, 0.0, 0.41, 0.05, 0, 0, 1),
    (44, 0.0, 2, 1.0, 39, 0.0, 0.46, 0.02, 0, 0, 1), (33, 0.0, 26, 0.0, 9, 0.0, 0.38, 0.00, 0, 0, 1),
    # sections that are marked as something else, whatever their words
    (9, 0.0, 1, 1.0, 11, 0.0, 0.00, 0.00, 0, 1, 0), (55, 0.0, 40, 0.0, 60, 0.0, 0.00, 0.00, 0, 1, 0), (3, 0.0, 47, 0.0, 50, 0.0, 0.90, 0.05, 0, 1, 0),
    (20, 0.0, 33, 0.0, 41, 0.0, 0.95, 0.02, 0, 1, 0), (2, 0.0, 60, 0.0, 22, 0.0, 0.40, 0.00, 1, 1, 0), (12, 0.0, 0, 0.0, 0, 0.0, 0.00, 0.00, 0, 1, 0),
    (1, 0.0, 1, 0.0, 15, 0.0, 0.00, 0.00, 1, 1, 0), (2, 0.0, 0, 0.0, 60, 0.0, 0.00, 0.00, 1, 1, 0), (1, 0.0, 3, 1.0, 40, 0.0, 0.00, 0.00, 1, 1, 0),
    (4, 0.0, 2, 0.0, 70, 0.0, 0.10, 0.00, 1, 1, 0), (3, 0.0, 1, 1.0, 55, 0.0, 0.05, 0.00, 1, 1, 0),
    (80, 0.0, 5, 0.0, 66, 0.0, 0.88, 0.00, 0, 1, 0), (7, 0.0, 30, 0.0, 3, 0.0, 0.30, 0.00, 1, 1, 0), (1, 1.0, 1, 1.0, 2, 1.0, 0.00, 1.00, 0, 1, 0),
)


def labelled_table() -> np.ndarray:
    """The columns of :func:`features`, and whether a block is kept."""
    return np.array(LABELLED, dtype=float)


@dataclass
class Tree:
    """A node: rows whose feature is at most ``cut`` go left; a leaf has the share of kept rows."""

    share: float
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.share)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, keep: np.ndarray, depth: int = 8) -> Tree:
    """A tree that halves the Gini impurity greedily; of equal splits the first feature and the lowest cut."""
    node = Tree(float(keep.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = len(keep) * node.share * (1 - node.share) - 1e-9
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= cut
            impurity = sum(part.sum() * (1 - part.mean()) for part in (keep[low], keep[~low]))
            if impurity < best:
                best, node.feature, node.cut = impurity, feature, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.left, node.right = grow(x[low], keep[low], depth - 1), grow(x[~low], keep[~low], depth - 1)
    return node


def train(rows: np.ndarray | None = None) -> Tree:
    rows = labelled_table() if rows is None else rows
    return grow(rows[:, :-1], rows[:, -1])


@dataclass
class Block:
    text: str
    words: int
    links: float
    element: int
    heading: bool


@dataclass
class Element:
    """An element that begins blocks. article: 2 by its tag or role, 1 by its name; chrome: 2 by its tag or role, 1 by its name."""

    tag: str
    parent: int
    chrome: int = 0
    article: int = 0


@dataclass
class Page:
    """Blocks in order, and elements, each after its parent; the first is the page."""

    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", -1)])
    open: list[int] = field(default_factory=lambda: [0])
    text: list[str] = field(default_factory=list)
    link_text: list[str] = field(default_factory=list)
    in_link: bool = False

    def end_block(self) -> None:
        words = "".join(self.text).split()
        if words:
            linked = len("".join(self.link_text).split())
            heading = any(self.elements[i].tag in HEADINGS for i in self.open[-4:])
            self.blocks.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), self.open[-1], heading))
        self.text.clear()
        self.link_text.clear()

    def add(self, raw: str) -> None:
        text = html.unescape(raw)
        self.text.append(text)
        if self.in_link:
            self.link_text.append(text)

    def begin(self, tag: str, attributes: str) -> None:
        last = self.elements[self.open[-1]].tag
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th") and last in {"p", tag} or last == "p":
            self.open.pop()
        chrome, article = _marks(tag, attributes, any(self.elements[i].article for i in self.open))
        self.elements.append(Element(tag, self.open[-1], chrome, article))
        self.open.append(len(self.elements) - 1)

    def finish(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[i]].tag == tag:
                del self.open[i:]
                break


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _attribute.findall(text)}


def _hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))


def _names_chrome(name: str) -> bool:
    """A whole name counts: each of its words is known, and one says what is not the article (``has-sidebar`` does not)."""
    words = {w.lower() for w in _name_word.findall(name)}
    return bool(words & CHROME_WORDS) and words <= CHROME_WORDS | NEUTRAL_WORDS


def _names_article(name: str) -> bool:
    words = {w.lower() for w in _name_word.findall(name)}
    return bool(words & ARTICLE_OWNERS and words & ARTICLE_PARTS) or len(words) == 1 and words <= ARTICLE_WORDS


def _marks(tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """How an element is marked as something else than the article, and as the article."""
    chrome = 2 if tag in CHROME_TAGS or tag == "header" and not inside else 0
    article = 2 if tag == "article" else 1 if tag == "main" else 0
    if not attributes.strip("/ \n"):
        return chrome, 0 if chrome else article
    given = _attributes(attributes)
    role = given.get("role", "").lower()
    if role in CHROME_ROLES or _hidden(given):
        chrome = 2
    if role == "article" or given.get("itemprop", "").lower() == "articlebody":
        article = 2
    elif role == "main":
        article = max(article, 1)
    if tag not in ("body", "html", "main", "article"):
        names = given.get("class", "").split()
        if tag not in HEADINGS and tag != "p" and "id" in given:
            names.append(given["id"])
        if not (tag == "header" and inside) and any(map(_names_chrome, names)):
            chrome = max(chrome, 1)
        if tag in ("div", "section", "td") and any(map(_names_article, names)):
            article = max(article, 1)
    return chrome, 0 if chrome else article


def parse(page: str) -> Page:
    """The page's flat blocks in order. Broken markup is read as far as it goes.

    ``br`` is white space; other block elements end a block. Character references are decoded once.
    """
    state, at, hidden, depth = Page(), 0, None, 0
    for m in _token.finditer(page):
        if m.start() < at:
            continue
        if hidden is None:
            state.add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if hidden is not None:
            if tag == hidden:
                depth += -1 if closing else 1
                hidden = hidden if depth else None
            continue
        if not tag:
            continue
        if tag == "a":
            state.in_link = not closing
        elif tag == "br":
            state.add(" ")
        if tag in BLOCK:
            state.end_block()
        if tag in ("script", "style", "title", "textarea", "iframe", "noscript", "template") and not closing:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif closing:
            state.finish(tag)
        elif tag in BLOCK and tag not in VOID:
            state.begin(tag, attributes)
        elif tag in OPAQUE and not attributes.endswith("/") or attributes and tag not in VOID and tag not in BLOCK and "hid" in attributes and _hidden(_attributes(attributes)):
            hidden, depth = (tag, 1) if re.compile(rf"</{tag}\b", re.I).search(page, at) else (None, 0)
    if hidden is None and at < len(page):
        state.add(page[at:])
    state.end_block()
    return state


#: What the unlinked words of a section count for if it is marked as the article by name, or by tag or role.
WEIGHTS = (1, 4, 10)


def _summed(page: Page, own: list[float]) -> list[float]:
    """For each element the sum over it and what is in it."""
    total = list(own)
    for i in range(len(total) - 1, 0, -1):
        total[page.elements[i].parent] += total[i]
    return total


def sections(page: Page) -> tuple[list[int], list[bool], int, int]:
    """(section, chrome) of each element, the main section, and what its words count for.

    From the page down, the element with most of the unlinked words leads to the main section; the other sections
    are what stands beside that way. Words in marked articles weigh more (a name counts if no tag in it does). Below a marked article only another one
    can be the main section. A mark as something else than the article is void for a form or a name if the
    element holds most of the page's words and either an article is marked in it or none on the page.
    """
    elements = page.elements
    plain, article = [0.0] * len(elements), [float(e.article > 0) for e in elements]
    for b in page.blocks:
        plain[b.element] += b.words * (1 - b.links)
    held, articles, tagged = _summed(page, plain), _summed(page, article), _summed(page, [float(e.article == 2) for e in elements])
    chrome, weight = [False] * len(elements), [1] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        void = (e.chrome == 1 or e.tag == "form") and 2 * held[i] > held[0] and (articles[i] > 0 or articles[0] == 0)
        chrome[i] = chrome[e.parent] or e.chrome > 0 and not void
        weight[i] = max(weight[e.parent], WEIGHTS[e.article] if e.article == 2 or not tagged[i] else 1)
    weighed = _summed(page, [0.0 if c else x * w for x, w, c in zip(plain, weight, chrome, strict=True)])
    inner: dict[int, list[int]] = {}
    for i, e in enumerate(elements[1:], 1):
        inner.setdefault(e.parent, []).append(i)
    top, way = 0, {0}
    while True:
        least, of = elements[top].article, tagged if elements[top].article == 2 else articles
        best = max((i for i in inner.get(top, ()) if elements[i].article >= least), key=weighed.__getitem__, default=None)
        if best is None:
            # such an article may be marked further down
            best = next((i for i in inner.get(top, ()) if of[i] and 2 * weighed[i] > weighed[top]), None)
        if best is None or weighed[best] <= 0 or 2 * weighed[best] <= weighed[top] or elements[best].tag in TEXT_LEVEL:
            break
        top = best
        way.add(top)
    section = [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        section[i] = i if i in way or e.parent in way and e.parent != top and e.tag not in TEXT_LEVEL else section[e.parent]
    return section, chrome, top, weight[top]


def features(page: Page) -> np.ndarray:
    """A row per block: words, links, both of the block before and after; its section's share of the page and links; heading; chrome."""
    if not page.blocks:
        return np.empty((0, 10))
    own = np.array([(b.words, b.links) for b in page.blocks], dtype=float)
    none = np.zeros((1, 2))
    of_element, chrome, top, heavy = sections(page)
    at = [b.element for b in page.blocks]
    section, other = np.array([of_element[i] for i in at]), np.array([chrome[i] for i in at])
    unlinked = np.bincount(section, own[:, 0] * (1 - own[:, 1]) * np.where(section == top, heavy, 1) * ~other)
    every, linked = np.bincount(section, own[:, 0]), np.bincount(section, own[:, 0] * own[:, 1])
    around = np.column_stack([unlinked[section] / max(unlinked.sum(), 1e-9), linked[section] / every[section]])
    heading = np.array([b.heading for b in page.blocks])
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), around, np.column_stack([heading, other])])


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks joined by line feeds; empty for null, empty and markup-only pages."""
    found = parse(page) if isinstance(page, str) and page else Page()
    if not found.blocks:
        return ""
    keep = tree.predict(features(found)) > 0.5
    return "\n".join(b.text for b, k in zip(found.blocks, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds text, the main text of each page's whole html, and n_chars, its code points; html goes.

    A row for each row of pages, whatever repeats or is null; columns text and n_chars of pages are replaced.
    """
    tree = train()

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, tree) for x in batch], dtype=object)

    told = F.pandas_udf(of, "string")
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    found = pages.select(*[F.col(f"`{c}`") for c in kept], told(F.col(f"`{html_column}`")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
