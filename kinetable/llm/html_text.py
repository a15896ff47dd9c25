"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  Each block is described by its word count and link
density, those of its neighbours and the kind of element it stands in; a decision
tree, grown from the small labelled table ``EXAMPLES``, keeps or drops it.  An element's name is a hint
by whole words only, and a weak one where the word merely begins a longer name: then words and links decide.
Scripts, styles, comments and markup never become text.  Elements whose end may be left out end where the next one
starts, and ends without a start are skipped, so pages of any depth take linear time.  Null or empty html gives an empty
text; every row gives one result row, repeated ones too.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WHITE = re.compile(r"[ \t\n\r\f\v \s]+")
WORD = re.compile(r"\w+")
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select option xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img"
    .split()
)
#: Kinds of surrounding element, by tag or role; the first that an enclosing element has counts.
BOILER_TAGS = frozenset("nav header footer aside form button dialog menu fieldset figcaption head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar alertdialog".split())
BODY_TAGS = frozenset("article main".split())
# Fixed words: parts of class names and ids that mark menus, notices, adverts, forms and comments.
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menus footer foot sidebar side aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos promotion cookie cookies consent "
    "notice notices gdpr popup modal comment comments reply replies respond disqus related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager subscribe "
    "newsletter signup login toolbar widget widgets tag tags masthead topbar header skip copyright legal disclaimer alert alerts search form toc".split()
)
BODY_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|body|main|text)(?=$|[\s_-])", re.I)
#: Elements that end where one of these starts beside them; a paragraph ends at any block.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    tag: str
    boiler: int  # stands in a menu, footer, form, advert, ...: 2; in an element whose name only begins like one: 1
    body: int  # stands in an article or main element


def name_hint(names: str) -> int:
    """2 if a class or id is, or ends with, a boilerplate word; 1 if a word only begins or stands within a longer name."""
    hint = 0
    for name in names.lower().split():
        parts = re.split(r"[-_]+|(?<=[a-z])(?=\d)", name.strip("-_"))
        if parts[-1] in BOILER_WORDS:
            return 2
        hint = max(hint, int(not BOILER_WORDS.isdisjoint(parts)))
    return hint


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, boiler, body, link
    parts: list[str] = []
    words = linked = at = 0
    state = (0, 0, 0)
    owner = "body"
    opened: dict[str, int] = {}

    def pop() -> tuple[int, int, int]:
        tag, *before = stack.pop()
        opened[tag] -= 1
        return tuple(before)

    def flush():
        nonlocal words, linked
        text = WHITE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, words, linked, owner, state[0], state[1]))
        parts.clear()
        words = linked = 0

    def add(raw: str):
        nonlocal words, linked
        text = html.unescape(raw)
        parts.append(text)
        n = len(WORD.findall(text))
        words += n
        if state[2]:
            linked += n

    low = None
    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if tag not in INLINE:
                flush()
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                low = low if low is not None else page.lower()
                end = low.find(f"</{tag}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page) if tag in ("script", "style") else at if end < 0 else len(page)
            continue
        if tag in INLINE and tag != "a":
            continue
        if tag != "a":
            flush()
        if tag in VOID:
            continue
        if not closing:
            while stack and tag != "a" and (stack[-1][0] == "p" or tag in ENDED_BY.get(stack[-1][0], ())):
                state = pop()
            boiler, body, link = state
            if tag == "a":
                link = 1
            else:
                named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
                names = f"{named.get('class', '')} {named.get('id', '')}"
                role = named.get("role", "").lower()
                hidden = "hidden" in named or named.get("aria-hidden") == "true" or HIDDEN.search(named.get("style", "")) is not None
                plain_header = tag == "header" and body  # a header inside the article holds its title
                hint = 2 if (tag in BOILER_TAGS and not plain_header) or role in BOILER_ROLES or hidden else name_hint(names)
                if hint and tag not in ("html", "body", "article", "main"):
                    boiler = max(boiler, hint)
                elif tag in BODY_TAGS or role == "main" or named.get("itemprop") == "articleBody" or BODY_NAMES.search(names):
                    body = 1
                owner = tag
            stack.append((tag, *state))
            opened[tag] = opened.get(tag, 0) + 1
            state = (boiler, body, link)
        elif opened.get(tag):
            if tag in ("a", "p"):  # these close nothing but each other
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in ("a", "p") and stack[k][0] != tag:
                    k -= 1
                n = len(stack) - k if k >= 0 and stack[k][0] == tag else 0
            else:
                n = next(i for i, e in enumerate(reversed(stack), 1) if e[0] == tag)
            for _ in range(n):
                state = pop()
            owner = stack[-1][0] if stack else "body"
    if at < len(page):
        add(page[at:])
    flush()
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features(found: list[Block], page_has_body: bool) -> np.ndarray:
    """One row a block, columns as in ``EXAMPLES``: words, link density, both of the previous and next block, boiler, body, page has a body, heading."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.linked / max(b.words, 1) for b in found), 0], float)
    own = np.array([[b.boiler, b.body, page_has_body, b.tag in HEADINGS] for b in found], float).reshape(n, 4)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own])


# Labelled blocks: words, link density, previous words, previous density, next words, next density, in a menu/footer/
# form/advert/comment element (2; 1: its name only begins like one), in an article element, page has one, heading; label.
EXAMPLES = np.array([
    [1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 1, 0, 0], [1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 1, 0, 0], [2, 1.0, 1, 1.0, 7, 0.0, 2, 0, 1, 0, 0],
    [7, 0.0, 1, 1.0, 9, 0.0, 2, 0, 1, 0, 0], [30, 0.0, 1, 1.0, 9, 0.0, 2, 0, 1, 0, 0], [9, 0.0, 60, 0.0, 0, 0.0, 2, 0, 1, 0, 0],
    [9, 0.0, 7, 0.0, 9, 0.0, 0, 1, 1, 1, 1], [9, 0.0, 9, 0.0, 40, 0.0, 0, 1, 1, 0, 1], [40, 0.0, 9, 0.0, 1, 0.0, 0, 1, 1, 0, 1],
    [1, 0.0, 40, 0.0, 55, 0.0, 0, 1, 1, 0, 1], [55, 0.0, 1, 0.0, 2, 0.0, 0, 1, 1, 0, 1], [120, 0.1, 55, 0.0, 30, 0.0, 0, 1, 1, 0, 1],
    [3, 0.0, 80, 0.0, 9, 0.0, 0, 1, 1, 0, 1], [14, 0.5, 60, 0.0, 50, 0.0, 0, 1, 1, 0, 1], [5, 1.0, 60, 0.0, 70, 0.1, 0, 1, 1, 0, 1],
    [4, 0.0, 90, 0.0, 60, 0.0, 0, 1, 1, 1, 1], [2, 0.0, 1, 1.0, 3, 0.0, 0, 1, 1, 1, 1], [300, 0.0, 4, 0.0, 0, 0.0, 0, 1, 1, 0, 1],
    [20, 0.0, 80, 0.0, 25, 0.0, 2, 1, 1, 0, 0], [60, 0.0, 80, 0.0, 40, 0.0, 2, 1, 1, 0, 0], [5, 1.0, 4, 1.0, 6, 1.0, 2, 1, 1, 0, 0],
    [3, 0.0, 60, 0.0, 25, 0.0, 2, 1, 1, 1, 0], [12, 0.3, 5, 0.0, 0, 0.0, 2, 1, 1, 0, 0], [45, 0.0, 3, 0.0, 30, 0.0, 2, 0, 1, 0, 0],
    [8, 0.0, 30, 0.0, 5, 1.0, 0, 0, 1, 0, 0], [25, 0.2, 3, 0.0, 9, 0.0, 0, 0, 1, 0, 0], [40, 0.0, 2, 1.0, 6, 0.0, 0, 0, 1, 0, 0],
    [4, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1, 1, 0], [2, 1.0, 2, 1.0, 40, 0.0, 0, 0, 1, 0, 0], [6, 0.0, 80, 0.0, 1, 1.0, 0, 0, 1, 0, 0],
    [45, 0.0, 10, 0.0, 60, 0.0, 0, 0, 0, 0, 1], [60, 0.1, 45, 0.0, 80, 0.0, 0, 0, 0, 0, 1], [22, 0.0, 60, 0.1, 35, 0.0, 0, 0, 0, 0, 1],
    [150, 0.0, 3, 0.0, 4, 1.0, 0, 0, 0, 0, 1], [17, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0, 0, 1], [6, 0.0, 3, 1.0, 70, 0.0, 0, 0, 0, 1, 1],
    [3, 0.0, 80, 0.0, 50, 0.0, 0, 0, 0, 1, 1], [9, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 0, 1], [2, 0.0, 45, 0.0, 40, 0.0, 0, 0, 0, 0, 1],
    [19, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 1], [35, 0.1, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 1], [14, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1],
    [25, 0.0, 5, 1.0, 2, 1.0, 0, 0, 0, 0, 1], [1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0], [3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0],
    [2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0], [20, 0.9, 60, 0.0, 5, 1.0, 0, 0, 0, 0, 0], [12, 0.8, 2, 1.0, 9, 1.0, 0, 0, 0, 0, 0],
    [2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0], [3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0], [5, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 0, 0],
    [30, 0.7, 4, 1.0, 6, 1.0, 0, 0, 0, 0, 0], [60, 0.0, 20, 0.0, 30, 0.0, 2, 0, 0, 0, 0], [15, 0.2, 6, 0.0, 3, 1.0, 2, 0, 0, 0, 0],
    [4, 0.0, 60, 0.0, 0, 0.0, 2, 0, 0, 1, 0], [2, 1.0, 60, 0.0, 2, 1.0, 0, 1, 1, 0, 0], [2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 1, 0, 0],
    [2, 1.0, 2, 1.0, 60, 0.0, 0, 1, 1, 0, 0], [6, 1.0, 80, 0.0, 5, 1.0, 0, 1, 1, 0, 0], [4, 1.0, 5, 1.0, 6, 1.0, 0, 1, 1, 0, 0],
    [7, 1.0, 4, 1.0, 0, 0.0, 0, 1, 1, 0, 0], [1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0], [3, 1.0, 3, 0.9, 4, 1.0, 0, 1, 1, 0, 0],
    [6, 1.0, 50, 0.0, 40, 0.0, 0, 1, 1, 0, 1], [3, 1.0, 90, 0.1, 60, 0.0, 0, 1, 1, 0, 1], [9, 1.0, 20, 0.0, 15, 0.2, 0, 1, 1, 0, 1],
    [12, 1.0, 30, 0.0, 0, 0.0, 0, 1, 1, 0, 1], [4, 1.0, 25, 0.1, 30, 0.1, 0, 1, 1, 1, 1], [60, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1, 0, 1],
    [45, 0.1, 12, 0.0, 60, 0.0, 1, 1, 1, 0, 1], [90, 0.0, 6, 0.0, 3, 0.0, 1, 1, 1, 0, 1], [30, 0.0, 60, 0.0, 40, 0.1, 1, 1, 1, 0, 1],
    [25, 0.0, 40, 0.0, 9, 0.0, 1, 1, 1, 0, 1], [150, 0.2, 30, 0.0, 0, 0.0, 1, 1, 1, 0, 1], [3, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1, 0, 0],
    [6, 0.0, 2, 1.0, 4, 0.0, 1, 1, 1, 0, 0], [8, 0.3, 30, 0.0, 60, 0.0, 1, 1, 1, 0, 0], [2, 1.0, 2, 1.0, 3, 1.0, 1, 1, 1, 0, 0],
    [15, 0.8, 4, 1.0, 6, 1.0, 1, 1, 1, 0, 0], [10, 0.0, 5, 0.0, 60, 0.0, 1, 1, 1, 0, 0], [60, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0, 0, 1],
    [45, 0.1, 80, 0.0, 6, 0.0, 1, 0, 0, 0, 1], [8, 0.0, 60, 0.0, 40, 0.0, 1, 0, 0, 0, 0], [4, 1.0, 3, 1.0, 4, 1.0, 1, 0, 0, 0, 0],
    [12, 0.5, 2, 1.0, 30, 0.0, 1, 0, 0, 0, 0], [50, 0.0, 3, 1.0, 9, 0.0, 1, 0, 1, 0, 0], [9, 0.0, 4, 0.0, 2, 1.0, 1, 0, 1, 0, 0],
    [30, 0.0, 2, 1.0, 8, 0.0, 1, 0, 1, 0, 0],
])


def training_table() -> np.ndarray:
    """``EXAMPLES``, and text that its element settles, beside other neighbours too: neither a menu's nor an article's
    prose depends on what stands next to it.  Links and elements with odd names stay as they are labelled."""
    plain = (EXAMPLES[:, 6] == 2) | ((EXAMPLES[:, 6] == 0) & (EXAMPLES[:, 8] == 1) & (EXAMPLES[:, 1] < 0.8))
    rows = [EXAMPLES]
    for before, after in ((0, 0), (3, 60), (60, 3), (60, 60), (9, 9)):
        for density in (0.0, 1.0):
            other = EXAMPLES[plain]
            other[:, 2:6] = before, density, after, density
            rows.append(other)
    return np.concatenate(rows)


@dataclass
class Tree:
    feature: list[int]
    threshold: list[float]
    children: list[tuple[int, int]]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                right = x[rows, self.feature[node]] > self.threshold[node]
                todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out


def grow(table: np.ndarray | None = None, depth: int = 9) -> Tree:
    """CART by Gini impurity; ties take the first feature and the lowest threshold."""
    table = training_table() if table is None else table
    x, y = table[:, :-1], table[:, -1]
    tree = Tree([], [], [], [])

    def node(rows: np.ndarray, left: int) -> int:
        k = len(tree.feature)
        tree.feature.append(-1)
        tree.threshold.append(0.0)
        tree.children.append((0, 0))
        tree.value.append(float(y[rows].mean()))
        best = (2 * tree.value[k] * (1 - tree.value[k]) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]) if left and 0 < tree.value[k] < 1 else ():
            v = np.unique(x[rows, f])
            for t in (v[:-1] + v[1:]) / 2:
                right = x[rows, f] > t
                sides = [y[rows[right]], y[rows[~right]]]
                impurity = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in sides)
                if impurity < best[0] - 1e-9:
                    best = (impurity, f, float(t))
        if best[1] >= 0:
            right = x[rows, best[1]] > best[2]
            tree.feature[k], tree.threshold[k] = best[1], best[2]
            tree.children[k] = (node(rows[~right], left - 1), node(rows[right], left - 1))
        return k

    node(np.arange(len(y)), depth)
    return tree


#: Features of the text itself and of its neighbours.
TEXT_FEATURES = frozenset(range(6))


def decided_by_text(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Whether the way to a row's verdict asks for words or links, its own or its neighbours'."""
    out = np.zeros(len(x), bool)
    todo = [(0, np.arange(len(x)), False)]
    while todo:
        node, rows, asked = todo.pop()
        f = tree.feature[node]
        if f < 0:
            out[rows] = asked
        elif len(rows):
            right = x[rows, f] > tree.threshold[node]
            todo += [(tree.children[node][k], rows[right == k], asked or f in TEXT_FEATURES) for k in (0, 1)]
    return out


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(features(found, any(b.body for b in found))) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys, text, n_chars`` of every page."""
    tree = grow()

    def run(cols):
        text = [main_text(p, tree) for p in cols[HTML]]
        return {k: cols[k] for k in keys} | {"text": text, "n_chars": [len(t) for t in text]}

    HTML = "_kt_html"
    rows = pages.select(*keys, F.col(html_col).alias(HTML))
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return map_columns(rows, run, f"{fields}, text string, n_chars bigint")
