"""Main text of web pages from flat text blocks and a decision tree (operator 4)."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import text_rows, texts

# --- blocks ----------------------------------------------------------------------------------

#: Fixed values of the HTML standard and of common page templates.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg canvas object select math audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr area map nobr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split())
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu submenu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup signin login register comment comments commentlist reply replies discussion disqus respond reviews share "
    "sharing social related recommended recommendations trending footer footnav topbar masthead widget widgets toolbar pagination "
    "pager search copyright legal disclaimer skip outbrain taboola".split())
HEAD_NAMES = frozenset("header head".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

OUTSIDE, BESIDE, PLAIN, INSIDE = range(4)  # boilerplate container; beside an article; no article; in it


@dataclass
class Block:
    words: list[str] = field(default_factory=list)
    linked: int = 0
    place: int = PLAIN
    prose: bool = False

    @property
    def density(self) -> float:
        return self.linked / len(self.words) if self.words else 0.0


class _Ends:
    """Finds where tags end. A quote holds up to the next one like it, however far; one without is stray.

    Each search is done once for a page: ``last`` has the last place of each quote, ``plain`` the stretch
    without quotes and ``>`` read last, and ``failed`` the quotes from which no end was found.
    """

    def __init__(self, page: str):
        self.page, self.failed, self.plain = page, set(), (0, 0)
        self.last = {quote: page.rfind(quote) for quote in "\"'"}

    def find(self, at: int) -> int:
        """The place of the ``>`` of the tag with attributes from ``at``; -1 if there is none."""
        page, seen = self.page, []
        while True:
            if not self.plain[0] <= at <= self.plain[1]:
                self.plain = at, _PLAIN.match(page, at).end()
            at = self.plain[1]
            if at < len(page) and page[at] == ">":
                return at
            if at == len(page) or at in self.failed:
                self.failed.update(seen)
                return -1
            seen.append(at)
            quote = page[at]
            at = (page.find(quote, at + 1) if at < self.last[quote] else at) + 1


def _aside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's tag, role, class or id tells that it isn't the article."""
    if tag in ASIDE_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in MAIN_TAGS or tag in ("body", "html"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = {n.lower() for n in _NAME.findall(value)}
            if names & ASIDE_NAMES or not inside and names & HEAD_NAMES:
                return True
        elif name == "role" and value.lower() in ASIDE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and _HIDDEN.search(value.lower()):
            return True
    return " hidden" in f" {_ATTRIBUTE.sub('', attributes)} ".lower().replace("/", " ")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Block-level tags, and two line breaks in a row, part them;
    whatever a page leaves unclosed ends with the element around it."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]  # open elements with the place of what they hold
    opened: Counter[str] = Counter()
    text: list[tuple[str, bool]] = []
    anchors = breaks = 0
    found_main = False

    def close():
        if not text:
            return
        block = Block(place=stack[-1][1], prose=any(t in PROSE for t, _ in stack[-4:]))
        block.words = html.unescape("".join(part for part, _ in text)).split()
        block.linked = min(len(block.words), sum(len(html.unescape(part).split()) for part, is_link in text if is_link))
        text.clear()
        if block.words:
            out.append(block)

    def push(tag: str, place: int):
        stack.append((tag, place))
        opened[tag] += 1

    def pop(tag: str):
        """Closes the innermost open element of this name, with all in it."""
        while opened[tag]:
            last, _ = stack.pop()
            opened[last] -= 1
            if last == tag:
                return

    last_end = page.rfind(">")
    ends = _Ends(page)
    at, end, skip = 0, len(page), None
    while at < end:
        if skip:
            closing = re.compile(rf"</{skip}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at, skip = (closing.end() if closing else end), None
            continue
        start = page.find("<", at)
        start = end if start < 0 else start
        if start > at:
            plain = page[at:start]
            text.append((plain, anchors > 0))
            breaks = breaks if plain.isspace() else 0
        at = start
        if at == end:
            break
        found = _TOKEN.match(page, at) if at < last_end or page.startswith("<!--", at) else None
        stop = ends.find(found.end()) if found and found[2] else 0
        if not found or stop < 0:  # not markup
            at = at + 1 if at < last_end else end
            text.append((page[start:at], anchors > 0))
            continue
        tag, attributes = (found[2] or "").lower(), page[found.end():stop] if found[2] else ""
        at = stop + 1 if found[2] else found.end()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag not in INLINE:
                close()
                anchors = 0
                pop(tag)
            elif stack[-1][0] == tag:
                close()
                pop(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                skip = tag
            continue
        if tag in VOID:
            if tag == "br":
                breaks += 1
                text.append((" ", False))
            if tag == "hr" or breaks == 2:
                close()
            continue
        if tag in INLINE:
            anchors += tag == "a"
            if stack[-1][1] != OUTSIDE and _aside(tag, attributes, stack[-1][1] == INSIDE):
                close()  # an aside within a line is a block of its own
                push(tag, OUTSIDE)
            continue
        close()
        anchors = 0
        if stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            pop(stack[-1][0])
        place = stack[-1][1]
        if place != OUTSIDE and _aside(tag, attributes, place == INSIDE):
            place = OUTSIDE
        elif tag in MAIN_TAGS and place != OUTSIDE:
            place, found_main = INSIDE, True
        push(tag, place)
    close()
    if found_main:
        for block in out:
            if block.place == PLAIN:
                block.place = BESIDE
    return out


# --- decision tree ---------------------------------------------------------------------------

FEATURES = ("place", "prose", "words", "density", "words before", "density before", "words after", "density after")

#: A small labelled table: blocks (place, prose, words, density) whose label holds beside any neighbours, ...
ALONE = [
    # in an article: paragraphs and headings of any length, lines of lists, a linked reference
    *((INSIDE, 1, words, density, 1) for words in (1, 2, 4, 9, 20, 60, 200) for density in (0.0, 0.2, 0.5)),
    *((INSIDE, 0, words, density, 1) for words in (1, 3, 8, 25, 80) for density in (0.0, 0.25)),
    # in a container of boilerplate, or beside an article: menus, adverts, notices, comments, footers, forms
    *((place, prose, words, density, 0) for place in (OUTSIDE, BESIDE) for prose in (0, 1) for words in (1, 5, 30, 150) for density in (0.0, 1.0)),
    # on a page without an article: paragraphs; long text; lists of links
    *((PLAIN, 1, words, density, 1) for words in (2, 6, 14, 40, 120) for density in (0.0, 0.2)),
    *((PLAIN, 0, words, density, 1) for words in (22, 60, 150) for density in (0.0, 0.2)),
    *((PLAIN, prose, words, density, 0) for prose in (0, 1) for words in (1, 3, 8, 25) for density in (0.7, 1.0)),
]
#: ... the neighbours (words, density) they are written out with, ...
NEIGHBOURS = [(0, 0.0), (2, 1.0), (5, 0.0), (40, 0.0), (90, 0.1)]
#: ... and short blocks outside paragraphs, which are main text between long texts only:
#: words, density, words and density before and after, label.
BETWEEN = [
    (3, 0.0, 40, 0.0, 45, 0.0, 1), (6, 0.0, 60, 0.0, 30, 0.1, 1), (12, 0.1, 30, 0.0, 90, 0.0, 1), (9, 0.0, 90, 0.1, 60, 0.0, 1),
    (3, 0.0, 0, 0.0, 2, 1.0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0), (8, 0.0, 3, 1.0, 0, 0.0, 0), (5, 0.0, 70, 0.0, 0, 0.0, 0),
    (12, 0.1, 60, 0.0, 3, 1.0, 0), (9, 0.2, 5, 0.5, 4, 1.0, 0), (2, 0.0, 4, 0.0, 2, 0.0, 0), (6, 0.0, 2, 1.0, 40, 0.0, 0), (10, 0.0, 5, 0.0, 6, 0.0, 0),
]
LABELLED = np.array(
    [(*own[:4], *before, *after, own[4]) for own in ALONE for before in NEIGHBOURS for after in NEIGHBOURS]
    + [(PLAIN, 0, *row) for row in BETWEEN for _ in range(len(NEIGHBOURS))]
    + [(INSIDE, 0, words, 1.0, *before, *after, int(before[1] < 0.9 and after[1] < 0.9)) for words in (2, 5) for before in NEIGHBOURS for after in NEIGHBOURS],
    float)


@dataclass
class Node:
    """A leaf with its ``answer``, or a split: rows with ``feature <= at`` go to ``low``."""

    answer: bool
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, label: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A classification tree: the split of least Gini impurity, until a node is pure."""
    node = Node(bool(2 * label.sum() >= len(label)))
    if depth == 0 or label.min() == label.max():
        return node
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for at in (values[1:] + values[:-1]) / 2:
            left = rows[:, feature] <= at
            n, m = left.sum(), (~left).sum()
            if min(n, m) < least:
                continue
            p, q = label[left].mean(), label[~left].mean()
            cost = n * p * (1 - p) + m * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = cost, feature, at
    if best is None:
        return node
    _, node.feature, node.at = best
    left = rows[:, node.feature] <= node.at
    node.low, node.high = grow(rows[left], label[left], depth - 1, least), grow(rows[~left], label[~left], depth - 1, least)
    return node


def decide(node: Node, row: tuple) -> bool:
    while node.low is not None:
        node = node.low if row[node.feature] <= node.at else node.high
    return node.answer


TREE = grow(LABELLED[:, :-1], LABELLED[:, -1])


def main_text(page: str, tree: Node = TREE) -> str:
    """The blocks that the tree takes for main text, one to a line."""
    found = blocks(page)
    sizes = [(len(b.words), b.density) for b in found]
    before, after = [(0, 0.0), *sizes[:-1]], [*sizes[1:], (0, 0.0)]
    kept = [b for b, own, x, y in zip(found, sizes, before, after) if decide(tree, (b.place, float(b.prose), *own, *x, *y))]
    return "\n".join(" ".join(b.words) for b in kept)


def extract(pages: DataFrame, tree: Node = TREE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A page is cut into flat text blocks. A block's word count and link density, those of the blocks
    before and after it, and the kind of its container go to the decision tree. Character references
    are decoded and white space in a block is one space; blocks are joined by a line feed.

    Null and empty pages, and pages without main text, have an empty text. Repeated rows and null ids
    or urls are kept; other columns are not read; an empty table gives an empty result.
    """

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            found = [main_text(t.decode(), tree) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"), F.col("url").cast("string"))
    return rows.mapInArrow(made, "page_id long, url string, text string, n_chars long")
