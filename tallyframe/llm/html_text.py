"""HTML extraction: tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path. Text length and punctuation are added up
per path and divided by the blocks that share it; the two series are smoothed along the page, fused by their
product and cut at a threshold, which selects the content blocks. The article is the ``article`` or ``main`` around
most of their weight, or else the element around all of them but those of a low fused ratio; everything in it counts
but elements that are never main text (menus, page headers, footers, asides, forms, scripts, notices, adverts, reader
comments), by their tag, role or name. The name of an element that holds most of the prose says nothing, unless it
names reader comments.

Defined cases: a null or empty page, or one without main text, gives an empty text; markup that is cut off or not
closed is read as far as it goes; pages are read whole, in time proportional to their length; repeated rows are
read one by one; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import map_rows

#: Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html head body option legend caption td th tr tbody thead tfoot summary figcaption".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article main section div body html".split())
NEVER = frozenset("head nav footer aside form script style noscript template button select menu dialog svg math object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup overlay modal "
    "newsletter subscribe signup login sidebar aside menu nav navbar navigation navi breadcrumb breadcrumbs header masthead footer related recommended recommendations "
    "share sharing social widget widgets toolbar pagination pager search copyright skip".split()
)
ARTICLES = frozenset(("article", "main"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))|(\bhidden\b)""")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¡¿\"'()–—-]")
_PART = re.compile(r"[^a-z0-9]+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    path: int  # number of its tag path
    never: bool  # by tag or role
    named: int  # by the name of a class or id; 2 whatever it holds
    depth: int


@dataclass
class Block:
    text: str
    node: Node
    path: int


@dataclass
class Settings:
    sigma: float = 1.0
    reach: int = 2
    cut: float = 0.8  # of the standard deviation of the fused ratios
    most: float = 0.8  # of the content's weight that shows where the article is
    low: float = 0.25  # of the median fused ratio there; what has less outside is an outlier
    prose: int = 70  # characters, with punctuation, of a block that shows that a name is wrong
    names: frozenset = field(default_factory=lambda: NAMES)


def _marks(attributes: str) -> tuple[str, set[str], bool]:
    """Role, parts of class and id names, hidden."""
    role, parts, hidden = "", set(), False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if bare:
            hidden = True
        elif name == "role":
            role = value.strip()
        elif name in ("class", "id"):
            for word in value.split():
                bits = [x for x in _PART.split(word) if x]
                if bits:
                    parts |= {bits[0], bits[-1]}
        elif (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return role, parts, hidden


def blocks(page: str, settings: Settings) -> list[Block]:
    """The blocks of a page in order, without elements that are never main text."""
    root = node = Node("", None, 0, False, 0, 0)
    paths: dict[tuple[int, str], int] = {}
    out: list[Block] = []
    pieces: list[str] = []
    at: Node | None = None

    def flush() -> None:
        nonlocal at
        text = " ".join(html.unescape("".join(pieces)).split())
        if text and at is not None:
            out.append(Block(text, at, at.path))
        pieces.clear()
        at = None

    def add(text: str) -> None:
        nonlocal at
        if text and not node.never:
            if at is None and not text.isspace():
                at = node
            pieces.append(text)

    def close(tags: set[str] | frozenset, scope: frozenset) -> None:
        """Leave the innermost of these elements, unless an element of the scope is met first."""
        nonlocal node
        n = node
        while n.parent is not None:
            if n.tag in tags:
                node = n.parent
                return
            if n.tag in scope:
                return
            n = n.parent

    position, end = 0, len(page)
    while position < end:
        m = _TAG.search(page, position)
        if m is None:
            add(page[position:])
            break
        add(page[position : m.start()])
        position = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in BLOCKS:
                flush()
            if tag not in VOID:
                close({tag}, frozenset(("article", "main", "body")) - {tag} if tag in ("p", "li", "div", "span", "b", "i", "a") else frozenset())
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                close({"p"}, SCOPES | {"li", "td", "th"})
            if tag in SAME:
                close(SAME[tag] if tag != "tr" else {"tr"}, SCOPES)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, position)
            position = stop.end() if stop else end
            continue
        role, parts, hidden = _marks(attributes) if attributes else ("", set(), False)
        inside = node
        while inside.parent is not None and inside.tag not in ARTICLES:
            inside = inside.parent
        never = node.never or tag in NEVER or role in ROLES or hidden or (tag == "header" and inside.tag not in ARTICLES)
        names = COMMENTS if tag in ("article", "main", "body", "html") else settings.names - {"header"} if inside.tag in ARTICLES else settings.names
        named = 2 if parts & COMMENTS and tag not in ("article", "main", "body", "html") else int(bool(parts & names))
        key = (node.path, tag)
        node = Node(tag, node, paths.setdefault(key, len(paths) + 1), never, named, node.depth + 1)
        if attributes.endswith("/") and tag not in BLOCKS:
            node = node.parent
    flush()
    del root
    return out


def ratios(found: list[Block], settings: Settings) -> list[float]:
    """The fused ratio of every block: smoothed text length times smoothed punctuation of its path."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
    kernel = [math.exp(-(k * k) / (2 * settings.sigma**2)) for k in range(-settings.reach, settings.reach + 1)]
    text = _smooth([length[b.path] / count[b.path] for b in found], kernel)
    punctuation = _smooth([(marks[b.path] + 1) / count[b.path] for b in found], kernel)
    return [t * p for t, p in zip(text, punctuation)]


def _smooth(values: list[float], kernel: list[float]) -> list[float]:
    reach, out = len(kernel) // 2, []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel):
            j = i + k - reach
            if 0 <= j < len(values):
                total += w * values[j]
                weight += w
        out.append(total / weight)
    return out


def _unnamed(every: list[Block], settings: Settings) -> list[Block]:
    """The blocks in no element whose name says that it is not main text."""
    prose = [b for b in every if len(b.text) >= settings.prose and _PUNCTUATION.search(b.text)]
    held: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in prose:
        n: Node | None = b.node
        while n is not None:
            held[id(n)] = held.get(id(n), 0) + len(b.text)
            count[id(n)] = count.get(id(n), 0) + 1
            n = n.parent
    total = sum(len(b.text) for b in prose)
    marked: dict[int, bool] = {}

    def is_marked(node: Node) -> bool:
        way, n = [], node
        while n is not None and id(n) not in marked:
            way.append(n)
            n = n.parent
        above = n is not None and marked[id(n)]
        for n in reversed(way):
            above = marked[id(n)] = above or n.named == 2 or n.named == 1 and not (count.get(id(n), 0) > 1 and 2 * held[id(n)] > total)
        return above

    return [b for b in every if not is_marked(b.node)]


def main_text(page: str | None, settings: Settings = Settings()) -> str:
    found = _unnamed(blocks(page or "", settings), settings)
    if not found:
        return ""
    fused = ratios(found, settings)
    mean = sum(fused) / len(fused)
    cut = min(settings.cut * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), 0.5 * max(fused))
    weight: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    total = 0.0
    for b, f in zip(found, fused):
        if f >= cut:
            n: Node | None = b.node
            total += len(b.text)
            while n is not None:
                weight[id(n)] = weight.get(id(n), 0.0) + len(b.text)
                nodes[id(n)] = n
                n = n.parent
    article = max((n for n in nodes.values() if weight[id(n)] >= settings.most * total), key=lambda n: n.depth)
    n = article
    while n is not None:  # a paragraph alone is not the article; nor are two of its sections
        if n.tag in ARTICLES:
            article = n
            break
        n = n.parent
    else:
        least = settings.low * median(f for b, f in zip(found, fused) if f >= cut and _within(b.node, article))
        for b, f in zip(found, fused):
            if f >= max(cut, least) or b.node.tag == "h1":
                while not _within(b.node, article):
                    article = article.parent
        while article.parent is not None and article.tag in BLOCKS - {"div", "section", "body", "td", "html"} or article.tag not in BLOCKS and article.parent is not None:
            article = article.parent
    return "\n".join(b.text for b in found if _within(b.node, article))


def _within(node: Node | None, element: Node) -> bool:
    while node is not None and node.depth >= element.depth:
        if node is element:
            return True
        node = node.parent
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """id, url and the main text of every page."""

    def rows(flow: Iterator[tuple]) -> Iterator[tuple]:
        for i, url, page in flow:
            yield i, url, main_text(page, settings)

    chosen = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return map_rows(chosen, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string", rows, batch=200)
