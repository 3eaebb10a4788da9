"""Main text of web pages by composite text density.

A page becomes a tree; what never belongs to an article (scripts, menus, page
headers, footers, sidebars, notices, adverts, forms, reader comments) is cut by
element, role and class name.  A frame so named, or a form, that holds the article
or most of the page's text is none of these, and if cuts by name leave no text,
the outermost of them are taken back.  A header within an article is the
article's own and stays.  On paragraphs and headings a name that only contains
such a word does not cut: it halves the density, and what is then thinner than
the page and the threshold below, or a third link text, goes.  Every other node has its characters per tag,
adjusted by the share of its link text; a node's density sum is the sum of its
children's densities.  The subtree with the largest sum is chosen.  The least
density on the path from it to the body is the threshold: the chosen node
widens to its parent as long as the parent's other children reach it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset(
    "script style noscript template head title iframe object embed svg canvas audio video "
    "nav header footer aside form button input select textarea dialog menu".split()
)
SECTIONS = frozenset("article main body".split())
# Roles and words of class or id names that mark what is not the article.
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split()
)
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "share sharing social cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments reply replies respond disqus copyright legal "
    "pagination pager skip toolbar".split()
)
# The words that count on an article itself: readers' comments and teasers are often articles.
ARTICLE_MARKS = frozenset(
    "ad ads advert advertisement sponsored promo comment comments reply replies respond related teaser".split()
)
# With one of these a header is the article's, not the page's.
CONTENT_WORDS = frozenset("article content entry post story".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
# Elements that begin and end a block; unknown elements don't.
BLOCKS = PARAGRAPHS | frozenset(
    "html body main article section div nav header footer aside address ul ol dl menu table thead tbody tfoot tr "
    "colgroup form fieldset legend details summary dialog figure center dir hgroup hr noscript search optgroup option "
    "select frameset noframes listing plaintext xmp template iframe textarea button title head".split()
)
COMMENT_MARKS = frozenset("comment comments reply replies respond disqus".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?=[!?])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)",
    re.S,
)
_PAIR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!?)", re.I)
_NAMES = re.compile(r"[a-z]+")
# What follows says what a node has beside or within it: has-sidebar, page-no-header.
_BESIDE = re.compile(r"(?<![a-z])(?:has|no|with|without)[-_]\S*")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "skipped", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent")

    def __init__(self, tag: str, parent: Node | None, skipped: int):
        self.tag, self.parent = tag, parent
        self.skipped, self.marked = (0, True) if skipped == _LOWERED else (skipped, False)
        self.parts: list[Node | str] = []

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if not isinstance(p, str) and not p.skipped)


_BY_NAME, _BY_TAG, _LOWERED = 1, 2, 3
# What a name takes off a paragraph's density, and the share of link text that a paragraph so named may have.
MARKED_DENSITY, MARKED_LINKS = 0.5, 1 / 3


def _attributes(text: str) -> dict[str, str]:
    """Values by name in lower case; the first of a name counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, *values in _PAIR.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    # the last declaration counts, or the last important one
    shown = _DISPLAY.findall(attributes.get("style", ""))
    return bool(shown) and ([d for d in shown if d[1]] or shown)[-1][0].lower() == "none"


def _boilerplate(tag: str, attributes: str) -> int:
    """Not (0), by a role, class or id (``_BY_NAME``), whatever it holds (``_BY_TAG``), or as its density has it (``_LOWERED``)."""
    if tag in SKIPPED and tag != "form":
        return _BY_TAG
    if not attributes or tag in ("html", "body", "main"):
        return _BY_NAME if tag == "form" else 0
    values = _attributes(attributes)
    if _hidden(values):
        return _BY_TAG
    if tag == "form":
        return _BY_NAME
    marks = ARTICLE_MARKS if tag == "article" else MARKS
    for name in [n for n in values if n in ("class", "id", "role")]:
        value = values[name].strip().lower()
        words = _NAMES.findall(_BESIDE.sub(" ", value))
        found = marks.intersection(words)
        if name == "role":
            if value in ROLES:
                return _BY_NAME
        elif found and not (found == {"header"} and not CONTENT_WORDS.isdisjoint(words)):
            if not COMMENT_MARKS.isdisjoint(words):
                return _BY_TAG
            return _LOWERED if tag in PARAGRAPHS and found.isdisjoint(value.split()) else _BY_NAME
    return 0


def parse(page: str) -> Node:
    """The tree of a page, with the end tags that HTML lets authors leave out."""
    root = Node("html", None, 0)
    at, node, end = 0, root, len(page)
    opened = _Open()
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            node.parts.append(page[at:stop])
        if not found:
            break
        at = found.end()
        slash, tag, attributes = found[1], found[2], found[3]
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            node = opened.left(node, _close(node, tag) if opened.may_close(tag) else node)
            continue
        if tag in _SAME or tag in _CLOSES_P and opened.total["p"]:
            node = opened.left(node, _implied(node, tag))
        cut = _boilerplate(tag, attributes)
        child = Node(tag, node, 0 if tag == "header" and cut == _BY_TAG and opened.total["article"] else cut)
        if tag in ("article", "main") and not child.skipped:
            _keep_around(node)
        node.parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            child.parts.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
            opened.entered(tag)
    return root


class _Open:
    """How many elements of each name are open, in all and since the last section began.

    An end tag without an open element is passed over without a walk up the tree.
    """

    def __init__(self):
        self.total: Counter = Counter()
        self.sections: list[Counter] = [Counter()]

    def entered(self, tag: str) -> None:
        self.total[tag] += 1
        if tag in SECTIONS:
            self.sections.append(Counter())
        self.sections[-1][tag] += 1

    def may_close(self, tag: str) -> bool:
        return (self.sections[-1] if tag in INLINE else self.total)[tag] > 0

    def left(self, node: Node, to: Node) -> Node:
        while node is not to:
            self.total[node.tag] -= 1
            self.sections[-1][node.tag] -= 1
            if node.tag in SECTIONS and len(self.sections) > 1:
                self.sections.pop()
            node = node.parent
        return to


def _keep_large(root: Node) -> None:
    """Without an article or main part, a frame cut by name that holds over half of the text is a frame of it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if not isinstance(p, str) and p.skipped != _BY_TAG)
    if any(n.tag in ("article", "main") and not n.skipped for n in order):
        return
    for node in reversed(order):
        node.chars = sum(len(p.strip()) if isinstance(p, str) else 0 if p.skipped == _BY_TAG else p.chars for p in node.parts)
    for node in order:
        if node.skipped == _BY_NAME and 2 * node.chars > root.chars:
            node.skipped = 0


def _keep_around(node: Node | None) -> None:
    """A frame named for its sidebar or header is no boilerplate if it holds the article."""
    around, walk = [], node
    while walk is not None:
        if walk.skipped == _BY_TAG or walk.tag == "article":
            return
        around.append(walk)
        walk = walk.parent
    for frame in around:
        frame.skipped = 0


def _close(node: Node, tag: str) -> Node:
    """The node after an end tag; one that closes nothing is ignored."""
    found: Node | None = node
    while found is not None and found.tag != tag:
        if found.tag in SECTIONS and tag in INLINE:
            return node
        found = found.parent
    return found.parent if found is not None and found.parent is not None else node


def _implied(node: Node, tag: str) -> Node:
    """The node in which a start tag lands, after the end tags it implies."""
    walk: Node | None = node
    if tag in _SAME:
        while walk is not None and walk.tag not in _SAME[tag] and walk.tag not in SECTIONS:
            if walk.tag == tag or {walk.tag, tag} <= {"td", "th"} or {walk.tag, tag} <= {"dt", "dd"}:
                return walk.parent or node
            walk = walk.parent
        return node
    while walk is not None and (walk.tag == "p" or walk.tag in INLINE):
        if walk.tag == "p":
            return walk.parent or node
        walk = walk.parent
    return node


def _measure(root: Node) -> list[Node]:
    """Characters, tags, link characters and link tags of every kept node; in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(list(node.children())))
    for node in reversed(order):
        node.chars = sum(len(_SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        node.tags = node.link_chars = node.link_tags = 0
        for child in node.children():
            node.chars += child.chars
            node.tags += child.tags + 1
            node.link_chars += child.link_chars
            node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    return order


def _density(node: Node, page_ratio: float) -> float:
    if not node.chars:
        return 0.0
    tags, links = max(1, node.tags), max(1, node.link_tags)
    plain = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / plain * node.link_chars + page_ratio * node.chars + math.e)
    adjusted = node.chars / max(1, node.link_chars) * tags / links
    return node.chars / tags * math.log(max(adjusted, 1.0 + 1e-9)) / math.log(base + 1.0)


def main_node(root: Node) -> Node | None:
    """The chosen subtree, or None for a page without text."""
    order = _measure(root)
    if not root.chars:
        return None
    ratio = root.link_chars / root.chars
    for node in order:
        node.density = _density(node, ratio)
    best = None
    for node in order:
        node.total = sum(c.density for c in node.children())
        if node.tag in INLINE or node.tag == "p":
            continue
        if best is None or node.total > best.total:
            best = node
    threshold, walk = best.density, best
    held = best
    while walk.parent is not None and walk.tag != "body":
        threshold = min(threshold, walk.density)
        walk = walk.parent
    # a subtree that holds one part of an article alone leaves dense siblings outside
    while best.tag not in SECTIONS and best.parent is not None:
        if not _worthy(best, threshold):
            break
        best = best.parent
    for node in order:
        if node.marked and node is not held:
            thin = MARKED_DENSITY * node.density < min(threshold, root.density)
            node.skipped = _BY_NAME if thin or node.link_chars > MARKED_LINKS * node.chars else 0
    return best


def _worthy(node: Node, threshold: float) -> bool:
    parent = node.parent
    if any(isinstance(p, str) and p.strip() for p in parent.parts):
        return True
    return parent.tag in SECTIONS or any(c is not node and c.density >= threshold for c in parent.children())


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, decoded, with single spaces."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif not part.skipped:
            block = part.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(part.parts))
    flush()
    return out


def _undo_names(root: Node) -> None:
    """Take back cuts by name, the outermost first, until there is text; cuts within those stay."""
    level, held = [root], False
    while level and not held:
        inner = []
        for node in level:
            node.skipped = 0
            stack = [node]
            while stack:
                for part in stack.pop().parts:
                    if isinstance(part, str):
                        held = held or bool(html.unescape(part).strip())
                    elif not part.skipped:
                        stack.append(part)
                    elif part.skipped == _BY_NAME:
                        inner.append(part)
        level = inner


def main_text(page: str) -> str:
    """The article of a page: its blocks, one per line; empty if there is none."""
    root = parse(page)
    _keep_large(root)
    for again in (False, True):
        if again:
            _undo_names(root)
        node = main_node(root)
        text = "" if node is None else "\n".join(blocks(node))
        if text:
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Work and memory grow with a page's length, however long it is.  Null, empty and textless pages give an empty text of 0 characters.  Rows are
    independent, so repeated rows repeat; an empty table gives no rows; other
    columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
