"""HTML extraction by tree scoring.

A page is parsed into a tree (tolerantly: void elements, implied ends of p, li,
td and the like, unclosed and stray tags, raw text of scripts). Every paragraph
of PARAGRAPH characters or more (white space folded) gives points, one and one for each comma and for
each hundred characters up to three, to its parent, half of them to its
grandparent and a third to the element above. An element's score starts from its
tag and its class and id names and is discounted by its link density. The best
container is kept together with siblings that score well or read like text;
the result is the text of their blocks, one a line. A form counts like any other
container unless it holds less than FORM characters or mostly links.

Parsing takes time in proportion to the page, whatever it holds: the scanner never
goes back, and what end tags and implied ends look for among the open elements is
kept with each element.

Defined results: NULL html gives NULL text and title and score 0; a page without
any container gives the text of its body blocks outside navigation and the like,
'' for an empty page; the first of equal containers in document order wins; a tag
that another < ends, or the end of the page, before its > is text; repeated rows are
extracted alike; an empty table gives an empty result. Pages of any length are read
whole. Input columns named title, text, score or paragraphs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from .common import carry, others, table

PARAGRAPH, FORM = 25, 250
# Possessive, so that a place is never tried twice. Values hold a < only between well-placed quotes; a lone quote is a character.
_TAG = re.compile(r"""<(?:(/?)([A-Za-z][^\s/><]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|(?<==)"[^"]*+"(?=[\s/>])|(?<==)'[^']*+'(?=[\s/>])|["'])*+)(>?)|!--.*?(?:-->|\Z)|[!?][^>]*+>?)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"\bad\b|\bads\b|advert|banner|comment|contact|cookie|foot|nav|menu|meta|promo|related|share|shopping|sidebar|social|sponsor|tags|widget|popup", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg".split())
_SKIP = frozenset("nav footer aside button select option dialog head title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Implied ends, by family: a tag of the family ends the highest open element of the first set below one of the second.
_CLOSES = (({"li"}, {"ul", "ol"}), ({"dt", "dd"}, {"dl"}), ({"option"}, {"select"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}))
_FAMILY = {"li": 0, "dt": 1, "dd": 1, "option": 2, "tr": 3, "td": 4, "th": 4}
_TOUCHED = frozenset().union(*(x | y for x, y in _CLOSES))
_HOLDS = frozenset("td th li div section article main body button".split())
_START = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?](\s|$)")


class Node:
    """An element. open_p and open_ends are what it and the elements above it leave to be ended: a p, and one of each family."""

    __slots__ = ("tag", "names", "up", "parts", "points", "size", "linked", "commas", "block", "open_p", "open_ends")

    def __init__(self, tag: str, names: str, up: "Node | None"):
        self.tag, self.names, self.up = tag, names, up
        self.parts: list[Node | str] = []
        self.points: float | None = None
        self.size = self.linked = self.commas = 0
        self.block = False
        self.open_p: Node | None = self if tag == "p" else up.open_p if up is not None and tag not in _HOLDS else None
        ends = up.open_ends if up is not None else (None,) * len(_CLOSES)
        if tag in _TOUCHED:
            ends = tuple(None if tag in until else have or (self if tag in own else None) for have, (own, until) in zip(ends, _CLOSES))
        self.open_ends: tuple[Node | None, ...] = ends


def parse(html: str) -> tuple[Node, str]:
    """(root, title) of a page."""
    root = at = Node("html", "", None)
    title, pos = "", 0
    opened: dict[str, int] = {}
    endless: set[str] = set()

    def close(node: Node) -> Node:
        """Ends an open element and those within it."""
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.up
        opened[node.tag] -= 1
        at = node.up
        return at

    while (m := _TAG.search(html, pos)) is not None:
        if m.start() > pos:
            at.parts.append(html[pos : m.start()])
        pos = m.end()
        name = m[2]
        if not name:
            continue
        if not m[4]:
            at.parts.append(m[0])
            continue
        tag = name.lower()
        if m[1]:
            if opened.get(tag):
                node = at
                while node.tag != tag:
                    node = node.up
                close(node)
            continue
        alone = m[3].endswith("/")
        if tag == "svg" and alone:
            continue
        if tag in _RAW or tag == "title":
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            if end is None:
                endless.add(tag)
            if tag == "title" and end and not title:
                title = _SPACE.sub(" ", unescape(html[pos : end.start()])).strip()
            if tag != "title" or end:
                pos = end.end() if end else len(html)
            continue
        if tag in ("html", "body") and not m[3]:
            continue
        if tag in _BLOCK and at.open_p is not None:
            close(at.open_p)
        family = _FAMILY.get(tag)
        if family is not None and at.open_ends[family] is not None:
            close(at.open_ends[family])
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else ""
        node = Node(tag, names, at)
        at.parts.append(node)
        if tag not in _VOID and not alone:
            at = node
            opened[tag] = opened.get(tag, 0) + 1
    if pos < len(html):
        at.parts.append(html[pos:])
    return root, title


def _order(root: Node) -> list[Node]:
    """All elements, parents before children, in document order, without skipped ones."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        node.parts = [p for p in node.parts if isinstance(p, str) or not _skipped(p)]
        stack += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return out


def _skipped(node: Node) -> bool:
    if node.tag in _SKIP:
        return True
    return bool(node.names) and node.tag not in ("article", "main") and bool(_BAD.search(node.names)) and not _GOOD.search(node.names)


def _bare_form(node: Node) -> bool:
    """Whether a measured element is a form of little text or mostly links, such as a login or a search."""
    return node.tag == "form" and (node.size < FORM or node.linked * 2 > node.size)


def _flat(node: Node) -> str:
    """The text of an element, white space folded; iterative, as pages can nest deeply."""
    out, stack = [], [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        if part.tag == "br" or part.tag in _BLOCK:
            out.append(" ")
            stack.append(" ")
        stack += reversed(part.parts)
    text = "".join(out)
    return _SPACE.sub(" ", unescape(text) if "&" in text else text).strip()


def _lines(node: Node) -> list[str]:
    """Texts of the lowest blocks in order; text beside blocks makes lines of its own."""
    lines, run, stack = [], [], [node]

    def close() -> None:
        text = "".join(run)
        text = _SPACE.sub(" ", unescape(text) if "&" in text else text).strip()
        if text:
            lines.append(text)
        run.clear()

    while stack:
        part = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif part.tag in _BLOCK:
            close()
            stack.append(None)
            stack += reversed(part.parts)
        else:
            stack += reversed(part.parts)
    close()
    return lines


def extract(html: str) -> tuple[str, str, float, int]:
    """(title, text, score of the best container, paragraphs that gave points)."""
    root, title = parse(html)
    nodes = _order(root)
    dropped = False
    for node in reversed(nodes):
        own = [p for p in node.parts if isinstance(p, str) or not _bare_form(p)]
        dropped |= len(own) < len(node.parts)
        node.parts = own
        for part in own:
            if isinstance(part, str):
                if not part.isspace():
                    text = _SPACE.sub(" ", unescape(part) if "&" in part else part)
                    node.size += len(text)
                    node.commas += text.count(",")
            else:
                node.size += part.size
                node.commas += part.commas
                node.linked += part.size if part.tag == "a" else part.linked
                node.block |= part.block or part.tag in _BLOCK
    if dropped:
        nodes = _order(root)
    paragraphs = 0
    for node in nodes:
        if not (node.tag in ("p", "pre", "td") or (node.tag == "div" and not node.block)) or node.size < PARAGRAPH or node.up is None:
            continue
        paragraphs += 1
        points = (1 + node.commas + min(node.size // 100, 3)) * (1 - node.linked / max(1, node.size))
        up, share = node.up, (1, 2, 3)
        for part in share:
            if up is None:
                break
            if up.points is None:
                up.points = _START.get(up.tag, 0) + (25 if up.names and _GOOD.search(up.names) else 0) - (25 if up.names and _BAD.search(up.names) else 0)
            up.points += points / part
            up = up.up
    best, top = None, 0.0
    for node in nodes:
        if node.points is not None:
            node.points *= 1 - node.linked / max(1, node.size)
            if best is None or node.points > top:
                best, top = node, node.points
    if best is None:
        return title, "\n".join(_lines(root)), 0.0, 0
    kept = [best]
    if best.up is not None:
        kept, least = [], max(10.0, top * 0.2)
        for part in best.up.parts:
            if isinstance(part, str):
                continue
            if part is best:
                kept.append(part)
                continue
            bonus = top * 0.2 if best.names and part.names == best.names else 0
            if part.points is not None and part.points + bonus >= least:
                kept.append(part)
            elif part.tag == "p":
                text, density = _flat(part), part.linked / max(1, part.size)
                if len(text) > 80 and density < 0.25 or 0 < len(text) <= 80 and density == 0 and _SENTENCE.search(text):
                    kept.append(part)
    return title, "\n".join(line for part in kept for line in _lines(part)), float(top), paragraphs


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages without html, with title, text, score and paragraphs."""
    rest = others(pages, "html", "title", "text", "score", "paragraphs")

    def work(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        found = [(None, None, 0.0, 0) if h is None else extract(h) for h in b.column(0).to_pylist()]
        cols = list(zip(*found)) or [(), (), (), ()]
        yield b, [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int32()))]

    return carry(pages, [F.col("html").cast("string")], rest, work, [("title", StringType()), ("text", StringType()), ("score", DoubleType()), ("paragraphs", IntegerType())])


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html": op4_html}
ORACLE_SQL: dict[str, str] = {}
