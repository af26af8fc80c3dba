"""HTML extraction by layout-aware rendering.

A tree builder reads the markup with the implied end tags of paragraphs, list items, definitions, options and table parts;
visibility rules leave out what a browser does not show (head, scripts, styles, templates, ``hidden``, ``display:none``,
``visibility:hidden`` or ``collapse``, closed details); a renderer walks the tree and writes all visible text: white space collapses except in
``pre`` and ``textarea``, blocks start lines, paragraphs and headings stand apart, list items carry their bullet or number and
their depth, and the cells of a table are aligned in columns.

Defined results: a null page is an empty text; broken markup is text or closes where its parent does, never an error; depth
is not limited (no recursion); a page without tags is its own text, collapsed; rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes meta link base datalist object audio video canvas svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dir dl table figure hr xmp".split())
# An open element of the value ends when one of the key begins, unless a wall stands between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, "body": {"head"},
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
WALLS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
_TABLE_WALL = {"table"}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "p"} | {"p"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


class Builder:
    """A stack of open elements over a growing tree."""

    def __init__(self) -> None:
        self.root = Node("", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def close_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def close_implied(self, ends: set[str], wall: set[str]) -> None:
        if not any(self.count.get(t, 0) for t in ends):
            return
        last = 0
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in ends:
                last = at
            elif tag in wall:
                break
        if last:
            self.close_to(last)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CLOSES_P and self.count.get("p"):
            self.close_implied({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in ENDS:
            self.close_implied(ENDS[tag], WALLS.get(tag, _TABLE_WALL))
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self.count.get("p"):
            self.start("p", {}), self.end("p")
        elif self.count.get(tag):
            wall = () if tag == "table" or tag in ("html", "body") else _TABLE_WALL
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == tag:
                    return self.close_to(at)
                if self.open[at].tag in wall:  # an end tag inside a table does not close what is around it
                    return None

    def text(self, value: str) -> None:
        self.open[-1].children.append(value)


def parse(page: str) -> Node:
    """The element tree of a page."""
    build, at = Builder(), 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            build.text(html.unescape(page[at : m.start()]))
        at = max(m.end(), at + 1)
        if m[1]:
            build.end(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            attrs = attributes(m[3]) if m[3].strip() else {}
            build.start(tag, attrs)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                inner = page[at : stop.start()] if stop else page[at:]
                build.text(html.unescape(inner) if tag in ("textarea", "title") else inner)
                at = stop.start() if stop else len(page)
        if at >= len(page):
            break
    if at < len(page):
        build.text(html.unescape(page[at:]))
    return build.root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return False
    return not (node.attrs.get("style") and _HIDING.search(node.attrs["style"])) and not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


class Writer:
    """Lines with pending breaks: 1 for a new line, 2 for an empty line between."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.gap, self.indent, self.mark, self.fresh = 0, False, 0, "", True

    def rule(self, n: int) -> None:
        if not self.fresh:
            self.breaks = max(self.breaks, n)
        self.gap = False

    def put(self, text: str) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
        if self.breaks or self.fresh:
            room = " " * max(0, 2 * (self.indent - 1))
            self.parts.append(room + self.mark if self.mark else "  " * self.indent)
            self.mark = ""
        elif self.gap:
            self.parts.append(" ")
        self.parts.append(text)
        self.breaks, self.gap, self.fresh = 0, False, False

    def flow(self, text: str) -> None:
        body = _SPACE.sub(" ", text)
        if not body:
            return
        if body[0] == " ":
            self.gap = True
        core = body.strip(" ")
        if core:
            self.put(core)
            self.gap = body[-1] == " "

    def lines(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.breaks += 1
            if line:
                self.put(line)

    def text(self) -> str:
        return "".join(self.parts)


WIDE = 40  # a longer cell does not widen its column


def aligned(rows: list[list[str]]) -> list[str]:
    """Table rows as lines with padded columns."""
    width: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(width):
                width.append(0)
            if len(cell) <= WIDE:
                width[k] = max(width[k], len(cell))
    return ["  ".join(c.ljust(width[k]) for k, c in enumerate(row)).rstrip() for row in rows]


def render(root: Node) -> str:
    """All visible text of a tree."""
    writers = [Writer()]
    lists: list[list] = []
    tables: list[list[list[str]]] = []
    pre = 0
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        out = writers[-1]
        if isinstance(node, str):
            out.lines(node) if pre else out.flow(node)
            continue
        tag = node.tag
        if entering:
            if not visible(node):
                continue
            stack.append((node, False))
            children = node.children
            if tag == "details" and "open" not in node.attrs:  # only the summary shows
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.extend((c, True) for c in reversed(children))
            if tag == "br":
                out.breaks += not out.fresh
                out.gap = False
            elif tag in ("td", "th") and tables:
                writers.append(Writer())
                if not tables[-1]:
                    tables[-1].append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                out.rule(2)
                tables.append([])
            elif tag in BLOCK:
                out.rule(2 if tag in APART and not (tag in ("ul", "ol", "menu", "dir") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                out.indent += 1
            elif tag == "li":
                ordered = lists[-1] if lists else [False, 0]
                out.mark = f"{ordered[1]}. " if ordered[0] else "- "
                ordered[1] += 1
            elif tag in ("blockquote", "dd"):
                out.indent += 1
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            continue
        if tag in ("td", "th") and tables:
            cell = _SPACE.sub(" ", writers.pop().text()).strip()
            tables[-1][-1].append(cell)
            span = node.attrs.get("colspan", "")
            tables[-1][-1].extend([""] * (min(int(span), 1000) - 1 if re.fullmatch(r"[1-9]\d{0,3}", span) else 0))
        elif tag == "table":
            for line in aligned([r for r in tables.pop() if any(r)]):
                out.rule(1 if out.breaks < 2 else 2)
                out.put(line)
            out.rule(2)
        elif tag == "tr" and tables:
            pass
        elif tag in BLOCK:
            out.rule(2 if tag in APART and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > 1) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            out.indent -= 1
        elif tag == "li":
            out.mark = ""
        elif tag in ("blockquote", "dd"):
            out.indent -= 1
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
    return writers[0].text()


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p.as_py()) for p in batch["html"]]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_page_batches, "page_id bigint, url string, text string")
