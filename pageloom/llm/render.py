"""Layout-aware text of HTML pages.

A tree builder with implied end tags turns a page into elements; a renderer
walks the tree without recursion and emits all visible text: blocks on their
own lines, paragraphs apart, list items with markers and indents, tables with
aligned columns, preformatted text as it stands.

Visibility: scripts, styles, head data, templates, closed dialogs and the like
never show; ``hidden`` and ``display: none`` hide a subtree; ``visibility:
hidden`` hides text until a descendant turns it visible; a closed ``details``
shows its summary; a ``select`` shows its selected or first option. The text
of ``math``, ``svg`` and ``map`` shows, without titles, descriptions,
annotations and definitions.

Tags that may be left out: ``head`` ends at the first text or start tag that it
cannot hold, ``colgroup`` at all but ``col``; ``/>`` closes ``svg``, ``math``
and what is inside them.

Defined cases: a null or empty page gives an empty text; broken markup is
closed at the end of the page and unmatched end tags are ignored; any depth and
length is read whole; repeated rows are rendered each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import read_columns

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_SPACES = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object canvas audio video datalist "
                   "meta link base param source track colgroup col area".split())
FOREIGN = frozenset(("svg", "math"))
#: Data of a drawing or formula that never shows; the text of foreignObject and of all other elements does.
FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter "
                           "annotation annotation-xml".split())
_HTML_INSIDE = frozenset(("foreignobject", "desc", "title", "mtext", "annotation-xml"))
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr main menu nav ol p pre section table ul search".split())
BLOCKS = ENDS_P | frozenset("li dt dd body html summary legend caption tr td th thead tbody tfoot option optgroup".split())
SPACED = HEADINGS | frozenset("p ul ol menu dl pre blockquote table figure".split())  # a blank line around them
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("tr", "td", "th"))
_PARTS = frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
_GROUPS = _PARTS | {"colgroup"}
#: A start tag closes these elements, unless an element of the second set is between.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELLS | {"colgroup"}, frozenset(("tr", "table"))),
    "th": (_CELLS | {"colgroup"}, frozenset(("tr", "table"))),
    "tr": (_ROWS | {"colgroup"}, frozenset(("table",))),
    "thead": (_GROUPS, frozenset(("table",))),
    "tbody": (_GROUPS, frozenset(("table",))),
    "tfoot": (_GROUPS, frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
    "caption": (frozenset(("caption", "colgroup")), frozenset(("table",))),
    "colgroup": (frozenset(("caption", "colgroup")), frozenset(("table",))),
}
_P = frozenset(("p",))
_P_STOPS = frozenset(("table", "td", "th", "caption", "button", "object", "template"))
_SCOPE = frozenset(("table", "td", "th", "caption", "template"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict:
    """Attributes of a start tag; the first of a name counts."""
    out: dict = {}
    for m in _ATTR.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out.setdefault(m[1].lower(), unescape(value) if value else "")
    return out


def _self_closed(raw: str) -> bool:
    """Whether a start tag ends in ``/>``; a slash that ends an unquoted value does not count."""
    tail = re.split(r"[\s\"']", raw)[-1]
    return tail.endswith("/") and "=" not in tail


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack = [root]
    foreign = [False]                       # whether each open element holds svg or math elements
    opened: dict = {}                       # open elements by tag, to skip hopeless searches

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:], foreign[k:]

    def close_nearest(tags, stops) -> None:
        """Close the outermost open element of ``tags`` above the nearest stop."""
        if not any(opened.get(t) for t in tags):
            return
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in stops:
                break
            if tag in tags:
                found = k
        if found:
            close(found)

    def text(s: str) -> None:
        if stack[-1].tag == "head" and not s.isspace() and s:
            close(len(stack) - 1)           # head holds no text
        elif stack[-1].tag == "colgroup" and s and not s.isspace():
            close(len(stack) - 1)
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in _SCOPE and tag not in _PARTS and tag != "table":
                        break
            elif tag == "p":
                stack[-1].children.append(Node("p", {}))
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD or stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            close(len(stack) - 1)           # an implied end: neither holds such an element
        if tag == "head" and (opened.get("head") or opened.get("body")):
            continue                        # a second head is ignored
        if foreign[-1] and tag in ENDS_P:   # such a tag ends the drawing or formula
            while foreign[-1]:
                close(len(stack) - 1)
        if tag in IMPLIED:
            close_nearest(*IMPLIED[tag])
        if tag in ENDS_P:
            close_nearest(_P, _P_STOPS)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})            # implied row
            stack[-1].children.append(row)
            stack.append(row)
            foreign.append(False)
            opened["tr"] = opened.get("tr", 0) + 1
        node = Node(tag, attributes(m[3]) if m[3] and not m[3].isspace() else {})
        stack[-1].children.append(node)
        if foreign[-1] and tag in FOREIGN_UNSEEN:
            node.attrs["hidden"] = ""
        if tag in VOID or (tag in FOREIGN or foreign[-1]) and _self_closed(m[3] or ""):
            continue
        if tag in RAW and not (tag == "title" and foreign[-1]):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            inner = page[at:stop]
            if tag in ("textarea", "title") and inner:
                node.children.append(unescape(inner))
            close_tag = page.find(">", stop)
            at = close_tag + 1 if end and close_tag >= 0 else n
            continue
        stack.append(node)
        foreign.append(tag in FOREIGN or foreign[-1] and tag not in _HTML_INSIDE)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _style(node: Node) -> dict:
    out = {}
    for part in node.attrs.get("style", "").split(";"):
        k, _, v = part.partition(":")
        out[k.strip().lower()] = v.replace("!important", "").strip().lower()
    return out


def width(s: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of one block of text, with pending blanks, gaps and indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        parts = _SPACES.split(s)
        if len(parts) == 1:
            words = parts
        else:
            if not parts[0]:
                self.blank = True
            words = [p for p in parts if p]
        for k, word in enumerate(words):
            if word:
                if (self.blank or k) and self.now:
                    self.now.append(" ")
                self.now.append(word)
                self.blank = False
        if len(parts) > 1 and not parts[-1]:
            self.blank = True

    def line(self, s: str) -> None:
        """A finished line, after the gap that is due."""
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[: len(indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((indent + s).rstrip(" "))

    def end_line(self) -> None:
        if self.now:
            self.line("".join(self.now))
            self.now = []
        self.blank = False

    def block(self, gap: bool) -> None:
        self.end_line()
        if gap:
            self.gap = 1

    def verbatim(self, s: str) -> None:
        """Preformatted text: line ends are kept."""
        head, *rest = s.split("\n")
        if head:
            self.now.append(head)
        for x in rest:
            self.line("".join(self.now))
            self.now = [x] if x else []

    def close(self) -> list[str]:
        self.end_line()
        return self.lines


class Grid:
    """Cells of a table, with spans."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}     # column: rows it is still taken by a span
        self.caption: list[str] = []

    def row(self) -> None:
        self.taken = {c: k - 1 for c, k in self.taken.items() if k > 1}
        self.rows.append({})

    def cell(self, lines: list[str], cols: int, rows: int) -> None:
        if not self.rows:
            self.rows.append({})
        row, c = self.rows[-1], 0
        while c in row or c in self.taken:
            c += 1
        row[c] = lines
        for k in range(c + 1, c + cols):
            row.setdefault(k, [])
        if rows > 1:
            for k in range(c, c + cols):
                self.taken[k] = rows

    def lines(self) -> list[str]:
        wide: dict[int, int] = {}
        for row in self.rows:
            for c, cell in row.items():
                wide[c] = max(wide.get(c, 0), max(map(width, cell), default=0))
        cols = [c for c in sorted(wide) if wide[c]]
        out = list(self.caption)
        for row in self.rows:
            cells = [row.get(c, []) for c in cols]
            for k in range(max(map(len, cells), default=0)):
                line = [(cell[k] if k < len(cell) else "") for cell in cells]
                out.append("  ".join(x + " " * (wide[c] - width(x)) for c, x in zip(cols, line, strict=True)).rstrip(" "))
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _options(select: Node) -> list:
    """The options of a select that show: the selected ones, or else the first."""
    found, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x.tag == "option":
                found.append(x)
            else:
                todo += reversed(x.children)
    return [x for x in found if "selected" in x.attrs] or found[:1]


def render(page: str) -> str:
    """The visible text of a page."""
    flow = Flow()
    flows = [flow]                          # one per open table cell or caption
    grids: list[Grid] = []
    counters: list[int | None] = []         # of open lists
    seen, pre = [True], [0]
    todo: list[tuple] = [(parse(page), False)]
    while todo:
        node, leave = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1]:
                flow.verbatim(node) if pre[-1] else flow.text(node)
            continue
        tag = node.tag
        if leave:
            seen.pop()
            if tag == "pre":
                pre.pop()
            if tag == "q" and seen[-1]:
                flow.now.append("”")
            if tag in ("li", "dd", "blockquote") and flow.indents:
                flow.end_line()
                flow.indents.pop()
                flow.marker = ""
            if tag in ("ul", "ol", "menu"):
                counters.pop()
            if tag in ("td", "th") and grids and len(flows) > 1:
                lines = flows.pop().close()
                grids[-1].cell(lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534))
            elif tag == "caption" and grids and len(flows) > 1:
                grids[-1].caption += flows.pop().close()
            elif tag == "table":
                lines = grids.pop().lines()
                flow = flows[-1]
                for x in lines:
                    flow.line(x)
                flow.block(True)
            elif tag in BLOCKS and tag != "tr":
                flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and counters))
            continue
        if tag in UNSEEN or "hidden" in node.attrs or (tag == "dialog" and "open" not in node.attrs):
            continue
        style = _style(node) if "style" in node.attrs else {}
        if style.get("display") == "none":
            continue
        visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), seen[-1])
        if tag == "br":
            if flow.now:
                flow.end_line()
            elif seen[-1] and flow.lines:
                flow.gap = 1
            continue
        if tag == "input":
            if seen[-1] and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                flow.text(" " + node.attrs.get("value", "") + " ")
            continue
        if tag == "wbr" or tag == "img" or tag == "embed":
            continue
        seen.append(visible)
        children = node.children
        if tag in ("td", "th") and grids:
            flows.append(Flow())
        elif tag == "caption" and grids:
            flows.append(Flow())
        elif tag == "table":
            flow.block(True)
            grids.append(Grid())
        elif tag == "tr" and grids:
            grids[-1].row()
        elif tag in BLOCKS:
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and counters))
        if tag in ("ul", "ol", "menu"):
            first = node.attrs.get("start", "1").strip()
            counters.append(None if tag != "ol" else int(first) if re.fullmatch(r"-?[0-9]{1,9}", first, re.A) else 1)
        elif tag == "li":
            mark = "- "
            if counters and counters[-1] is not None:
                value = node.attrs.get("value", "").strip()
                if re.fullmatch(r"-?[0-9]{1,9}", value, re.A):
                    counters[-1] = int(value)
                mark = f"{counters[-1]}. "
                counters[-1] += 1
            flow.indents.append(" " * len(mark))
            flow.marker = mark
        elif tag in ("dd", "blockquote"):
            flow.indents.append("  ")
        elif tag == "pre":
            pre.append(1)
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
        elif tag == "q" and seen[-1]:
            flow.text("“")
            flow.now.append("") if flow.now else None
        elif tag == "select":
            children = _options(node)
        elif tag == "details" and "open" not in node.attrs:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
        todo.append((node, True))
        todo += [(x, False) for x in reversed(children)]
    while len(flows) > 1:
        lines = flows.pop().close()
        for x in lines:
            flows[-1].line(x)
    return "\n".join(flows[0].close())


def render_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, html = read_columns(batch, "page_id", "html")
            for i in range(0, batch.num_rows, 256):
                text = [render(x or "") for x in html.slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ident.slice(i, 256), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()),
                     pa.array([x.count("\n") + 1 if x else 0 for x in text], pa.int64())],
                    names=["page_id", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
