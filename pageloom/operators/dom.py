"""B1: explode HTML into the node table.

The only per-row Python step of the engine: each page's html is tokenised
by the standard library ``html.parser`` inside ``mapInArrow`` (Arrow batches
in and out) and turned into one row per node with pre-order id ``nid``,
subtree end ``post``, ``parent``, ``depth`` and the ancestor chain ``anc``.
Everything downstream is Catalyst.

Tree rules are those of a ``html.parser`` tree builder without implied end
tags: an end tag closes the nearest open element of that name (ignored when
none is open), void elements never hold children, ``<x/>`` opens and closes
``x``, whitespace-only strings are kept (as one space or one newline),
adjacent character data forms one string, and unclosed elements end at the
end of the document.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NODE
from ..session import stored

# Elements that never hold children in the tree builder.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
}

# Ancestor entries per Arrow batch: chains are written out only when a batch is
# built, so a deep page costs its own nodes plus one batch, at any depth.
BATCH_ENTRIES = 200_000

_ASCII_SPACES = "\x20\x0a\x09\x0c\x0d"


class _TreeRows(HTMLParser):
    """Event handler that builds rows instead of a tree object."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[int] = []          # nids of open elements
        self.open: dict[str, int] = {}      # open elements by tag
        self.buf: list[str] = []
        self.closed_void: list[str] = []

    # -- helpers -----------------------------------------------------------
    def _add(self, kind, tag=None, id_attr=None, classes=None, attrs=None, text=None):
        nid = len(self.rows)
        parent = self.stack[-1] if self.stack else -1
        self.rows.append({
            "nid": nid, "post": nid, "parent": parent, "depth": len(self.stack),
            "kind": kind, "tag": tag, "id_attr": id_attr, "classes": classes,
            "attrs": attrs, "text": text,
        })
        return nid

    def _flush(self):
        if not self.buf:
            return
        data = "".join(self.buf)
        self.buf = []
        if data.strip(_ASCII_SPACES) == "":
            data = "\n" if "\n" in data else " "
        self._add("text", text=data)

    def _close_top(self):
        nid = self.stack.pop()
        self.rows[nid]["post"] = len(self.rows) - 1
        self.open[self.rows[nid]["tag"]] -= 1

    # -- parser events -----------------------------------------------------
    def handle_starttag(self, tag, attrs, auto_close_void=True):
        self._flush()
        amap: dict[str, str] = {}
        for k, v in attrs:                 # a repeated attribute: last wins
            amap[k] = "" if v is None else v
        classes = amap["class"].split() if "class" in amap else []
        id_attr = amap.get("id")
        nid = self._add("elem", tag=tag, id_attr=id_attr, classes=classes, attrs=list(amap.items()))
        self.stack.append(nid)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in VOID_TAGS and auto_close_void:
            self._pop_to(tag)
            self.closed_void.append(tag)

    def handle_startendtag(self, tag, attrs):
        # ``<x/>``: open, then an ordinary end tag (which a pending void end
        # tag of the same name absorbs, as in the tree builder).
        self.handle_starttag(tag, attrs, auto_close_void=False)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.closed_void:
            self.closed_void.remove(tag)
            return
        self._pop_to(tag)

    def _pop_to(self, tag):
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[i]]["tag"] == tag:
                while len(self.stack) > i:
                    self._close_top()
                return

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("comment", text=data)

    def handle_decl(self, decl):
        self._flush()
        text = decl[len("DOCTYPE"):].strip() if decl.upper().startswith("DOCTYPE") else decl
        self._add("doctype", text=text)

    def handle_pi(self, data):
        self._flush()
        self._add("pi", text=data)

    def unknown_decl(self, data):
        self._flush()
        self._add("text", text=data[len("CDATA["):] if data.startswith("CDATA[") else data)

    def finish(self):
        self.close()
        self._flush()
        while self.stack:
            self._close_top()
        return self.rows


def _entry(row: dict) -> dict:
    """What a descendant keeps of an open element."""
    return {k: row[k] for k in ("nid", "tag", "id_attr", "classes", "attrs")}


def with_ancestors(rows: list[dict]):
    """The rows in order, each with its chain ``anc`` (outermost first). Only
    the current chain is held."""
    chain: list[dict] = []
    for r in rows:
        del chain[r["depth"]:]
        r["anc"] = list(chain)
        yield r
        if r["kind"] == "elem":
            chain.append(_entry(r))


def parse_html(html: str | None) -> list[dict]:
    """Rows of one page (driver-free helper, also used by tests)."""
    return list(with_ancestors(_parse(html)))


def _parse(html: str | None) -> list[dict]:
    p = _TreeRows()
    if html:
        p.feed(html)
    return p.finish()


def tree(html: str) -> list[list]:
    """One page's nodes as ``treepass`` takes them: [parent, post, kind, tag, attrs, text]."""
    return [[r["parent"], r["post"], r["kind"], r["tag"], dict(r["attrs"]) if r["attrs"] is not None else None, r["text"]]
            for r in _parse(html)]


_ARROW_SCHEMA = pa.schema([
    pa.field("page_id", pa.int64()),
    pa.field("nid", pa.int32()),
    pa.field("post", pa.int32()),
    pa.field("parent", pa.int32()),
    pa.field("depth", pa.int32()),
    pa.field("kind", pa.string()),
    pa.field("tag", pa.string()),
    pa.field("id_attr", pa.string()),
    pa.field("classes", pa.list_(pa.string())),
    pa.field("attrs", pa.map_(pa.string(), pa.string())),
    pa.field("text", pa.string()),
    pa.field("anc", pa.list_(pa.struct([
        pa.field("nid", pa.int32()), pa.field("tag", pa.string()), pa.field("id_attr", pa.string()),
        pa.field("classes", pa.list_(pa.string())), pa.field("attrs", pa.map_(pa.string(), pa.string())),
    ]))),
])


def _explode_batches(batches):
    for rb in batches:
        out: list[dict] = []
        entries = 0
        for pid, html in zip(rb.column("page_id").to_pylist(), rb.column("html").to_pylist()):
            try:
                rows = _parse(html)
            except Exception as exc:  # one bad page never fails the task
                rows = [{"nid": -1, "post": -1, "parent": -1, "depth": 0, "kind": "error", "tag": None,
                         "id_attr": None, "classes": None, "attrs": None, "text": f"{type(exc).__name__}: {exc}"}]
            for r in with_ancestors(rows):
                r["page_id"] = pid
                out.append(r)
                entries += 1 + len(r["anc"])
                if entries >= BATCH_ENTRIES:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW_SCHEMA)
                    out, entries = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_SCHEMA)


def explode_nodes(pages: DataFrame, html_col: str = "html", partitions: int | None = None, store: bool = True) -> DataFrame:
    """B1: pages(page_id, html) -> NODE rows, stored once in the shared folder
    unless ``store`` is false (a single reader, which then prunes for itself).

    Only ``page_id`` and the html column cross into Python. Html is not
    shuffled unless ``partitions`` asks for it (a small input in few files);
    it changes how the work is spread, never the result.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(html_col).alias("html"))
    if partitions:
        src = src.repartition(partitions)
    nodes = src.mapInArrow(_explode_batches, NODE)
    return stored(nodes, "nodes") if store else nodes
