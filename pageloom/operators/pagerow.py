"""Page rows: one row per page holding its cleaned tree as a compact array.

``page_rows`` is the one Python step: the tree builder (``dom``) and its pass
(``treepass``) turn html into an array of nodes in document order, each with the
end of its subtree, the bits of the selectors it matches and the interval of
the page's text pieces that lie inside it. A string is stored once; the text of any
element is its interval of pieces. Everything below is expressions over that
row: no join, no exchange, one scan for all selectors.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_ws, dedup_sentences, strip_ws
from . import css, dom, treepass
from .treepass import TreeSpec

log = logging.getLogger(__name__)

# Fixed values that must equal the reference for equal results.
# Tags removed with their subtree in content-only and selective mode.
REMOVE_TAGS = [
    "script", "style", "noscript", "link", "meta", "title",
    "nav", "footer", "header", "aside", "form", "input",
    "button", "select", "textarea", "iframe", "embed",
    "object", "audio", "video", "canvas", "svg",
]
# Tags removed with their subtree in array mode.
ARRAY_REMOVE_TAGS = [
    "script", "style", "noscript", "link", "meta",
    "form", "input", "button", "select", "textarea",
]
# Block-level tags of the content-only text walk.
BLOCK_TAGS = [
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6",
    "article", "section", "main", "blockquote", "pre",
    "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th",
]
# Main-content selectors, tried in this order.
MAIN_SELECTORS = [
    "main", "article", '[role="main"]',
    ".content", ".post-content", ".article-content",
    ".entry-content", ".post-body", ".article-body",
    "#content", "#main-content", "#article-content",
]
BODY_RANK = len(MAIN_SELECTORS)          # 12
DOCUMENT_RANK = BODY_RANK + 1            # 13: the whole document, root -1
MAIN = tuple(css.parse(s) for s in [*MAIN_SELECTORS, "body"])   # bits 0 to 12 wherever the root is asked for

PAGES_AT_ONCE = 64                       # pages, and ...
NODES_AT_ONCE = 100_000                  # ... nodes per Arrow batch of the result

_NODE = pa.struct([("parent", pa.int32()), ("post", pa.int32()), ("tag", pa.string()), ("mask", pa.int64()), ("first", pa.int32()),
                   ("cnt", pa.int32()), ("leaf", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])
_PIECE = pa.struct([("s", pa.string()), ("glue", pa.int32())])
TREE = ("failed_html string, failure string, title string, nodes array<struct<parent:int,post:int,tag:string,mask:bigint,first:int,cnt:int,"
        "leaf:int,attrs:map<string,string>>>, pieces array<struct<s:string,glue:int>>, asides array<string>")


def compile_selectors(selectors, warnings: list | None = None) -> list:
    """(raw, parsed) of the valid selectors; a bad one is skipped with a warning."""
    out = []
    for s in selectors or []:
        try:
            out.append((s, css.parse(s)))
        except css.SelectorError as exc:
            msg = f"Invalid selector '{s}': {exc}"
            log.warning(msg)
            if warnings is not None:
                warnings.append(msg)
    return out


def content_spec(exclude=(), select=(), warnings: list | None = None) -> TreeSpec:
    """The tree of content-only and selective mode: tags, then images go, links are
    unwrapped, excludes go. Bits 0 to 12 are the main-content selectors, ``select`` (parsed) follows."""
    return TreeSpec(remove=(*REMOVE_TAGS, "img"), unwrap=True,
                    exclude=tuple(sel for _, sel in compile_selectors(exclude, warnings)), select=(*MAIN, *select))


def _structs(parts: list[dict], kind: pa.StructType) -> pa.ListArray:
    names = [f.name for f in kind]
    offs = [0]
    for p in parts:
        offs.append(offs[-1] + len(p[names[0]]))
    fields = [pa.array([x for p in parts for x in p[f.name]], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


_EMPTY = {k: [] for k in ("parent", "post", "tag", "mask", "first", "cnt", "leaf", "attrs", "s", "glue", "asides")}


def _page(html: str | None, spec: TreeSpec) -> dict:
    if html is None:
        return _EMPTY | {"failed_html": None, "failure": None, "title": None}
    try:
        nodes = dom.tree(html)
        return treepass.page_arrays(treepass.clean(nodes, spec), spec) | {
            "failed_html": None, "failure": None, "title": treepass.title_of(nodes)}
    except Exception as exc:  # one bad page never fails the task
        return _EMPTY | {"failed_html": html, "failure": f"{type(exc).__name__}: {exc}", "title": None}


def page_rows(pages: DataFrame, spec: TreeSpec, html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """The columns of ``pages`` other than html, and TREE. A page that cannot be parsed keeps its
    html in ``failed_html`` and has no nodes; a null html has none either."""
    carried = [c for c in pages.columns if c != html_col]
    schema = T.StructType([pages.schema[c] for c in carried] + T._parse_datatype_string(TREE).fields)

    def rows(rb: pa.RecordBatch, i: int, parts: list[dict]) -> pa.RecordBatch:
        own = [rb.column(k).slice(i, len(parts)) for k in range(len(carried))]
        flat = [pa.array([p[c] for p in parts], pa.string()) for c in ("failed_html", "failure", "title")]
        return pa.RecordBatch.from_arrays(
            [*own, *flat, _structs(parts, _NODE), _structs(parts, _PIECE), pa.array([p["asides"] for p in parts], pa.list_(pa.string()))],
            names=[*carried, "failed_html", "failure", "title", "nodes", "pieces", "asides"])

    def run(batches):
        for rb in batches:
            start, parts, n = 0, [], 0
            for i, html in enumerate(rb.column(len(carried))):
                parts.append(_page(html.as_py(), spec))
                n += len(parts[-1]["post"])
                if len(parts) >= PAGES_AT_ONCE or n >= NODES_AT_ONCE:
                    yield rows(rb, start, parts)
                    start, parts, n = i + 1, [], 0
            if parts:
                yield rows(rb, start, parts)

    src = pages.select(*carried, F.col(html_col).alias("html to parse"))
    if partitions:
        src = src.repartition(partitions)
    return src.mapInArrow(run, schema)


# --- expressions over a page row -------------------------------------------------

def span(first: Column, n: Column, of: str) -> Column:
    """``n`` entries of the array column ``of`` from ``first`` (0-based), by direct access."""
    return F.when(n > 0, F.transform(F.sequence(first, first + n - 1), lambda i: F.get(F.col(of), i)))


def hits(bit: int) -> Column:
    """The numbers of the elements that selector ``bit`` marks, in document order."""
    return F.filter(F.transform("nodes", lambda n, k: F.when(n["mask"].bitwiseAND(F.lit(1 << bit)) != 0, k)), lambda k: k.isNotNull())


def joined(first: Column, n: Column) -> Column:
    """Strings run together without a separator; empty without any."""
    return F.coalesce(F.array_join(F.transform(span(first, n, "pieces"), lambda p: p["s"]), ""), F.lit(""))


def _spaced(root: Column, first: Column, n: Column) -> Column:
    """C5 with C13: strings joined by a blank, those of one link inside ``root`` run together."""
    part = F.transform(span(first, n, "pieces"),
                       lambda p: F.when(p["glue"] > root, p["s"]).otherwise(F.concat(F.lit(" "), p["s"])))
    return collapse_ws(F.coalesce(F.array_join(part, ""), F.lit("")))


def element_texts(numbers: Column, sentences: bool) -> Column:
    """C5 of the elements with these numbers (E1 applied with ``sentences``)."""
    texts = F.transform(numbers, lambda k: _spaced(k, F.get(F.col("nodes"), k)["first"], F.get(F.col("nodes"), k)["cnt"]))
    # one transform more: its variable is evaluated once, an expression wherever it is named
    return F.transform(texts, lambda t: strip_ws(dedup_sentences(t))) if sentences else texts


def document_text(sentences: bool = True) -> Column:
    return F.get(F.transform(F.array(_spaced(F.lit(-1), F.lit(0), F.size("pieces"))),
                             lambda t: strip_ws(dedup_sentences(t)) if sentences else t), F.lit(0))


def main_root() -> Column:
    """(rank, root, post) of the first match of the first main-content selector that has one, else of the first
    ``body``, else the document (root -1). Needs the bits of ``content_spec``."""
    bits = F.lit((1 << len(MAIN)) - 1)
    found = F.transform("nodes", lambda n, k: F.when(n["mask"].bitwiseAND(bits) != 0, F.struct(
        F.coalesce(*[F.when(n["mask"].bitwiseAND(F.lit(1 << b)) != 0, F.lit(b)) for b in range(len(MAIN))]).alias("rank"),
        k.alias("root"), n["post"].alias("post"))))
    whole = F.struct(F.lit(DOCUMENT_RANK).alias("rank"), F.lit(-1).alias("root"), (F.size("nodes") - 1).alias("post"))
    return F.coalesce(F.array_min(F.filter(found, lambda x: x.isNotNull())), whole)


def root_text(root: Column) -> Column:
    """C5 + E1 of the main root (a ``main_root`` struct column)."""
    inside = F.get(element_texts(F.array(root["root"]), True), F.lit(0))
    return F.when(root["root"] < 0, document_text()).otherwise(inside)


def block_text(root: Column) -> Column:
    """In document order inside the root, a block element with text emits its strings run together, an element
    whose ``.string`` exists emits that string, and a string emits itself; joined by a blank, collapsed."""
    inside = F.when(root["post"] > root["root"],
                    F.transform(F.sequence(root["root"] + 1, root["post"]), lambda k: F.get(F.col("nodes"), k)))
    own = lambda n: F.when(n["leaf"] >= 0, F.get(F.col("pieces"), n["leaf"])["s"]) \
        .when(n["leaf"] < -1, F.get(F.col("asides"), -2 - n["leaf"]))
    emitted = F.transform(inside, lambda n: F.when(n["tag"].isin(BLOCK_TAGS) & (n["cnt"] > 0), joined(n["first"], n["cnt"]))
                          .otherwise(own(n)))
    return collapse_ws(F.coalesce(F.array_join(emitted, " "), F.lit("")))      # nulls stay out of the join


def title_text() -> Column:
    """C4: the first title of the original tree, stripped and cut to 200."""
    return F.substring(strip_ws(F.coalesce("title", F.lit(""))), 1, 200)
