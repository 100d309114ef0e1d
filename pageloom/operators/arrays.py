"""Array extraction (2.F): repeated items, sub-fields, absolute URLs.

One scan: the page row (``pagerow``) marks the elements of every item selector
and sub-selector; items are intervals of its nodes, cut to their limit before any
text is built, and a sub-field is looked up inside its item's interval. The result is one
row per page with an array of arrays; the item rows are that row exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws, word_count
from ..functions.urls import absolute_url
from ..profiles import SERVICE_MAX_ARRAYS, ArraySpec
from . import css, dedup, pagerow as R
from .treepass import TreeSpec

# Sub-field names that take an image URL or a link URL, the
# image attributes tried in order, and the item text minimum.
IMAGE_FIELDS = ("image", "img", "picture", "photo")
LINK_FIELDS = ("link", "url", "href")
IMAGE_ATTRS = ("src", "data-src", "data-lazy-src", "data-original")
MIN_ITEM_TEXT = 15
IMAGE_ALT = 4             # characters from which an image's alt counts as text
PIPE = " | "

FIELDS = "map<string,array<string>>"
ITEM = f"struct<elem_pos:int,main_content:string,fields:{FIELDS}>"


def field_kind(name: str) -> str:
    n = name.lower()
    return "image" if n in IMAGE_FIELDS else ("link" if n in LINK_FIELDS else "text")


def image_src(attrs: Column) -> Column:
    """F6 (own attributes): first non-blank of src, data-src,
    data-lazy-src, data-original (stripped)."""
    vals = [F.when(strip_ws(attrs[a]) != "", strip_ws(attrs[a])) for a in IMAGE_ATTRS]
    return F.coalesce(*vals)


def check_specs(specs, most: int = SERVICE_MAX_ARRAYS) -> list[ArraySpec]:
    """The named arrays of one request, those without a selector left out; more than ``most`` raise."""
    if len(specs) > most:
        raise ValueError(f"Maximum {most} array selectors allowed")
    return [s for s in specs if s.selector]


def _node(k: Column) -> Column:
    return F.get(F.col("nodes"), k)


def _inside(k: Column) -> Column:
    """The numbers of the nodes inside element ``k``; null without any."""
    return F.when(_node(k)["post"] > k, F.sequence(k + 1, _node(k)["post"]))


def _first_inside(k: Column, tag: str) -> Column:
    """Attributes of the first ``tag`` inside element ``k``."""
    return _node(F.get(F.filter(_inside(k), lambda d: _node(d)["tag"] == tag), F.lit(0)))["attrs"]


def _sub_field(k: Column, bit: int, kind: str) -> Column:
    """F4 to F7 of one sub-selector for item ``k``: ARRAY<STRING>, [''] without a match."""
    found = F.filter(_inside(k), lambda d: _node(d)["mask"].bitwiseAND(F.lit(1 << bit)) != 0)

    def texts(d: Column) -> Column:
        t = R.element_texts(d, sentences=False)
        return F.when(F.size(d) == 1, t).otherwise(F.array_distinct(F.filter(t, lambda x: x != "")))

    def image(d: Column) -> Column:
        own = image_src(_node(d)["attrs"])
        return F.coalesce(own, F.when(_node(d)["tag"] != "img", image_src(_first_inside(d, "img"))), F.lit(""))

    def link(d: Column) -> Column:
        attrs = F.when(_node(d)["tag"] == "a", _node(d)["attrs"]).otherwise(_first_inside(d, "a"))
        return strip_ws(F.coalesce(attrs["href"], F.lit("")))

    value = {"text": texts, "image": lambda d: F.array(image(F.get(d, F.lit(0)))), "link": lambda d: F.array(link(F.get(d, F.lit(0))))}[kind]
    # the variable of a transform is evaluated once, an expression wherever it is named
    return F.get(F.transform(F.array(found), lambda d: F.when(F.size(d) > 0, value(d)).otherwise(F.array(F.lit("")))), F.lit(0))


def array_pages(pages: DataFrame, specs, exclude=(), dedup_items: bool = True, warnings: list | None = None,
                html_col: str = "html", partitions: int | None = None, keep_title: bool = False) -> DataFrame:
    """F1 to F12 (+ E9): the columns of ``pages`` other than html, ``failure`` and
    ``arrays``: per spec (spec, array_name, selector, sub_selectors_used, items, found, n_before). ``found`` counts matches
    within the limit, ``n_before`` items before deduplication; an item is (index, elem_pos,
    main_content, word_count, char_count, fields). Invalid selectors match nothing."""
    specs = [s for s in specs if s.selector]
    bits: list = []

    def bit(raw: str) -> int | None:
        valid = R.compile_selectors([raw], warnings)
        if not valid:
            return None
        if valid[0] not in bits:
            bits.append(valid[0])
        return bits.index(valid[0])

    of = [(bit(s.selector), [(n, bit(sub)) for n, sub in s.sub_selectors]) for s in specs]
    tree = TreeSpec(remove=tuple(R.ARRAY_REMOVE_TAGS), exclude=tuple(sel for _, sel in R.compile_selectors(exclude, warnings)),
                    select=tuple(sel for _, sel in bits), image_alt=IMAGE_ALT, attributes=True)
    rows = R.page_rows(pages, tree, html_col, partitions)
    gone = {"failed_html", "nodes", "pieces", "asides"} | (set() if keep_title else {"title"})
    keep = [c for c in rows.columns if c not in gone]

    hit = [R.hits(b) if b is not None else F.array().cast("array<int>") for b, _ in of]
    hit = [F.slice(h, 1, int(s.limit)) if s.limit else h for h, s in zip(hit, specs, strict=True)]
    rows = rows.select("*", *[h.alias(f"_h{i}") for i, h in enumerate(hit)])

    def item(k: Column, pos: Column, i: int) -> Column:
        pairs = [F.struct(F.lit(n).alias("k"), (_sub_field(k, b, field_kind(n)) if b is not None else F.array(F.lit(""))).alias("v"))
                 for n, b in of[i][1]]
        fields = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast(FIELDS)
        text = F.get(R.element_texts(F.array(k), sentences=False), F.lit(0))
        return F.struct(pos.alias("elem_pos"), text.alias("main_content"), fields.alias("fields"))

    def long_items(i: int) -> Column:
        return F.filter(F.transform(f"_h{i}", lambda k, pos: item(k, pos, i)),
                        lambda x: F.length(strip_ws(x["main_content"])) >= MIN_ITEM_TEXT)

    rows = rows.select(*keep, *[F.size(f"_h{i}").alias(f"_n{i}") for i in range(len(specs))],
                       *[long_items(i).alias(f"_i{i}") for i in range(len(specs))])
    for i in range(len(specs)):
        kept = dedup.kept_items(F.transform(f"_i{i}", lambda x: x["main_content"])) if dedup_items else F.transform(f"_i{i}", lambda x, k: k)
        rows = rows.withColumn(f"_k{i}", kept)

    def numbered(i: int) -> Column:
        """The kept items; a lone item, or all of them without deduplication, keep their places as index."""
        all_ = F.col(f"_i{i}")
        lone = F.size(all_) <= 1 if dedup_items else F.lit(True)
        return F.transform(F.col(f"_k{i}"), lambda k, n: F.get(F.transform(F.array(F.get(all_, k)), lambda x: F.struct(
            F.when(lone, x["elem_pos"]).otherwise(n).alias("index"), x["elem_pos"].alias("elem_pos"),
            x["main_content"].alias("main_content"), word_count(x["main_content"]).alias("word_count"),
            F.length(x["main_content"]).alias("char_count"), x["fields"].alias("fields"))), F.lit(0)))

    out = F.array(*[F.struct(
        F.lit(i).alias("spec"), F.lit(s.name).alias("array_name"), F.lit(s.selector).alias("selector"),
        F.array(*[F.lit(n) for n, _ in s.sub_selectors]).cast("array<string>").alias("sub_selectors_used"),
        numbered(i).alias("items"), F.col(f"_n{i}").alias("found"), F.size(f"_i{i}").alias("n_before"))
        for i, s in enumerate(specs)])
    return rows.select(*keep, out.alias("arrays"))


def array_items(pages: DataFrame, specs, exclude=(), dedup_items: bool = True, warnings: list | None = None, **kw) -> DataFrame:
    """One row per kept item: the columns of ``pages`` other than html, then (spec, array_name, index, elem_pos,
    main_content, word_count, char_count, fields)."""
    rows = array_pages(pages, specs, exclude, dedup_items, warnings, **kw)
    return item_rows(rows)


def item_rows(rows: DataFrame) -> DataFrame:
    """``array_pages`` rows as one row per item."""
    keep = [c for c in rows.columns if c not in ("arrays", "failure")]
    # of a plain column the optimiser would infer a filter that evaluates all of ``arrays`` again, below
    some = F.filter("arrays", lambda a: F.size(a["items"]) > 0)
    return rows.select(*keep, F.explode(some).alias("a")).select(*keep, "a.spec", "a.array_name", F.inline("a.items"))


def absolute_fields(fields: Column, names, base_url: Column) -> Column:
    """F8 on the image and link fields among ``names``."""
    names = sorted({n for n in names if field_kind(n) != "text"})
    if not names:
        return fields
    return F.transform_values(fields, lambda k, v: F.when(
        k.isin(names), F.transform(v, lambda x: absolute_url(base_url, x))).otherwise(v))


def _names(specs) -> set:
    return {n for s in specs for n, _ in s.sub_selectors}


def absolutize(items: DataFrame, specs: list[ArraySpec], base_url: str = "url") -> DataFrame:
    """F8 on item rows (needs the page URL column)."""
    return items.withColumn("fields", absolute_fields(F.col("fields"), _names(specs), F.col(base_url)))


def absolutize_pages(rows: DataFrame, specs: list[ArraySpec], base_url: str = "url") -> DataFrame:
    """F8 on ``array_pages`` rows."""
    if not any(field_kind(n) != "text" for n in _names(specs)):
        return rows
    return rows.withColumn("arrays", F.transform("arrays", lambda a: a.withField("items", F.transform(
        a["items"], lambda x: x.withField("fields", absolute_fields(x["fields"], _names(specs), F.col(base_url)))))))


def flatten_field(v: Column, mode: str = "join") -> Column:
    """``join``: values joined by ' | '; ``first``: the first value;
    missing or empty gives ''."""
    if mode == "first":
        return F.coalesce(F.try_element_at(v, F.lit(1)), F.lit(""))
    return F.coalesce(F.array_join(v, PIPE), F.lit(""))


def pivot_fields(items: DataFrame, names, mode: str = "join") -> DataFrame:
    """one column per requested sub-field (static pivot: the names come
    from the spec, so the schema is fixed at plan time; no shuffle)."""
    return items.select("*", *[flatten_field(F.col("fields")[n], mode).alias(n) for n in names])


def array_summary(rows: DataFrame) -> DataFrame:
    """F12 on ``array_pages`` rows: per (page, array) the count, whether dedup lowered it, the
    sub-field names. Arrays without items have a zero row."""
    return rows.select("page_id", F.explode("arrays").alias("a")).select(
        "page_id", "a.spec", "a.array_name", "a.selector", F.size("a.items").alias("count"), "a.sub_selectors_used",
        (F.size("a.items") < F.col("a.n_before")).alias("deduplication_applied"))


def page_summary() -> Column:
    """F13 on an ``arrays`` column: total selectors, total items, names with items, total words."""
    items = F.flatten(F.transform("arrays", lambda a: a["items"]))
    return F.struct(
        F.size("arrays").alias("total_selectors"), F.size(items).alias("total_items_extracted"),
        F.transform(F.filter("arrays", lambda a: F.size(a["items"]) > 0), lambda a: a["array_name"]).alias("successful_selectors"),
        F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x["word_count"]).alias("total_words"))


def format_flat() -> Column:
    """all main texts of a page joined by a blank line, arrays in spec
    order, items in index order."""
    texts = F.flatten(F.transform("arrays", lambda a: F.transform(a["items"], lambda x: x["main_content"])))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def format_summary() -> Column:
    """F16: one line per array, zero counts included."""
    return F.array_join(F.transform("arrays", lambda a: F.concat(
        a["array_name"], F.lit(": "), F.size(a["items"]).cast("string"), F.lit(" items found with selector '"),
        a["selector"], F.lit("' (order preserved)"))), "\n")


def format_structured() -> Column:
    """``=== NAME (n items - order preserved) ===`` then ``[Item i]``
    blocks with ``key: value`` lines in the order of the array's own sub-selectors (empty values
    skipped), a blank line after each array. Items are numbered from 1 in their order, whatever their index."""
    def lines(a: Column, x: Column) -> Column:
        kv = F.transform(a["sub_selectors_used"], lambda n: F.struct(n.alias("n"), F.array_join(
            F.filter(x["fields"][n], lambda v: v != ""), PIPE).alias("v")))
        return F.array_join(F.transform(F.filter(kv, lambda p: p["v"] != ""), lambda p: F.concat(F.lit("\n"), p["n"], F.lit(": "), p["v"])), "")

    def block(a: Column) -> Column:
        head = F.concat(F.lit("=== "), F.upper(a["array_name"]), F.lit(" ("), F.size(a["items"]).cast("string"),
                        F.lit(" items - order preserved) ==="))
        items = F.transform(a["items"], lambda x, i: F.concat(
            F.lit("\n[Item "), (i + 1).cast("string"), F.lit("]\n"), x["main_content"], lines(a, x)))
        return F.array_join(F.concat(F.array(head), items, F.array(F.lit(""))), "\n")

    return F.array_join(F.transform(F.filter("arrays", lambda a: F.size(a["items"]) > 0), block), "\n")
