"""Selective extraction (D9) and structure analysis.

Everything up to the result is expressions over the page row: sections, their
order, the fallback and the envelope. Only the ordered deduplication of a page's
own sections and blocks (``dedup``) crosses into Python, as arrays of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_analysis, norm_block, regex_text, strip_ws, truncate, word_count
from ..functions.urls import host
from ..operators import css, dedup, pagerow as R
from ..profiles import SelectiveSpec, resolve_length
from .content import fetched

_FIRST = len(R.MAIN)          # bit of the first selector of a request

SECTION = "struct<sel_pos:int,section_key:string,selector:string,content:string,element_count:int,priority:int>"


def section_rows(pages: DataFrame, selectors, exclude=(), html_col: str = "html", partitions: int | None = None,
                 warnings: list | None = None) -> DataFrame:
    """Page rows of the cleaned tree with the column ``sections`` (D1 + D2): per
    selector the texts of its matches (C5 + E1, empties dropped) joined by a
    space; ``element_count`` counts all matches; no section without text. A
    repeated selector keeps its own position, an invalid one gives none."""
    valid = [(i, raw, R.compile_selectors([raw], warnings)) for i, raw in enumerate(selectors)]
    valid = [(i, raw, c[0][1]) for i, raw, c in valid if c]
    rows = R.page_rows(pages, R.content_spec(exclude, [sel for *_, sel in valid], warnings), html_col, partitions)
    none = F.array().cast(f"array<{SECTION}>")
    if not valid:
        return rows.withColumn("sections", none)
    rows = rows.select("*", *[R.hits(_FIRST + b).alias(f"_h{b}") for b in range(len(valid))])
    rows = rows.select("*", *[F.filter(R.element_texts(F.col(f"_h{b}"), True), lambda t: t != "").alias(f"_t{b}")
                              for b in range(len(valid))])
    parts = [F.when(F.size(f"_t{b}") > 0, F.struct(
        F.lit(i).alias("sel_pos"), F.lit(f"selector_{i + 1}_{raw}").alias("section_key"), F.lit(raw).alias("selector"),
        F.array_join(f"_t{b}", " ").alias("content"), F.size(f"_h{b}").alias("element_count"),
        css.selector_priority(F.lit(raw)).alias("priority"))) for b, (i, raw, _) in enumerate(valid)]
    return rows.withColumn("sections", F.filter(F.array(*parts), lambda s: s.isNotNull()).cast(f"array<{SECTION}>")) \
        .drop(*[f"_{k}{b}" for k in "ht" for b in range(len(valid))])


def sections(rows: DataFrame) -> DataFrame:
    """One row per section."""
    return rows.select("page_id", F.inline("sections"))


def with_fallback(rows: DataFrame, has_selectors: bool) -> DataFrame:
    """D3: pages without any section get the main-root text as their one
    section, under ``fallback`` (selectors given) or ``default`` (none given)."""
    key = F.lit("fallback" if has_selectors else "default")
    rows = rows.withColumn("root", R.main_root())
    text = F.when(F.size("sections") == 0, R.root_text(F.col("root")))
    rows = rows.withColumn("_text", text)
    own = F.struct(F.lit(-1).alias("sel_pos"), key.alias("section_key"), key.alias("selector"), F.col("_text").alias("content"),
                   F.lit(1).alias("element_count"), F.lit(1).alias("priority"))
    return rows.withColumn("sections", F.when(F.coalesce("_text", F.lit("")) != "", F.array(own)).otherwise(F.col("sections"))
                           .cast(f"array<{SECTION}>")).drop("_text")


def order_sections(rows: DataFrame) -> DataFrame:
    """D4 + D5 + D6 order: length descending, then priority descending, then
    selector position (both sorts are stable)."""
    keyed = F.transform("sections", lambda s: F.struct((-F.length(s["content"])).alias("a"), (-s["priority"]).alias("b"),
                                                       s["sel_pos"].alias("c"), s.alias("s")))
    return rows.withColumn("sections", F.transform(F.sort_array(keyed), lambda x: x["s"]))


def drop_nested_sections(rows: DataFrame) -> DataFrame:
    """Keep a section unless it duplicates (E6) a kept, longer one. Adds
    ``ranks``, the places of the kept ones among the ordered sections."""
    norms = F.transform("sections", lambda s: norm_block(s["content"]))
    rows = rows.withColumn("ranks", F.when(F.size("sections") > 1, dedup.kept_sections(norms))
                           .otherwise(F.transform("sections", lambda s, i: i)))
    return rows.withColumn("kept", F.transform("ranks", lambda i: F.get(F.col("sections"), i)))


def combine_sections(rows: DataFrame, on_supersede: str = "replace") -> DataFrame:
    """One section: E4 of it; several: ``[selector]`` + newline + E4 of
    each, joined by a blank line; then E4 over the whole, stripped. Adds
    ``combined`` (null where E4 gives up) and ``total_sections``."""
    blocks = dedup.dedup_blocks_of(on_supersede)
    rows = rows.withColumn("_d", blocks(F.transform("kept", lambda s: s["content"])))
    many = F.array_join(F.transform(F.arrays_zip("kept", "_d"), lambda x: F.concat(
        F.lit("["), x["kept"]["selector"], F.lit("]\n"), x["_d"])), "\n\n")
    body = F.when(F.size("kept") == 1, F.get(F.col("_d"), F.lit(0))).otherwise(many)
    rows = rows.withColumn("_body", F.when(~F.exists("_d", lambda x: x.isNull()), body))
    rows = rows.withColumn("_final", F.get(blocks(F.array("_body")), F.lit(0)))
    return rows.withColumn("combined", strip_ws("_final")).withColumn("total_sections", F.size("kept")).drop("_d", "_body", "_final")


def selective(pages: DataFrame, spec: SelectiveSpec, on_supersede: str = "replace", uncut: bool = False) -> DataFrame:
    """The selective result per page. Failed fetches and pages without
    html come out as failures (A3); a page that cannot be parsed falls back
    to the regex text; ``spec.return_sections`` adds the section map (D8).
    ``uncut`` keeps whole texts."""
    src = fetched(pages)
    if on_supersede == "fallback":               # only then may a parsed page need its html again
        src = src.withColumn("_html", F.col("html"))
    rows = order_sections(with_fallback(section_rows(src, list(spec.selectors), spec.exclude), bool(spec.selectors)))
    rows = combine_sections(drop_nested_sections(rows), on_supersede)
    gave_up = F.col("failure").isNotNull() | (F.col("combined").isNull() & (F.col("total_sections") > 0))
    rows = rows.withColumn("fell_back", F.col("ok") & gave_up)
    whole = F.when(~F.col("ok"), F.lit("")).when(F.col("fell_back"), regex_text(
        "_html" if on_supersede == "fallback" else "failed_html")).otherwise(F.coalesce("combined", F.lit("")))
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("content", F.col("whole") if uncut
                           else truncate("whole", resolve_length(spec.max_length, "selective"), ellipsis=True))
    method = F.when(F.col("fell_back"), F.lit("fallback_regex")).otherwise(
        F.lit("custom_selectors_deduplicated" if spec.selectors else "default"))
    keys = F.transform("kept", lambda s: s["section_key"])
    out = [
        "page_id", "url", F.col("ok").alias("success"), "error",
        F.when(F.col("ok"), R.title_text()).otherwise(F.lit("")).alias("title"),
        "content", word_count("content").alias("word_count"),
        F.when(F.col("fell_back"), F.lit(0)).otherwise(F.col("total_sections")).alias("total_sections"),
        F.when(F.col("fell_back"), F.array().cast("array<string>")).otherwise(keys).alias("selectors_used"),
        F.when(F.col("ok"), method).alias("extraction_method"),
        F.lit(len(spec.selectors) > 1).alias("deduplication_applied"),
        F.lit(len(spec.selectors)).alias("selectors_provided"),
        "original_html_length",
        content_analysis("content").alias("content_analysis")]
    if spec.return_sections:
        out.append(F.when(F.size("kept") > 0, section_map(F.col("kept"))).alias("sections"))
    return rows.select(*out)


def section_map(kept: Column) -> Column:
    """The kept sections by key."""
    return F.map_from_entries(F.transform(kept, lambda s: F.struct(s["section_key"], F.struct(
        s["selector"].alias("selector"), s["content"].alias("content"), s["element_count"].alias("element_count")))))


# The candidate selectors and exclude suggestions of the
# structure analysis.
CANDIDATES = ["main", "article", ".content", "#main-content", ".post-content"]
EXCLUDE_SUGGESTIONS = ["nav", ".sidebar", ".advertisement", "footer", ".comments"]


def selector_coverage(pages: DataFrame, candidates=CANDIDATES, max_suggestions: int = 5, partitions: int | None = None) -> DataFrame:
    """Per host and candidate: pages matched, share of the host's
    pages, mean words of the first match's text, suggested order."""
    rows = R.page_rows(pages.select(host("url").alias("host"), "html"),
                       R.content_spec((), [css.parse(s) for s in candidates]), "html", partitions)
    rows = rows.select("*", *[R.hits(_FIRST + b).alias(f"_h{b}") for b in range(len(candidates))])
    first = [word_count(F.get(R.element_texts(F.slice(f"_h{b}", 1, 1), False), F.lit(0))) for b in range(len(candidates))]
    per = rows.select("host", F.inline(F.array(*[F.struct(
        F.lit(b).alias("cand_pos"), F.lit(s).alias("selector"), (F.size(f"_h{b}") > 0).alias("hit"),
        F.when(F.size(f"_h{b}") > 0, first[b]).alias("words")) for b, s in enumerate(candidates)])))
    out = per.groupBy("host", "cand_pos", "selector").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("hit").alias("pages_matched"), F.avg("words").alias("mean_words"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("pages_matched").desc(), "cand_pos"))   # a row per candidate
    return (out.withColumn("suggested_rank", rank)
            .withColumn("share", F.bround(F.col("pages_matched") / F.col("pages"), 4))
            .withColumn("suggested", (F.col("suggested_rank") <= max_suggestions) & (F.col("pages_matched") > 0)))


def exclude_coverage(pages: DataFrame, nodes: DataFrame, suggestions=EXCLUDE_SUGGESTIONS) -> DataFrame:
    """Per host and exclude suggestion, the share of text volume it
    would remove (measured on raw nodes, script/style text excluded)."""
    txt = nodes.filter((F.col("kind") == "text") & (strip_ws(F.col("text")) != "")
                       & ~F.exists("anc", lambda a: a["tag"].isin("script", "style")))
    flags = [(css.inside_match(s)).alias(f"x{i}") for i, s in enumerate(suggestions)]
    t = txt.select("page_id", F.length("text").alias("len"), *flags)
    ph = pages.select("page_id", host("url").alias("host"))
    agg = t.join(ph, "page_id").groupBy("host").agg(
        F.sum("len").alias("total"),
        *[F.sum(F.when(F.col(f"x{i}"), F.col("len")).otherwise(0)).alias(f"r{i}") for i in range(len(suggestions))])
    arr = F.array(*[F.struct(F.lit(i).alias("cand_pos"), F.lit(s).alias("selector"), F.col(f"r{i}").alias("removed"))
                    for i, s in enumerate(suggestions)])
    return agg.select("host", "total", F.inline(arr)).withColumn(
        "share", F.bround(F.col("removed") / F.col("total"), 4))
