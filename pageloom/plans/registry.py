"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each reading the driver tables (or data Spark
derives from them) in full."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import css, dom, nodes as N, pagerow as R, stats, windows as W
from ..operators.treepass import TreeSpec
from ..plans import content as C
from ..session import ship
from ..sources import pages as P

QUERIES: dict = {}


def query(name):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return fn(ship(spark), d)

        QUERIES[name] = run
        return fn
    return deco


def tbl(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(spark, pages: DataFrame) -> int | None:
    """Partitions for parsing when the input has fewer files than tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return n if len(pages.inputFiles()) < n else None


def _nodes(spark, d) -> DataFrame:
    pages = tbl(spark, d, "pages")
    return dom.explode_nodes(pages, partitions=_spread(spark, pages), store=False)   # every query here reads it once


def _page_rows(spark, d, spec: TreeSpec, *columns) -> DataFrame:
    pages = tbl(spark, d, "pages")
    return R.page_rows(pages.select("page_id", *columns, "html"), spec, partitions=_spread(spark, pages))


def _listing(spark, d) -> DataFrame:
    return P.listing_pages(tbl(spark, d, "part"))


def _url_variants(pages: DataFrame) -> DataFrame:
    """Candidate URLs derived from every page URL (valid and invalid forms)."""
    u = F.col("url")
    no_scheme = F.regexp_replace(u, "^[A-Za-z]+://", "")
    variants = F.array(
        u, F.concat(F.lit("  "), u), no_scheme, F.concat(F.lit("//"), no_scheme),
        F.concat(F.lit("mailto:"), no_scheme), F.regexp_replace(u, "://", ":///"),
        F.regexp_replace(u, "://", "://["), F.concat(F.lit("1"), u), F.regexp_replace(u, "^https?", "ftp"))
    return pages.select("page_id", F.posexplode(variants).alias("variant", "candidate"))


# --- 2.A ----------------------------------------------------------------------

@query("a1_read_pages")
def a1(spark, d):
    df = P.with_html_source(tbl(spark, d, "pages"))
    return df.select("page_id", "url", F.col("ok").alias("success"), "error",
                     F.length("html_source").cast("long").alias("html_length"))


@query("a2_lookup_urls")
def a2(spark, d):
    pages = tbl(spark, d, "pages")
    reqs = pages.select(F.col("page_id").alias("b"),
                        F.array("url", F.concat("url", F.lit("/missing")), "url").alias("urls"))
    out = P.lookup_urls(P.requests_from(reqs, "b", "urls"), pages)
    return out.select("batch_id", F.col("batch_pos").cast("long").alias("batch_pos"), "url", "page_id", "found", "error")


def _fetches(spark, d) -> DataFrame:
    """Fetch outcomes derived from pages: a page without a closing
    ``</html>`` counts as a failed fetch with no message."""
    pages = tbl(spark, d, "pages")
    return pages.select("page_id", "url", "html", F.col("html").contains("</html>").alias("success"),
                        F.lit(None).cast("string").alias("error_message"))


@query("a3_fail_rows")
def a3(spark, d):
    return P.fail_rows(_fetches(spark, d)).select("page_id", "url", "success", "error")


@query("a4_validate_url")
def a4(spark, d):
    v = _url_variants(tbl(spark, d, "pages"))
    return v.select("page_id", F.col("variant").cast("long").alias("variant"), "candidate",
                    U.validate_url("candidate").alias("valid"))


@query("a5_validate_requests")
def a5(spark, d):
    pages = tbl(spark, d, "pages")
    bodies = F.array(
        F.to_json(F.struct("url")),
        F.to_json(F.struct(F.col("url").alias("link"))),
        F.to_json(F.struct(F.regexp_replace("url", "^[A-Za-z]+://", "").alias("url"))),
        F.lit("{}"))
    req = pages.select("page_id", F.posexplode(bodies).alias("kind", "body"))
    return P.validate_requests(req).select("page_id", F.col("kind").cast("long").alias("kind"), "error")


@query("a6_validate_batches")
def a6(spark, d):
    pages = tbl(spark, d, "pages")
    # a batch is a host's pages of one id range, so no row grows with a host
    by_host = pages.groupBy(U.host("url").alias("host"), F.floor(F.col("page_id") / 60).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("l"))
    urls = F.transform("l", lambda x: x["url"])
    # batches of even size get their last URL without a scheme
    urls = F.when(F.size(urls) % 2 == 0,
                  F.concat(F.slice(urls, 1, F.size(urls) - 1),
                           F.array(F.regexp_replace(F.try_element_at(urls, F.lit(-1)), "^[A-Za-z]+://", ""))))\
        .otherwise(urls)
    out = P.validate_batches(by_host.select("host", "batch", urls.alias("urls")), max_batch_size=5)
    return out.select("host", "batch", F.size("urls").cast("long").alias("n_urls"), "error")


@query("a7_with_scheme")
def a7(spark, d):
    v = _url_variants(tbl(spark, d, "pages"))
    return v.select("page_id", F.col("variant").cast("long").alias("variant"), U.with_scheme("candidate").alias("url"))


@query("a8_parse_selector_list")
def a8(spark, d):
    pages = tbl(spark, d, "pages")
    raw = F.translate(F.regexp_replace("url", "^[A-Za-z]+://[^/]*", ""), "/?&=", ",,,,")
    return pages.select("page_id", F.array_join(U.selector_list(raw), "|").alias("selectors"))


@query("a9_to_result_json")
def a9(spark, d):
    r = C.basic_content(tbl(spark, d, "pages"), max_length=120)
    env = F.struct(
        "success", "url", "title", "content", "word_count",
        F.array().cast("array<struct<src:string,alt:string,title:string>>").alias("images"),
        F.struct(F.array().cast("array<struct<href:string,text:string>>").alias("internal"),
                 F.array().cast("array<struct<href:string,text:string>>").alias("external")).alias("links"),
        F.struct(F.col("content_length").alias("content_length")).alias("metadata"),
        "error")
    return r.select("url", F.to_json(env, {"ignoreNullFields": "false"}).alias("json"))


# --- 2.B ----------------------------------------------------------------------

@query("b1_explode_nodes")
def b1(spark, d):
    n = _nodes(spark, d)
    return n.filter(F.col("kind") == "elem").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("b2_drop_tags")
def b2(spark, d):
    n = N.drop_tags(_nodes(spark, d), R.REMOVE_TAGS)
    return n.filter(F.col("kind") == "elem").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("b3_excluded_tags")
def b3(spark, d):
    n = N.drop_tags(_nodes(spark, d), ["form", "header", "nav", "footer"])
    return n.filter(F.col("kind") == "elem").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("b4_drop_images")
def b4(spark, d):
    n = N.drop_images(dom.explode_nodes(_listing(spark, d), store=False))
    return n.filter(F.col("kind") == "elem").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("b5_unwrap_links")
def b5(spark, d):
    rows = _page_rows(spark, d, TreeSpec(unwrap=True))
    li = F.filter("nodes", lambda n: n["tag"].isNull() & (n["leaf"] >= 0) & (F.get(F.col("nodes"), n["parent"])["tag"] == "li"))
    rows = rows.select("page_id", F.transform(li, lambda n: F.get(F.col("pieces"), n["leaf"])["s"]).alias("t"))
    return rows.where(F.size("t") > 0).select("page_id", F.size("t").cast("long").alias("n_links"), F.array_join("t", "|").alias("texts"),
                                              F.lit(0).cast("long").alias("n_elem"))


@query("b6_exclude")
def b6(spark, d):
    n = N.exclude(_nodes(spark, d), [".ad", "nav", "div.missing > p"])
    return n.filter(F.col("kind") == "elem").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


B7_SELECTORS = ["article p", "li > a[href]", ".ad", "nav a", "html[lang]", "meta[charset]", "h1",
                "#nothing", "div.ad, nav", "body > article > h1", "[href]"]


@query("b7_css")
def b7(spark, d):
    n = _nodes(spark, d)
    counts = [F.sum(F.when(css.self_matches(s), 1).otherwise(0)).cast("long").alias(f"m{i}")
              for i, s in enumerate(B7_SELECTORS)]
    agg = n.groupBy("page_id").agg(*counts)
    stacked = F.array(*[F.struct(F.lit(s).alias("selector"), F.col(f"m{i}").alias("n"))
                        for i, s in enumerate(B7_SELECTORS)])
    return agg.select("page_id", F.inline(stacked))


@query("b9_select")
def b9(spark, d):
    n = N.select(_nodes(spark, d), "li > a")
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("nid")) - 1
    return n.select("page_id", pos.cast("long").alias("pos"), F.col("attrs")["href"].alias("href"))


@query("b8_css")
def b8(spark, d):
    """Selectors on siblings, on listings and articles alike."""
    pages = tbl(spark, d, "pages").select("page_id", "html").unionByName(_listing(spark, d).select("page_id", "html"))
    rows = R.page_rows(pages, TreeSpec(select=tuple(css.parse(x) for x in B8_SELECTORS)), partitions=_spread(spark, pages))
    return rows.select("page_id", F.inline(F.array(*[
        F.struct(F.lit(x).alias("selector"), F.size(R.hits(i)).cast("long").alias("n")) for i, x in enumerate(B8_SELECTORS)])))


@query("b10_main_root")
def b10(spark, d):
    pages = tbl(spark, d, "pages").unionByName(_listing(spark, d))
    rows = R.page_rows(pages.select("page_id", "html"), R.content_spec(), partitions=_spread(spark, pages))
    rows = rows.withColumn("root", R.main_root())
    return rows.select("page_id", F.coalesce(F.get(F.col("nodes"), F.col("root.root"))["tag"], F.lit("[document]")).alias("root_tag"),
                       F.col("root.rank").cast("long").alias("root_rank"))


B8_SELECTORS = ["li:nth-child(2)", "li:last-child", "h1 + p", "h1 ~ p", "p:first-of-type", "article > :first-child",
                "div.it:nth-child(2n+1)", "div.it + div.it", "span.price ~ span.tag", "span.tag + span.tag", "div.it:not(:first-child) h2",
                "div.it > :nth-last-child(-n+2)"]


# --- 2.C ----------------------------------------------------------------------

@query("c1_regex_text")
def c1(spark, d):
    return tbl(spark, d, "pages").select("page_id", X.regex_text("html").alias("text"))


@query("c2_strip_tags")
def c2(spark, d):
    return tbl(spark, d, "pages").select("page_id", X.strip_tags("html").alias("text"))


@query("c3_basic_content")
def c3(spark, d):
    r = C.basic_content(tbl(spark, d, "pages"))
    return r.select("url", "success", "content", F.col("word_count").cast("long").alias("word_count"))


@query("c4_page_title")
def c4(spark, d):
    return _page_rows(spark, d, TreeSpec()).select("page_id", R.title_text().alias("title"))


@query("c5_element_text")
def c5(spark, d):
    rows = _page_rows(spark, d, TreeSpec(remove=tuple(R.ARRAY_REMOVE_TAGS), select=(css.parse("article"),), image_alt=A.IMAGE_ALT))
    return rows.select("page_id", F.explode(R.element_texts(R.hits(0), sentences=False)).alias("text")).where("text <> ''")


@query("c6_block_text")
def c6(spark, d):
    pages = tbl(spark, d, "pages")
    return C.content_text(pages).select("page_id", F.col("content").alias("text"))


@query("c7_content_only")
def c7(spark, d):
    r = C.content_only(tbl(spark, d, "pages"))
    return r.select("page_id", "title", "content", F.col("word_count").cast("long").alias("word_count"),
                    F.col("original_html_length").cast("long").alias("original_html_length"))


@query("c8_collapse_ws")
def c8(spark, d):
    return tbl(spark, d, "documents").select("doc_id", X.collapse_ws("text").alias("text"))


@query("c9_truncate")
def c9(spark, d):
    return tbl(spark, d, "documents").select("doc_id", X.truncate("text", 100).alias("cut_ellipsis"),
                                             X.truncate("text", 100, ellipsis=False).alias("cut"))


@query("c10_word_count")
def c10(spark, d):
    return tbl(spark, d, "documents").select("doc_id", X.word_count("text").cast("long").alias("words"))


@query("c11_char_count")
def c11(spark, d):
    return tbl(spark, d, "documents").select("doc_id", X.char_count("text").cast("long").alias("chars"))


@query("c14_preview")
def c14(spark, d):
    return tbl(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


@query("c15_original_html_length")
def c15(spark, d):
    return tbl(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("original_html_length"))


@query("c16_min_words")
def c16(spark, d):
    docs = tbl(spark, d, "documents")
    blocks = X.min_words(F.split("text", "\n"), 5)
    return docs.select("doc_id", F.size(blocks).cast("long").alias("kept"),
                       F.coalesce(F.aggregate(blocks, F.lit(0).cast("long"),
                                              lambda a, b: a + F.length(b)), F.lit(0)).alias("kept_chars"))


# --- 2.H ----------------------------------------------------------------------

@query("g1_batch_summary")
def g1(spark, d):
    return stats.batch_summary(P.fail_rows(_fetches(spark, d)))


@query("g3_batch_content_stats")
def g3(spark, d):
    r = C.basic_content(_fetches(spark, d).drop("error_message"), uncut=True)
    return stats.batch_content_stats(r).select(
        "total_content_extracted", F.col("average_content_per_url").cast("double").alias("average_content_per_url"))


@query("g4_content_analysis")
def g4(spark, d):
    a = X.content_analysis(F.col("text"))
    return tbl(spark, d, "documents").select(
        "doc_id", a["total_words"].cast("long").alias("total_words"),
        a["unique_words"].cast("long").alias("unique_words"),
        a["vocabulary_ratio"].cast("double").alias("vocabulary_ratio"),
        a["content_length_after_deduplication"].cast("long").alias("content_length"))


@query("g6_host_rollup")
def g6(spark, d):
    r = C.basic_content(_fetches(spark, d).drop("error_message"), uncut=True)
    return stats.host_rollup(r)


# --- 2.I ----------------------------------------------------------------------

def _ev(spark, d):
    return W.as_event_time(tbl(spark, d, "events"))


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("t1_rate_windows")
def t1(spark, d):
    r = W.rate_windows(_ev(spark, d), key="user_id", width="1 hour")
    return r.select("user_id", _fmt("window_start").alias("window_start"), "n")


@query("t2_rate_verdict")
def t2(spark, d):
    r = W.rate_verdict(_ev(spark, d), limits=(("1 hour", 1), ("1 day", 8)), key="user_id")
    return r.select("event_id", F.col("n_0").cast("long").alias("n_hour"), F.col("n_1").cast("long").alias("n_day"),
                    "allowed", F.col("remaining_0").cast("long").alias("remaining_hour"),
                    F.col("retry_after").cast("long").alias("retry_after"))


@query("t3_rate_exempt")
def t3(spark, d):
    ev = _ev(spark, d)
    keys = ev.filter((F.col("event_type") == "purchase") & (F.col("value") > 140)).select("user_id")
    limited, _ = W.rate_exempt(ev, keys)
    return W.rate_windows(limited, key="user_id", width="1 day").select(
        "user_id", _fmt("window_start").alias("window_start"), "n")


@query("t4_cache_key")
def t4(spark, d):
    k = W.cache_key("url", {"mode": "content", "max_length": 5000})
    return tbl(spark, d, "pages").select("page_id", k.alias("cache_key"), W.lookup_key(k).alias("lookup_key"))


def _cache_sets_gets(spark, d):
    ev = _ev(spark, d)
    sets = ev.filter(F.col("event_type") == "view").select(F.col("user_id").alias("key"), "ts")
    gets = ev.filter(F.col("event_type") != "view").select(F.col("user_id").alias("key"), "ts",
                                                           F.col("event_id").alias("get_id"))
    return sets, gets


@query("t5_cache_lookup")
def t5(spark, d):
    sets, gets = _cache_sets_gets(spark, d)
    r = W.cache_lookup(gets, sets, key="key", ttl_seconds=86400)
    return r.select("get_id", _fmt("set_ts").alias("set_ts"), "hit")


@query("t6_cache_upsert")
def t6(spark, d):
    ev = _ev(spark, d).select(F.col("user_id").alias("key"), "ts", "event_id",
                              F.col("event_type").alias("value"))
    r = W.cache_upsert(ev, key="key", ts="ts", value="value", order="event_id")
    return r.select("key", "value", _fmt("ts").alias("ts"))


@query("t7_cache_expire")
def t7(spark, d):
    sets, _ = _cache_sets_gets(spark, d)
    cache = sets.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 24 HOURS"))
    live = W.cache_expire(cache, "2024-01-20 00:00:00")
    return live.select("key", _fmt("ts").alias("ts"))


@query("t8_cache_misses")
def t8(spark, d):
    pages = tbl(spark, d, "pages")
    ev = _ev(spark, d).filter(F.col("event_type") == "view")
    cache = (pages.join(ev, pages.page_id == ev.user_id)
             .select(W.cache_key("url").alias("key"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at")))
    live = W.cache_expire(cache, "2024-01-20 00:00:00")
    req = pages.select("page_id", W.cache_key("url").alias("key"))
    return W.cache_misses(req, live).select("page_id")


@query("t8_cache_delete")
def t8_delete(spark, d):
    ev = _ev(spark, d)
    cache = ev.filter(F.col("event_type") == "view").select(F.col("user_id").alias("key"), "event_id")
    gone = ev.filter((F.col("event_type") == "error") & (F.col("value") > 140)).select(F.col("user_id").alias("key"))
    return W.cache_delete(cache, gone).select("event_id")


@query("t9_paginate")
def t9(spark, d):
    return W.paginate(tbl(spark, d, "pages").select("page_id", "url"), "page_id", 20, page=3)


@query("t9_all_pages")
def t9_all(spark, d):
    return W.paginate(tbl(spark, d, "pages").select("page_id", "url"), ["url", "page_id"], 20).select("page_id", "page_no", "total", "pages")


@query("t10_leading_n")
def t10(spark, d):
    p = tbl(spark, d, "pages").withColumn("host", U.host("url"))
    return W.leading_n(p, "host", "page_id", 5).select("host", "page_id", F.col("rn").cast("long").alias("rn"))


@query("t11_union_results")
def t11(spark, d):
    r = P.fail_rows(_fetches(spark, d))
    good = r.filter("success").select("page_id", "url", F.length("html").cast("long").alias("html_length"))
    bad = r.filter(~F.col("success")).select("page_id", "url", "error")
    return W.union_results(good, bad, "page_id").select("page_id", "url", "html_length", "error", "result_pos.position", "result_pos.kind")


# --- 2.F, 2.G (round trip over listing pages built from ``part``) ----------------

from ..operators import arrays as A, dedup as E, media as M, neardup as ND  # noqa: E402
from ..plans import selective as S  # noqa: E402
from ..profiles import ArraySpec, SelectiveSpec  # noqa: E402

LISTING_SPEC = ArraySpec("items", ".it", (("title", "h2"), ("image", "img"), ("link", "a"), ("tag", ".tag"),
                                          ("price", ".price")), None)
EMPTY_SPEC = ArraySpec("none", ".none", (), None)
TAGS_SPEC = ArraySpec("tags", ".tag", (), None)         # product types: a page repeats many


def _items(spark, d, specs=(LISTING_SPEC,), dedup=False):
    return A.item_rows(_array_pages(spark, d, specs, dedup))


def _array_pages(spark, d, specs=(LISTING_SPEC,), dedup=False):
    return A.absolutize_pages(A.array_pages(_listing(spark, d), list(specs), dedup_items=dedup), list(specs))


def _links(spark, d):
    pages = tbl(spark, d, "pages")
    return M.extract_links(pages, partitions=_spread(spark, pages))


@query("f1_array_items")
def f1(spark, d):
    it = _items(spark, d)
    return it.select("page_id", F.col("elem_pos").cast("long").alias("elem_pos"), "main_content",
                     F.col("word_count").cast("long").alias("word_count"),
                     F.col("char_count").cast("long").alias("char_count"))


@query("f2_limit_per_page")
def f2(spark, d):
    spec = ArraySpec("items", ".it", (), 5)
    it = _items(spark, d, (spec,))
    return it.select("page_id", F.col("elem_pos").cast("long").alias("elem_pos"), "main_content")


@query("f3_min_item_text")
def f3(spark, d):
    spec = ArraySpec("prices", ".price", (), None)   # price texts are under 15 chars: all dropped
    n = lambda i: F.size(F.get(F.col("arrays"), F.lit(i))["items"]).cast("long")
    return _array_pages(spark, d, (LISTING_SPEC, spec)).select("page_id", n(0).alias("kept_items"), n(1).alias("kept_prices"))


@query("f4_sub_text")
def f4(spark, d):
    it = _items(spark, d)
    return it.select("page_id", F.col("elem_pos").cast("long").alias("elem_pos"),
                     A.flatten_field(F.col("fields")["title"]).alias("title"),
                     A.flatten_field(F.col("fields")["tag"]).alias("tag"))


@query("f5_sub_image")
def f5(spark, d):
    it = _items(spark, d)
    return it.select("page_id", F.col("elem_pos").cast("long").alias("elem_pos"),
                     A.flatten_field(F.col("fields")["image"]).alias("image"))


@query("f6_image_src")
def f6(spark, d):
    n = dom.explode_nodes(_listing(spark, d), store=False)
    img = n.filter((F.col("kind") == "elem") & (F.col("tag") == "img"))
    return img.select("page_id", F.col("nid").cast("long").alias("nid"), A.image_src(F.col("attrs")).alias("src"))


@query("f7_sub_link")
def f7(spark, d):
    it = _items(spark, d)
    return it.select("page_id", F.col("elem_pos").cast("long").alias("elem_pos"),
                     A.flatten_field(F.col("fields")["link"]).alias("link"))


@query("f8_absolute_url")
def f8(spark, d):
    return _links(spark, d).select("page_id", "pos", "href")


@query("f10_flatten_field")
def f10(spark, d):
    it = _items(spark, d)
    return it.select("page_id", F.col("elem_pos").cast("long").alias("elem_pos"),
                     A.flatten_field(F.col("fields")["tag"], "join").alias("tag_join"),
                     A.flatten_field(F.col("fields")["tag"], "first").alias("tag_first"))


@query("f11_pivot_fields")
def f11(spark, d):
    it = _items(spark, d)
    out = A.pivot_fields(it, ["title", "image", "link", "tag", "price"])
    return out.select("page_id", F.col("index").cast("long").alias("index"), "title", "image", "link", "tag", "price")


TURN_SPEC = ArraySpec("turns", ".turn", (("title", "h3"), ("text", "p")), None)


def _turn_pages(spark, d, specs=None, dedup=True):
    pages = P.conversation_pages(tbl(spark, d, "conversations"))
    return A.array_pages(pages, specs or [TURN_SPEC], dedup_items=dedup)


@query("f12_array_summary")
def f12(spark, d):
    """A conversation's first turn stands twice on its page, so deduplication lowers the counts."""
    s = A.array_summary(_turn_pages(spark, d, [TURN_SPEC, EMPTY_SPEC]))
    return s.select("page_id", "array_name", F.col("count").cast("long").alias("count"),
                    F.array_join("sub_selectors_used", ",").alias("sub_selectors_used"),
                    "deduplication_applied")


@query("f14_format_structured")
def f14(spark, d):
    return _turn_pages(spark, d).select("page_id", A.format_structured().alias("content")).where("content <> ''")


@query("f13_page_array_summary")
def f13(spark, d):
    rows = _array_pages(spark, d, [LISTING_SPEC, EMPTY_SPEC]).select("page_id", A.page_summary().alias("s")).select("page_id", "s.*")
    return rows.select("page_id", F.col("total_selectors").cast("long").alias("total_selectors"),
                       F.col("total_items_extracted").cast("long").alias("total_items_extracted"),
                       F.array_join("successful_selectors", ",").alias("successful_selectors"), "total_words")


@query("f15_format_flat")
def f15(spark, d):
    return _array_pages(spark, d).select("page_id", A.format_flat().alias("content"))


@query("f16_format_summary")
def f16(spark, d):
    return _array_pages(spark, d, [LISTING_SPEC, EMPTY_SPEC]).select("page_id", A.format_summary().alias("content"))


@query("f17_array_extract")
def f17(spark, d):
    return _array_pages(spark, d, [LISTING_SPEC], dedup=True).select("page_id", A.format_structured().alias("content")).where("content <> ''")


def _turn_batch(spark, d):
    """Every page of a conversation, and a URL without a page beside it."""
    pages = P.conversation_pages(tbl(spark, d, "conversations"))
    missing = pages.select(F.lit(None).cast("long").alias("page_id"), F.concat("url", F.lit("?missing")).alias("url"),
                           F.lit(None).cast("string").alias("html"))
    return V.run_mode(pages.unionByName(missing), "array_batch", arrays=[TURN_SPEC])


@query("f18_array_batch")
def f18(spark, d):
    return _turn_batch(spark, d).select("url", "success", F.col("total_found").cast("long").alias("total_found"), F.array_join(
        F.transform("items", lambda x: F.concat_ws(" ", x["index"].cast("string"), x["fields"]["title"], x["fields"]["text"])), "|").alias("items"))


@query("f18_batch_totals")
def f18_totals(spark, d):
    return V.batch_totals(_turn_batch(spark, d))


@query("l1_extract_links")
def l1(spark, d):
    return _links(spark, d).select("page_id", "pos", "href", "text")


def _mixed_links(links):
    """The links, every second one of a page led to another host."""
    far = F.regexp_replace("href", "^[A-Za-z]+://[^/]*", "https://www.far.example.org")
    return links.withColumn("href", F.when(F.col("pos") % 2 == 1, far).otherwise(F.col("href")))


@query("l2_split_internal_external")
def l2(spark, d):
    """The links of pages and listings, with their whole addresses."""
    links = M.split_internal_external(_mixed_links(_links(spark, d).unionByName(M.extract_links(_listing(spark, d)))))
    origin = F.when(F.col("internal"), F.lit("")).otherwise(F.regexp_extract("href", "^[A-Za-z]+://[^/]*", 0))
    return links.select("page_id", "pos", "href", origin.alias("origin"), "internal")


@query("l3_exclude_external_links")
def l3(spark, d):
    links = M.exclude_external_links(_mixed_links(_links(spark, d)))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("internal_links"))


@query("l4_extract_images")
def l4(spark, d):
    return M.extract_images(_listing(spark, d))


@query("l6_link_graph")
def l6(spark, d):
    return M.link_graph(_links(spark, d)).select("source", "target", "weight", "out_degree", "in_degree", "referring_pages")


# --- 2.D, 2.E ---------------------------------------------------------------------

D1_SELECTORS = ["article", ".ad", "h1", "nav", ".none"]
# the same text twice, a text within another one, and texts of their own
D6_SELECTORS = ["article", "h1", "body > article", ".ad", "div", "body > div.ad, article > h1"]


def _section_rows(spark, d, selectors):
    pages = tbl(spark, d, "pages")
    return S.section_rows(pages.select("page_id", "html"), selectors, partitions=_spread(spark, pages))


@query("d1_sections")
def d1(spark, d):
    s = S.sections(_section_rows(spark, d, D1_SELECTORS))
    return s.select("page_id", F.col("sel_pos").cast("long").alias("sel_pos"), "content",
                    F.col("element_count").cast("long").alias("element_count"),
                    X.word_count("content").cast("long").alias("word_count"))


@query("d2_section_key")
def d2(spark, d):
    s = S.sections(_section_rows(spark, d, D1_SELECTORS))
    return s.select("page_id", "section_key", "selector")


@query("d3_fallback_section")
def d3(spark, d):
    # only French pages have the section, so sections and fallbacks stand side by side
    secs = S.sections(S.with_fallback(_section_rows(spark, d, ['html[lang="fr"] h1']), True))
    return secs.select("page_id", "section_key", "content", F.col("element_count").cast("long").alias("element_count"))


@query("d5_order_sections")
def d5(spark, d):
    rows = S.order_sections(_section_rows(spark, d, D1_SELECTORS))
    return rows.select("page_id", F.posexplode("sections").alias("pos", "s")).select(
        "page_id", "s.section_key", F.col("s.priority").cast("long").alias("priority"), (F.col("pos") + 1).cast("long").alias("rank"))


@query("d6_drop_nested_sections")
def d6(spark, d):
    rows = S.drop_nested_sections(S.order_sections(_section_rows(spark, d, D6_SELECTORS)))
    return rows.select("page_id", F.inline(F.arrays_zip("kept", "ranks"))).select(
        "page_id", "kept.section_key", (F.col("ranks") + 1).cast("long").alias("rank"))


@query("d9_selective")
def d9(spark, d):
    r = S.selective(tbl(spark, d, "pages"), SelectiveSpec(("article", ".ad", "h1"), (".none",), 5000))
    return r.select("page_id", "title", "content", F.col("word_count").cast("long").alias("word_count"),
                    F.col("total_sections").cast("long").alias("total_sections"), "extraction_method")


@query("d10_dedup_stats")
def d10(spark, d):
    r = S.selective(tbl(spark, d, "pages"), SelectiveSpec(("article", "h1"), (), None))
    return r.select("page_id", F.col("selectors_provided").cast("long").alias("selectors_provided"),
                    F.col("total_sections").cast("long").alias("unique_sections_found"), "deduplication_applied")


D11_CANDIDATES = ["main", 'html[lang="en"] article', ".ad", "h1", 'html[lang="fr"] h1']


@query("d11_selector_coverage")
def d11(spark, d):
    """Candidates that only some pages hold, so shares and ranks differ."""
    pages = tbl(spark, d, "pages")
    c = S.selector_coverage(pages, D11_CANDIDATES, partitions=_spread(spark, pages))
    return c.select("host", "selector", F.col("pages_matched").cast("long").alias("pages_matched"),
                    F.col("share").cast("double").alias("share"),
                    F.bround("mean_words", 4).alias("mean_words"),
                    F.col("suggested_rank").cast("long").alias("suggested_rank"))


@query("d12_exclude_coverage")
def d12(spark, d):
    pages = tbl(spark, d, "pages")
    c = S.exclude_coverage(pages, dom.explode_nodes(pages, store=False))
    return c.select("host", "selector", F.col("removed").cast("long").alias("removed"),
                    F.col("total").cast("long").alias("total"))


@query("e1_dedup_sentences")
def e1(spark, d):
    return tbl(spark, d, "documents").select("doc_id", X.dedup_sentences(X.collapse_ws("text")).alias("text"))


@query("e2_split_blocks")
def e2(spark, d):
    b = X.split_blocks(F.col("text"))
    return tbl(spark, d, "documents").select("doc_id", F.size(b).cast("long").alias("n_blocks"),
                                             F.array_join(b, " || ").alias("blocks"))


@query("e3_dedup_blocks_exact")
def e3(spark, d):
    r = E.dedup_blocks_exact(tbl(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", F.col("pos").cast("long").alias("pos"), "block")


@query("e4_dedup_blocks")
def e4(spark, d):
    return tbl(spark, d, "documents").select("doc_id", E.dedup_blocks(F.col("text")).alias("text"))


@query("e9_dedup_items")
def e9(spark, d):
    it = A.item_rows(_turn_pages(spark, d))
    return it.select("page_id", "array_name", F.col("index").cast("long").alias("index"), "main_content")


@query("e9_similar_items")
def e9_similar(spark, d):
    """Product types and cards of a listing: many are alike but not equal."""
    it = _items(spark, d, (TAGS_SPEC, LISTING_SPEC), dedup=True)
    return it.select("page_id", "array_name", F.col("index").cast("long").alias("index"), "main_content")


@query("e10_exact_duplicates")
def e10(spark, d):
    return E.exact_duplicates(tbl(spark, d, "documents"), "doc_id", "text").select(
        "doc_id", "rep", F.col("copies").cast("long").alias("copies"))


@query("e10_near_duplicates")
def e10n(spark, d):
    return ND.near_duplicates(tbl(spark, d, "documents"), "doc_id", "text")


@query("e11_duplicate_blocks_corpus")
def e11(spark, d):
    r = E.duplicate_blocks_corpus(tbl(spark, d, "documents"), "doc_id", "text", "source", 3)
    return r.select("source", "h", "block", F.col("docs").cast("long").alias("docs"))


@query("e11_drop_boilerplate")
def e11_drop(spark, d):
    return E.drop_boilerplate(tbl(spark, d, "documents"), "doc_id", "text", "source", 3).select("doc_id", "source", "text")


# --- 2.J streaming twins (run to completion with availableNow) ---------------------

from ..streaming import streams as ST  # noqa: E402


@query("s2_stream_rate_windows")
def s2(spark, d):
    ev = ST.event_stream(spark, d, "events.parquet")
    r = ST.run_update_to_table(ST.stream_rate_windows(ev), "s2", ["user_id", "window_start"])
    return r.select("user_id", _fmt("window_start").alias("window_start"), "n")


@query("s6_stream_batch_summary")
def s6(spark, d):
    pages_stream = ST.file_stream(spark, d, "pages.parquet", "page_id long, url string, html string")
    done = ST.stream_extract(pages_stream, lambda b: C.basic_content(
        b.withColumn("success", F.col("html").contains("</html>"))), "s6")
    return stats.batch_summary(done)


@query("s3_stream_sliding")
def s3(spark, d):
    ev = ST.event_stream(spark, d, "events.parquet")
    r = ST.run_update_to_table(ST.stream_rate_windows(ev, slide="30 minutes"), "s3", ["user_id", "window_start"])
    return r.select("user_id", _fmt("window_start").alias("window_start"), "n")


@query("s3_stream_sessions")
def s3_sessions(spark, d):
    ev = ST.event_stream(spark, d, "events.parquet")
    done = ST.run_append_to_table(ST.stream_sessions(ev, gap="6 hours", delay="0 seconds"), "s3s")
    # sessions are emitted once the watermark has passed them
    last = tbl(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    done = done.join(F.broadcast(last)).where("session_end <= last")
    return done.select("user_id", _fmt("session_start").alias("session_start"), _fmt("session_end").alias("session_end"), "n")


@query("s4_stream_dedup")
def s4(spark, d):
    """The events day by day; the TTL is far shorter than their span."""
    days, files = ST.by_day(tbl(spark, d, "events"), "s4-days", "user_id")
    ev = ST.event_stream(spark, days, "day=*", max_files=files).withColumn("cache_key", F.concat_ws(":", "user_id", "event_type"))
    done = ST.run_append_to_table(ST.stream_dedup_ttl(ev, ttl_seconds=48 * 3600), "s4")
    return done.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


# --- envelopes, sinks, modes ---------------------------------------------------------

from ..plans import envelopes as V  # noqa: E402
from ..session import scratch  # noqa: E402


@query("a10_error_json")
def a10(spark, d):
    bad = P.fail_rows(_fetches(spark, d)).where("not success")
    details = F.when(F.col("page_id") % 2 == 0, F.struct(F.col("url").alias("url")))
    return bad.select("page_id", V.error_json(F.col("error"), details).alias("json"))


@query("a11_write_results")
def a11(spark, d):
    r = P.fail_rows(_fetches(spark, d)).select("page_id", "url", "success")
    path = scratch(spark, "results")
    V.write_results(r, path)
    return spark.read.parquet(path).select("page_id", "url", F.col("success").cast("boolean").alias("success"))


@query("a12_flatten_envelope")
def a12(spark, d):
    pages = tbl(spark, d, "pages").select("page_id", F.struct("url", F.length("html").cast("long").alias("size")).alias("payload"))
    return V.success_envelope(pages, "payload")


@query("d8_return_sections")
def d8(spark, d):
    spec = SelectiveSpec((".ad", "article"), (), 5000, return_sections=True)
    r = S.selective(tbl(spark, d, "pages"), spec)
    return r.select("page_id", F.size(F.coalesce("sections", F.create_map().cast(
        "map<string,struct<selector:string,content:string,element_count:int>>"))).cast("long").alias("n_sections"),
        F.col("sections")["selector_1_.ad"]["content"].alias("ad"))


@query("d2_repeated_selector")
def d2_repeated(spark, d):
    s = S.sections(_section_rows(spark, d, ["h1", ".ad", "h1"]))
    return s.select("page_id", "section_key", F.col("sel_pos").cast("long").alias("sel_pos"))


@query("f9_auto_fields")
def f9(spark, d):
    r = V.auto_fields(P.conversation_pages(tbl(spark, d, "conversations")), ".turn")
    return r.select("page_id", F.col("index").cast("long").alias("index"), "title", "content", "image", "link", "date", "author")


@query("l5_skip_switches")
def l5(spark, d):
    lp = _listing(spark, d)
    one, two = M.media_columns(lp, skip_images=True), M.media_columns(lp, skip_links=True)
    n = lambda c: F.size(c).cast("long")
    return one.select("page_id", (n("internal_links") + n("external_links")).alias("links"), n("images").alias("no_images")).join(
        two.select("page_id", n("images").alias("images"), n("internal_links").alias("no_links")), "page_id")


@query("c7_failures")
def c7_failures(spark, d):
    """Failed fetches and pages without html are failures, not empty pages."""
    pages = tbl(spark, d, "pages").select(
        "page_id", "url", F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("html"),
        (F.col("page_id") % 5 != 0).alias("success"), F.lit("timeout").alias("error_message"))
    return C.content_only(pages).select("page_id", "success", "error", (F.col("content") == "").alias("empty"))


@query("g2_batch_timing")
def g2(spark, d):
    return stats.batch_timing(tbl(spark, d, "events").withColumn("elapsed", F.col("value")))


@query("g5_result_metadata")
def g5(spark, d):
    r = C.content_only(tbl(spark, d, "pages"), 100)
    meta = V.result_metadata("content", r)
    return r.select("page_id", meta.alias("m")).select(
        "page_id", F.col("m.original_html_length").cast("long").alias("original_html_length"),
        F.col("m.extraction_mode").alias("extraction_mode"))


@query("s1_stream_content_only")
def s1(spark, d):
    pages = ST.file_stream(spark, d, "pages.parquet", "page_id long, url string, html string")
    return ST.stream_extract(pages, C.content_only, "s1").select("page_id", "success", "title")


@query("g5_metadata_modes")
def g5_modes(spark, d):
    """The array mode's metadata struct."""
    r = V.array_results(P.conversation_pages(tbl(spark, d, "conversations")), [TURN_SPEC])
    r = r.select("page_id", "word_count", V.result_metadata("array", r).alias("m")).where("m.total_items_extracted > 0")
    return r.select("page_id", "m.extraction_mode", F.col("m.content_quality.total_items").cast("long").alias("total_items"),
                    F.array_join("m.successful_selectors", ",").alias("successful_selectors"), "word_count")


@query("g4_corpus_vocabulary")
def g4_corpus(spark, d):
    return stats.corpus_vocabulary(tbl(spark, d, "documents"), "source", "text").select(
        "source", "total_words", F.col("level").cast("long").alias("level"))


@query("s1_stream_selective")
def s1_selective(spark, d):
    pages = ST.file_stream(spark, d, "pages.parquet", "page_id long, url string, html string")
    spec = SelectiveSpec(("article", ".ad", "h1"), (".none",), 5000)
    r = ST.stream_extract(pages, lambda b: S.selective(b, spec), "s1d")
    return r.select("page_id", "title", "content", F.col("word_count").cast("long").alias("word_count"),
                    F.col("total_sections").cast("long").alias("total_sections"), "extraction_method")


@query("s1_stream_arrays")
def s1_arrays(spark, d):
    turns = ST.file_stream(spark, d, "conversations.parquet", "conv_id long, turn long, role string, text string")
    r = ST.stream_extract(turns, lambda b: V.array_results(P.conversation_pages(b), [TURN_SPEC]).drop("arrays"), "s1f")
    return r.select("page_id", "content").where("content <> ''")
