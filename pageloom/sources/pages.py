"""Page sources, batch requests and request validation (2.A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import validate_url
from ..schemas import PAGES

# Request validation messages.
MSG_BODY = "Request body is required"
MSG_URL = "URL is required"
MSG_BAD_URL = "Invalid URL format"
MSG_URLS = "URLs array is required"
MSG_URLS_TYPE = "URLs must be an array"
MSG_EMPTY = "At least one URL is required"
MSG_NO_HTML = "No HTML content found"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: page source with a declared schema. The html taken is ``html``
    when present (an empty string wins), else ``cleaned_html``; a row with
    neither fails with "No HTML content found"."""
    reader = spark.read
    if fmt == "parquet":
        df = reader.parquet(path)
    else:
        df = reader.schema(PAGES).format(fmt).load(path)
    return with_html_source(df)


def with_html_source(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    html = F.col("html") if "html" in cols else F.lit(None).cast("string")
    if "cleaned_html" in cols:
        html = F.when(html.isNotNull(), html).otherwise(F.col("cleaned_html"))
    ok = html.isNotNull()
    if "success" in cols:
        ok = ok & F.coalesce(F.col("success"), F.lit(True))
    err = F.when(html.isNull(), F.lit(MSG_NO_HTML))
    if "success" in cols:
        up = F.coalesce(F.col("error_message"), F.lit("Content extraction failed")) if "error_message" in cols \
            else F.lit("Content extraction failed")
        err = F.when(~F.coalesce(F.col("success"), F.lit(True)), up).otherwise(err)
    return df.withColumn("html_source", html).withColumn("ok", ok).withColumn("error", err)


def fail_rows(df: DataFrame, default_error: str = "Content extraction failed") -> DataFrame:
    """A3: an upstream failure passes through as ``success=false`` with its
    message, or the mode default when it has none."""
    cols = set(df.columns)
    ok = F.coalesce(F.col("success"), F.lit(True)) if "success" in cols else F.lit(True)
    msg = F.col("error_message") if "error_message" in cols else F.lit(None).cast("string")
    return df.withColumn("success", ok).withColumn(
        "error", F.when(~ok, F.coalesce(msg, F.lit(default_error))))


def requests_from(df: DataFrame, batch_col: str, urls_col: str) -> DataFrame:
    """Batch requests (batch_id, urls ARRAY) to one row per URL, keeping the
    input position."""
    return df.select(F.col(batch_col).alias("batch_id"), F.posexplode(urls_col).alias("batch_pos", "url"))


def lookup_urls(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """A2: every requested URL yields exactly one row in input order; a URL
    without a page gives a failed row. Duplicate pages of a URL resolve to
    the smallest page_id (pre-aggregated, so the join side is one row per
    URL and never multiplies requests)."""
    one = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    j = requests.join(one, "url", "left")
    return j.select("batch_id", "batch_pos", "url", "page_id",
                    F.col("page_id").isNotNull().alias("found"),
                    F.when(F.col("page_id").isNull(), F.lit(MSG_NO_HTML)).alias("error"))


def validate_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """A5: JSON request bodies -> ``error`` (NULL when valid)."""
    body = F.from_json(F.col(body_col), "map<string,string>")
    raw = body["url"]
    typed = F.from_json(F.col(body_col), "struct<url:variant>")["url"]
    is_str = F.coalesce(F.schema_of_variant(typed) == "STRING", F.lit(False))
    err = (F.when(body.isNull() | (F.size(body) == 0), F.lit(MSG_BODY))
           .when(~F.map_contains_key(body, "url"), F.lit(MSG_URL))
           .when(~is_str | ~F.coalesce(validate_url(raw), F.lit(False)), F.lit(MSG_BAD_URL)))
    return df.withColumn("error", err)


def validate_batches(df: DataFrame, urls_col: str = "urls", max_batch_size: int = 10) -> DataFrame:
    """Empty list, too many URLs, first invalid URL named."""
    urls = F.col(urls_col)
    bad = F.filter(urls, lambda u: ~validate_url(u))
    err = (F.when(urls.isNull(), F.lit(MSG_URLS))
           .when(F.size(urls) == 0, F.lit(MSG_EMPTY))
           .when(F.size(urls) > max_batch_size, F.lit(f"Maximum {max_batch_size} URLs allowed per batch"))
           .when(F.size(bad) > 0, F.concat(F.lit("Invalid URL format: "), F.try_element_at(bad, F.lit(1)))))
    return df.withColumn("error", err).withColumn("kept_urls", F.slice(urls, 1, max_batch_size))


# --- synthesised listing pages (round-trip source) ---------------------------

LISTING_BLOCK = 200      # part keys per listing page: bounded page size


def _tasks(df: DataFrame) -> int:
    """Tasks for pages that are made from rows. Rows are far smaller than the work that parsing their pages
    costs, so their exchange (the one that the grouping needs anyway) keeps all its partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def listing_pages(part: DataFrame, block: int = LISTING_BLOCK) -> DataFrame:
    """Listing pages built from ``part``: one page per brand and block of
    ``block`` part keys (bounded page size at any scale), items in part-key
    order. Columns: page_id, url, html."""
    brand = F.regexp_replace("p_brand", "#", "")
    item = F.concat(
        F.lit('<div class="it"><h2><a href="/p/'), F.col("p_partkey").cast("string"), F.lit('">'), F.col("p_name"),
        F.lit('</a></h2><img data-src="../img/'), F.col("p_partkey").cast("string"), F.lit('.jpg" alt="'),
        F.col("p_name"), F.lit('"><span class="price">'), F.format_string("%.2f", F.col("p_retailprice")),
        F.lit('</span><span class="tag">'), F.col("p_type"), F.lit('</span><span class="tag">size '),
        F.col("p_size").cast("string"), F.lit("</span></div>"))
    items = (part.select("p_brand", (F.col("p_partkey") / block).cast("long").alias("blk"),
                         "p_partkey", item.alias("item"))
             .repartition(_tasks(part), "p_brand", "blk")
             .groupBy("p_brand", "blk")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "item"))),
                                           lambda x: x["item"]), "").alias("items")))
    bnum = F.regexp_extract("p_brand", "(\\d+)$", 1).cast("long")      # two figures: ids of brands and blocks never meet
    return items.select(
        (F.lit(1_000_000_000) + F.col("blk") * 100 + bnum).alias("page_id"),
        F.concat(F.lit("https://shop.example.com/brand/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"),
                 F.col("blk").cast("string"), F.lit("/index.html")).alias("url"),
        F.concat(F.lit("<html><head><title>"), F.col("p_brand"),
                 F.lit('</title></head><body><main id="main-content"><div class="grid">'), F.col("items"),
                 F.lit('</div></main><div class="sidebar">'), F.col("p_brand"),
                 F.lit(" ads</div></body></html>")).alias("html"))


LISTING_SQL = """
(SELECT 1000000000 + blk * 100 + CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS page_id,
        'https://shop.example.com/brand/' || replace(p_brand, '#', '') || '/' || CAST(blk AS VARCHAR) || '/index.html' AS url,
        '<html><head><title>' || p_brand || '</title></head><body><main id="main-content"><div class="grid">'
          || string_agg(item, '' ORDER BY p_partkey) || '</div></main><div class="sidebar">' || p_brand
          || ' ads</div></body></html>' AS html
 FROM (SELECT p_brand, p_partkey, CAST(floor(p_partkey / 200) AS BIGINT) AS blk,
              '<div class="it"><h2><a href="/p/' || CAST(p_partkey AS VARCHAR) || '">' || p_name
              || '</a></h2><img data-src="../img/' || CAST(p_partkey AS VARCHAR) || '.jpg" alt="' || p_name
              || '"><span class="price">' || printf('%.2f', p_retailprice) || '</span><span class="tag">' || p_type
              || '</span><span class="tag">size ' || CAST(p_size AS VARCHAR) || '</span></div>' AS item
       FROM part) t
 GROUP BY p_brand, blk)
"""

def conversation_pages(conversations: DataFrame) -> DataFrame:
    """One page per conversation: an item per turn, in order, and the first turn quoted once more at the end
    (its role in capitals). Columns: page_id, url, html."""
    text = F.coalesce("text", F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = lambda role, t: F.concat(F.lit('<div class="turn"><h3>'), role, F.lit('</h3><p>'), t, F.lit("</p></div>"))
    turns = conversations.repartition(_tasks(conversations), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", safe.alias("t")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: item(x["role"], x["t"])), "")
    first = F.get(F.col("l"), F.lit(0))
    return turns.select(
        F.col("conv_id").cast("long").alias("page_id"),
        F.concat(F.lit("https://talk.example.com/c/"), F.col("conv_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><head><title>"), F.col("conv_id").cast("string"), F.lit("</title></head><body>"), body,
                 item(F.upper(first["role"]), first["t"]),
                 F.lit("</body></html>")).alias("html"))


PAGE_SCHEMA = T.StructType(PAGES.fields)
