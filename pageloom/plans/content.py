"""Basic crawl (3.1) and content-only extraction (C7) as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import regex_text, strip_tags, truncate, word_count
from ..operators import pagerow as R
from ..profiles import SERVICE_DEFAULT_LENGTH, resolve_length
from ..sources.pages import with_html_source


def basic_content(df: DataFrame, max_length: int | None = None, uncut: bool = False) -> DataFrame:
    """C3 + C9(no ellipsis) + C10: first available of ``markdown``,
    ``text`` or tag-stripped ``html`` (chosen by column presence, as the
    fetch object's attributes were); result row per input row. ``uncut``
    keeps whole texts, as totals need."""
    cols = set(df.columns)
    if "markdown" in cols:
        src = F.col("markdown")
    elif "text" in cols:
        src = F.col("text")
    elif "html" in cols:
        src = strip_tags(F.col("html"))
    else:
        src = F.lit("")
    n = max_length if max_length else SERVICE_DEFAULT_LENGTH["basic"]
    content = src if uncut else truncate(src, n, ellipsis=False)
    title = F.substring(F.col("title"), 1, 200) if "title" in cols else F.lit("")
    ok = F.col("success") if "success" in cols else F.lit(True)
    err = F.coalesce(F.col("error_message"), F.lit("Crawl failed")) if "error_message" in cols else F.lit("Crawl failed")
    null_src = src.isNull()
    return df.select(
        (ok & ~null_src).alias("success"),
        F.col("url"),
        F.when(ok & ~null_src, title).otherwise(F.lit("")).alias("title"),
        F.when(ok & ~null_src, content).otherwise(F.lit("")).alias("content"),
        F.when(ok & ~null_src, word_count(content)).otherwise(F.lit(0)).alias("word_count"),
        F.when(~ok, err)
         .when(null_src, F.lit("Result processing failed: object of type 'NoneType' has no len()"))
         .alias("error"),
        F.when(ok & ~null_src, F.length(content)).alias("content_length"),
    )


def content_text(pages: DataFrame) -> DataFrame:
    """C7 core: (page_id, content): the main root's block text."""
    rows = R.page_rows(pages.select("page_id", "html"), R.content_spec()).withColumn("root", R.main_root())
    return rows.select("page_id", R.block_text(F.col("root")).alias("content"))


def content_only(pages: DataFrame, max_length: int | None = None, profile: str = "content", uncut: bool = False) -> DataFrame:
    """The content-only result per page: title from the original html,
    clean text truncated with ``...`` (whole with ``uncut``), word count and metadata. A failed
    fetch or a page without html is a failure with its message (A3); a page
    that cannot be parsed falls back to the regex text."""
    rows = R.page_rows(fetched(pages), R.content_spec(), "html").withColumn("root", R.main_root())
    whole = F.when(F.col("failure").isNotNull(), regex_text("failed_html")).otherwise(R.block_text(F.col("root")))
    n = resolve_length(max_length, "content")
    rows = rows.withColumn("whole", F.when(F.col("ok"), whole).otherwise(F.lit("")))
    rows = rows.withColumn("content", F.col("whole") if uncut else truncate("whole", n, ellipsis=True))
    return rows.select(
        "page_id", "url",
        F.col("ok").alias("success"), "error",
        F.when(F.col("ok"), R.title_text()).otherwise(F.lit("")).alias("title"),
        "content",
        word_count("content").alias("word_count"),
        F.length("content").cast("int").alias("content_length"),
        "original_html_length",
        F.lit("content_only").alias("extraction_mode"),
    )


def fetched(pages: DataFrame) -> DataFrame:
    """(page_id, url, ok, error, original_html_length, html): html only of fetches that succeeded."""
    return with_html_source(pages).select(
        "page_id", "url", "ok", "error", F.length("html_source").cast("int").alias("original_html_length"),
        F.when(F.col("ok"), F.col("html_source")).alias("html"))
