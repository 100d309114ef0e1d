"""Links and images (2.G) from the page row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..functions.urls import absolute_url, host
from . import pagerow as R
from .arrays import image_src
from .treepass import TreeSpec


_ALL = TreeSpec(attributes=True)       # the original tree, with the attributes of links and images


def _tagged(tag: str) -> Column:
    """The elements with a tag, in document order."""
    return F.filter("nodes", lambda n: n["tag"] == tag)


def link_array(base: Column) -> Column:
    """L1 + F8 on a page row: (href, text) of every ``a``, its href made absolute and its text (stripped
    strings joined without separator, C13)."""
    return F.transform(_tagged("a"), lambda n: F.struct(
        absolute_url(base, strip_ws(F.coalesce(n["attrs"]["href"], F.lit("")))).alias("href"),
        R.joined(n["first"], n["cnt"]).alias("text")))


def image_array(base: Column) -> Column:
    """L4 on a page row: (src, alt, title) of every ``img``, src absolute (F6 attribute order)."""
    return F.transform(_tagged("img"), lambda n: F.struct(
        absolute_url(base, F.coalesce(image_src(n["attrs"]), F.lit(""))).alias("src"),
        F.coalesce(n["attrs"]["alt"], F.lit("")).alias("alt"), F.coalesce(n["attrs"]["title"], F.lit("")).alias("title")))


def extract_links(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """L1: one row per link: (page_id, page_url, pos, href, text)."""
    rows = R.page_rows(pages.select("page_id", "url", "html"), _ALL, partitions=partitions)
    return rows.select("page_id", F.col("url").alias("page_url"), F.posexplode(link_array(F.col("url"))).alias("pos", "l")) \
        .select("page_id", "page_url", F.col("pos").cast("long").alias("pos"), "l.href", "l.text")


def split_internal_external(links: DataFrame) -> DataFrame:
    """L2: a link is internal when its host equals the page host."""
    return links.withColumn("internal", host(F.col("href")) == host(F.col("page_url")))


def exclude_external_links(links: DataFrame) -> DataFrame:
    """L3."""
    return split_internal_external(links).filter("internal")


def extract_images(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """L4: one row per image: (page_id, pos, src, alt, title)."""
    rows = R.page_rows(pages.select("page_id", "url", "html"), _ALL, partitions=partitions)
    return rows.select("page_id", F.posexplode(image_array(F.col("url"))).alias("pos", "i")) \
        .select("page_id", F.col("pos").cast("long").alias("pos"), "i.src", "i.alt", "i.title")


def media_columns(pages: DataFrame, skip_images: bool = False, skip_links: bool = False) -> DataFrame:
    """(page_id, internal_links, external_links, images); a skipped kind is an empty array and never computed."""
    rows = R.page_rows(pages.select("page_id", "url", "html"), _ALL)
    links = F.array().cast("array<struct<href:string,text:string>>") if skip_links else link_array(F.col("url"))
    images = F.array().cast("array<struct<src:string,alt:string,title:string>>") if skip_images else image_array(F.col("url"))
    own = lambda x: host(x["href"]) == host(F.col("url"))  # noqa: E731  (null, neither kind, without a host)
    return rows.select("page_id", "url", links.alias("_l"), images.alias("images")).select(
        "page_id", F.filter("_l", own).alias("internal_links"), F.filter("_l", lambda x: ~own(x)).alias("external_links"), "images")


def link_graph(links: DataFrame) -> DataFrame:
    """One row per page -> target edge with its weight, the out-degree of the page and the in-degree of
    the target. Edges are aggregated first, so both degrees count over distinct edges already summed."""
    edges = links.select(F.col("page_url").alias("source"), F.col("href").alias("target")).filter("target <> ''") \
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    out_d = edges.groupBy("source").agg(F.sum("weight").alias("out_degree"))
    in_d = in_degrees(edges)
    return edges.join(out_d, "source").join(in_d, "target")


def in_degrees(edges: DataFrame) -> DataFrame:
    """(target, in_degree, referring_pages) of aggregated edges."""
    return edges.groupBy("target").agg(F.sum("weight").alias("in_degree"), F.count(F.lit(1)).alias("referring_pages"))
