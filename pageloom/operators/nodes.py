"""Node-table operators: removals, exclusion and selection, as row-local
predicates on a node and its ancestor chain. The request modes use the page row
(``pagerow``); the node table is for queries over single nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import css
from .pagerow import compile_selectors


def drop_tags(nodes: DataFrame, tags) -> DataFrame:
    """Remove elements with the listed tags together with their
    subtrees. Narrow: a row-local test on the node and its ``anc``."""
    tags = list(tags)
    if not tags:
        return nodes
    return nodes.filter(~((F.col("kind") == "elem") & F.col("tag").isin(tags))
                        & ~F.exists("anc", lambda a: a["tag"].isin(tags)))


def drop_images(nodes: DataFrame) -> DataFrame:
    """Remove every ``img`` (and whatever an unclosed one holds)."""
    return drop_tags(nodes, ["img"])


def exclude(nodes: DataFrame, selectors, warnings: list | None = None) -> DataFrame:
    """Remove the subtrees of elements matched by any exclude selector."""
    hit = None
    for _, sel in compile_selectors(selectors, warnings):
        h = css.self_matches(sel) | css.inside_match(sel)
        hit = h if hit is None else (hit | h)
    return nodes if hit is None else nodes.filter(~F.coalesce(hit, F.lit(False)))


def select(nodes: DataFrame, selector) -> DataFrame:
    """All elements matching ``selector``, in document order per page
    (``nid``); a node matching several comma alternatives appears once."""
    return nodes.filter(css.self_matches(selector))
