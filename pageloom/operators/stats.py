"""Batch summaries and content statistics (2.H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.urls import host


def batch_summary(results: DataFrame, success: str = "success") -> DataFrame:
    """G1: total_processed, successful, failed."""
    ok = F.coalesce(F.col(success), F.lit(False))
    return results.agg(F.count(F.lit(1)).alias("total_processed"),
                       F.count_if(ok).alias("successful"),
                       F.count_if(~ok).alias("failed"))


def batch_timing(results: DataFrame, elapsed: str = "elapsed", n_urls: int | None = None) -> DataFrame:
    """Total time and mean per URL rounded to 2 (half-even), 0 when
    empty."""
    n = F.lit(n_urls) if n_urls is not None else F.count(F.lit(1))
    total = F.coalesce(F.sum(elapsed), F.lit(0.0))
    return results.agg(F.bround(total, 2).alias("total_time"),
                       F.when(n > 0, F.bround(total / n, 2)).otherwise(F.lit(0.0)).alias("average_time_per_url"))


def batch_content_stats(results: DataFrame, content: str = "content", success: str = "success") -> DataFrame:
    """Total characters of successful contents; mean over
    max(successes, 1), rounded to 0 places."""
    ok = F.coalesce(F.col(success), F.lit(False))
    total = F.coalesce(F.sum(F.when(ok, F.length(content))), F.lit(0)).cast("long")
    succ = F.count_if(ok)
    return results.agg(total.alias("total_content_extracted"),
                       F.bround(total / F.greatest(succ, F.lit(1)), 0).alias("average_content_per_url"))


def host_rollup(results: DataFrame, url: str = "url", success: str = "success") -> DataFrame:
    """G1 by host and outcome with subtotals and a grand total."""
    return (results.withColumn("host", host(F.col(url)))
            .rollup("host", success).agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.length("content")).cast("long").alias("chars")))


SKETCH_BITS = 14          # 2^14 registers: a standard error of about 0.8 %


def corpus_vocabulary(docs: DataFrame, group: str, text: str) -> DataFrame:
    """G4 over a corpus: total words and the distinct lower-cased words longer than 3, by group and over all (``level`` 0 and 1).

    Distinct counts are mergeable sketches: one per group, filled map-side, and their union; no word is shuffled."""
    w = docs.select(group, F.explode(words(F.col(text))).alias("w"))
    per = w.groupBy(group).agg(F.count(F.lit(1)).alias("total_words"), F.hll_sketch_agg(
        F.when(F.length("w") > 3, F.lower("w")), SKETCH_BITS).alias("sketch"))
    both = per.withColumn("level", F.lit(0)).unionByName(per.agg(
        F.lit(None).cast("string").alias(group), F.sum("total_words").alias("total_words"),
        F.hll_union_agg("sketch").alias("sketch")).withColumn("level", F.lit(1)))
    n = F.hll_sketch_estimate("sketch")
    return both.select(group, "level", "total_words", n.alias("unique_words"),
                       F.bround(n / F.greatest("total_words", F.lit(1)), 3).alias("vocabulary_ratio"))
