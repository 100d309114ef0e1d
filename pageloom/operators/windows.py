"""Request-rate windows, TTL cache as tables, paging and unions (2.I)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# The default limits of the rate limiter and the cache TTL.
DEFAULT_LIMITS = (("1 minute", 20), ("1 hour", 100))
DEFAULT_TTL_SECONDS = 3600


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``TIMESTAMP_NTZ`` to ``TIMESTAMP`` (session time zone UTC), as
    watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def rate_windows(events: DataFrame, key: str = "user_id", width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Requests per key and tumbling window (partial aggregation map-side,
    so a hot key costs one row per task before the shuffle)."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    return (events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


BUCKET_ROWS = 65_536      # rows of a range bucket


def range_buckets(df: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_bkt``, stored: rows sorted by ``order`` over the whole table and cut into buckets of at most
    ``bucket_rows`` consecutive rows. A key's rows lie in buckets that follow each other, however many it has, so
    work per (bucket, key) is bounded. ``order`` should name a row uniquely, lest equal rows be cut at random."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()                  # partition number, then place in the sorted partition
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    bucket = F.shiftright(at, 33) * F.lit(1 << 24) + F.floor(place / bucket_rows)
    return stored(ranged.select("*", bucket.cast("long").alias("_bkt")), "buckets")


def _before(summary: DataFrame, group: list[str], value: str, fold) -> DataFrame:
    """A (group, bucket) summary with ``fold`` of ``value`` over the earlier buckets of the group: one row per bucket, not per row."""
    w = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(value, fold(F.col(value)).over(w))


def rate_verdict(events: DataFrame, limits=DEFAULT_LIMITS, key: str = "user_id", ts: str = "ts",
                 order: str = "event_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The n-th request of a key in its window is allowed while n <= limit,
    for every limit; remaining, reset time and retry-after per limit.

    A two-level count: places inside a range bucket, plus the counts of the same window in earlier
    buckets, which are one row per bucket and window. No task meets more of a hot key than a bucket."""
    out = range_buckets(events.withColumn("_t", F.col(ts).cast("timestamp")), [key, "_t", order], bucket_rows)
    for i, (width, _) in enumerate(limits):
        out = out.withColumn(f"_w{i}", F.window("_t", width)).withColumn(f"_s{i}", F.col(f"_w{i}.start"))
    rows = out
    for i, (_, limit) in enumerate(limits):
        mine = Window.partitionBy("_bkt", key, f"_s{i}").orderBy("_t", order)
        counts = out.groupBy(key, f"_s{i}", "_bkt").agg(F.count(F.lit(1)).alias(f"_c{i}"))
        carry = _before(counts, [key, f"_s{i}"], f"_c{i}", F.sum)
        rows = rows.withColumn(f"n_{i}", F.row_number().over(mine)).join(
            carry.select(F.col(key).alias("_k"), F.col(f"_s{i}").alias("_s"), F.col("_bkt").alias("_b"), f"_c{i}"),
            F.col(key).eqNullSafe(F.col("_k")) & (F.col(f"_s{i}") == F.col("_s")) & (F.col("_bkt") == F.col("_b")), "left").drop("_k", "_s", "_b")
        rows = rows.withColumn(f"n_{i}", (F.col(f"n_{i}") + F.coalesce(f"_c{i}", F.lit(0))).cast("long"))
        rows = (rows.withColumn(f"remaining_{i}", F.greatest(F.lit(limit) - F.col(f"n_{i}"), F.lit(0)))
                .withColumn(f"reset_{i}", F.col(f"_w{i}.end")).drop(f"_w{i}", f"_s{i}", f"_c{i}"))
    allowed = F.lit(True)
    for i, (_, limit) in enumerate(limits):
        allowed = allowed & (F.col(f"n_{i}") <= limit)
    rows = rows.withColumn("allowed", allowed)
    retry = F.greatest(*[F.when(F.col(f"n_{i}") > lim, F.unix_timestamp(F.col(f"reset_{i}")) - F.unix_timestamp("_t"))
                         for i, (_, lim) in enumerate(limits)] + [F.lit(None).cast("long")])
    return rows.withColumn("retry_after", F.when(~F.col("allowed"), retry)).drop("_t", "_bkt")


def rate_exempt(events: DataFrame, exempt_keys: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(limited, exempt) split with anti / semi joins; the key table is a
    distinct key list, broadcast by the planner when its size allows."""
    keys = exempt_keys.select(key).distinct()
    return events.join(keys, key, "left_anti"), events.join(keys, key, "left_semi")


def config_digest(config: dict | None) -> str:
    """md5 of the sorted-key JSON of a request config (driver side)."""
    return hashlib.md5(json.dumps(config or {}, sort_keys=True).encode()).hexdigest()


def cache_key(url, config: dict | None = None) -> Column:
    """T4: ``crawl:{url}:{md5(config json)}``."""
    u = F.col(url) if isinstance(url, str) else url
    return F.concat(F.lit("crawl:"), u, F.lit(":"), F.lit(config_digest(config)))


def lookup_key(key) -> Column:
    """T4: the stored key is md5 of the cache key."""
    return F.md5(F.col(key) if isinstance(key, str) else key)


def cache_lookup(gets: DataFrame, sets: DataFrame, key: str = "key", ts: str = "ts",
                 ttl_seconds: int = DEFAULT_TTL_SECONDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """T5 as-of join: a get hits when the last set at or before it (same
    instant counts) expires strictly after it. TTL 0 means the default.

    Sets and gets are sorted together into range buckets of bounded row count; the last set before a bucket comes from
    one row per (key, bucket), so one hot key, even within one instant, is spread over many tasks."""
    ttl = ttl_seconds or DEFAULT_TTL_SECONDS
    g = gets.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.lit(1).alias("kind"), F.col("get_id"))
    s = sets.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.lit(0).alias("kind"),
                    F.lit(None).cast("long").alias("get_id"))
    u = range_buckets(g.unionByName(s), ["k", "t", "kind", "get_id"], bucket_rows)
    set_at = F.max(F.when(F.col("kind") == 0, F.col("t")))
    carry = _before(u.groupBy("k", "_bkt").agg(set_at.alias("carry")), ["k"], "carry", F.max)
    w = Window.partitionBy("_bkt", "k").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    within = u.withColumn("last_set", set_at.over(w)).filter("kind = 1")
    carry = carry.select(F.col("k").alias("_k"), F.col("_bkt").alias("_b"), "carry")
    out = (within.join(carry, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_bkt") == F.col("_b")), "left")
           .select(F.col("k").alias(key), "get_id", F.col("t").alias(ts),
                   F.coalesce(F.col("last_set"), F.col("carry")).alias("set_ts")))
    exp = F.col("set_ts") + F.make_interval(secs=F.lit(ttl))
    return out.withColumn("expires_at", exp).withColumn("hit", F.coalesce(F.col("expires_at") > F.col(ts), F.lit(False)))


def cache_upsert(sets: DataFrame, key: str = "key", ts: str = "ts", value: str = "value",
                 order: str | None = None) -> DataFrame:
    """Last write wins per key (max_by aggregates partially map-side)."""
    ordering = F.struct(F.col(ts), F.col(order)) if order else F.col(ts)
    return sets.groupBy(key).agg(F.max_by(F.col(value), ordering).alias(value), F.max(ts).alias(ts))


def cache_expire(cache: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """Drop entries with ``expiry <= now``."""
    return cache.filter(F.col(expires) > F.lit(now).cast("timestamp"))


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests without a live cache entry (left anti join)."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def cache_delete(cache: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The cache without the listed keys; keys that are not in it change nothing."""
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def numbered(df: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``row_no`` (from 1, by ``order``) and ``total``. Every row's place in its range bucket plus the rows of
    the buckets before: no sort of the table in one task."""
    rows = range_buckets(df, order, bucket_rows)
    counts = rows.groupBy("_bkt").agg(F.count(F.lit(1)).alias("c"))
    all_ = counts.agg(F.sum("c").alias("total"))
    # one row per bucket: the running sum is over buckets, not rows
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(
        Window.partitionBy(F.lit(0)).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_bkt").orderBy(*order))
    return rows.withColumn("row_no", place).join(before.select("_bkt", "before"), "_bkt").join(F.broadcast(all_)) \
        .withColumn("row_no", (F.col("row_no") + F.col("before")).cast("long")).drop("_bkt", "before")


def paginate(df: DataFrame, order: str | list[str], per_page: int, page: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All pages (``page_no`` from 1), or one of them, plus the page count ``ceil(total/per_page)``."""
    rows = numbered(df, [order] if isinstance(order, str) else order, bucket_rows)
    rows = rows.withColumn("page_no", (F.floor((F.col("row_no") - 1) / per_page) + 1).cast("long")) \
        .withColumn("pages", F.ceil(F.col("total") / per_page).cast("long")).drop("row_no")
    return rows if page is None else rows.where(F.col("page_no") == page).drop("page_no")


def leading_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows per group (top-k per group)."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rn", rn).filter(F.col("rn") <= n)


def union_results(good: DataFrame, failed: DataFrame, position: str) -> DataFrame:
    """Good and failed rows in one table (missing columns as NULL), with the
    ordering column ``result_pos``: the request's position, good before failed where both have one."""
    both = good.withColumn("_kind", F.lit(0)).unionByName(failed.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("result_pos", F.struct(F.col(position).alias("position"), F.col("_kind").alias("kind"))).drop("_kind")
