"""Structured Streaming forms (2.J): the batch operators applied to data
that lands over time. File sources with ``availableNow`` in tests; no
sockets or ports."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, temporary_tables

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def file_stream(spark: SparkSession, folder: str, name_glob: str, schema, max_files: int | None = None) -> DataFrame:
    """Files landing in ``folder`` whose names match ``name_glob``, and files landing in its folders of such names: a
    table may be one file or a folder of part files."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{folder}/{{{name_glob}}}")     # braces: a pattern, also without a wildcard, may match files and folders


def event_stream(spark: SparkSession, folder: str, name_glob: str = "events*.parquet", schema: T.StructType = EVENTS,
                 max_files: int | None = None) -> DataFrame:
    # watermarks need TIMESTAMP, the test data has TIMESTAMP_NTZ
    return file_stream(spark, folder, name_glob, schema, max_files).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_rate_windows(events: DataFrame, key: str = "user_id", width: str = "1 hour",
                        slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per key and (tumbling or sliding) window; rows later
    than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.withWatermark("ts", delay).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("window_start"), "n"))


def stream_sessions(events: DataFrame, key: str = "user_id", gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """S3: request bursts per key as session windows."""
    return (events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n"))


def first_in_ttl(stamps: np.ndarray, last: int, ttl: int) -> tuple[np.ndarray, int]:
    """Which of the sorted times (microseconds) are processed, and the last one that is: a time is
    skipped while less than ``ttl`` has passed since the last processed one."""
    keep = np.zeros(stamps.size, dtype=bool)
    i = int(np.searchsorted(stamps, last + ttl)) if last >= 0 else 0
    while i < stamps.size:
        keep[i], last = True, int(stamps[i])
        i = int(np.searchsorted(stamps, last + ttl))
    return keep, last


BUCKETS = 1024            # groups of keys, each with one state
DAY_ROWS = 1_000_000      # rows that one task writes of a day, and reads again, at most about


def stream_dedup_ttl(requests: DataFrame, key: str = "cache_key", ttl_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """A request is processed unless its key was processed less than the TTL before. The state is one time per
    key, dropped when the watermark has passed its end; a row that comes out of order meets the key's last processed time.
    Keys are dealt to buckets by their hash; one call and one state serve all keys of a bucket."""
    ttl, columns = ttl_seconds * 1_000_000, requests.columns

    def step(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        stamps = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        codes, keys = pd.factorize(rows["key of state"], use_na_sentinel=False)
        own = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1])     # places by key, in order of time
        keep = np.zeros(len(rows), dtype=bool)
        for k, at in zip(keys, own):
            k = None if pd.isna(k) else k
            keep[at], end = first_in_ttl(stamps[at], last.get(k, -1), ttl)
            if end >= 0:
                last[k] = end
        now = state.getCurrentWatermarkMs()
        last = {k: t for k, t in last.items() if (t + ttl) // 1000 > now}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp((max(last.values()) + ttl) // 1000)
        elif state.exists:
            state.remove()
        if keep.any():
            yield rows.loc[keep, columns]

    return requests.withColumn("key of state", F.col(key).cast("string")) \
        .withColumn("bucket of state", F.pmod(F.xxhash64("key of state"), F.lit(buckets))) \
        .withWatermark("ts", f"{ttl_seconds} seconds").groupBy("bucket of state").applyInPandasWithState(
        step, requests.schema, "keys array<string>, lasts array<long>", "append", "EventTimeTimeout")


def by_day(events: DataFrame, name: str, key: str, day_rows: int | None = None) -> tuple[str, int]:
    """The events in folders by day, written in the order in which a stream reads them, and the files that a day has at
    most. The table is dealt to the days in one pass; a key's rows of a day stand in one file."""
    spark, out = events.sparkSession, _scratch(events.sparkSession, name)
    days = events.groupBy(F.to_date("ts").alias("d")).count().where("d is not null").orderBy("d").collect()   # one row per day
    files = -(-max((r["count"] for r in days), default=1) // (day_rows or DAY_ROWS))
    part = F.pmod(F.xxhash64(key), F.lit(files))
    dealt = events.withColumn("day", F.to_date("ts")).where("day is not null").withColumn("part of day", part)
    dealt.repartition("day", "part of day").write.partitionBy("day", "part of day").parquet(f"{out}-dealt")
    for r in days:
        own = spark.read.schema(events.schema).parquet(f"{out}-dealt/day={r['d']}").select(*events.columns)
        own = own.coalesce(1) if files == 1 else own.repartition(files, part)
        own.write.parquet(f"{out}/day={r['d']}")
    return out, files


def run_update_to_table(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stateful stream to completion (``availableNow``) in update mode;
    every micro-batch's updated rows are appended with their epoch to a
    parquet folder in the shared checkpoint directory, and the latest
    version per key is the result (equal to the batch form)."""
    spark = df.sparkSession
    out = _scratch(spark, name)

    def sink(batch: DataFrame, epoch: int):
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (df.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out).drop("epoch")
    latest = F.max_by(F.struct(*[c for c in res.columns if c not in keys and c != "_epoch"]), "_epoch")
    return res.groupBy(*keys).agg(latest.alias("v")).select(*keys, "v.*")


def run_append_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run a stream to completion in append mode (``availableNow``) into a
    folder of the shared checkpoint directory; the file sink commits each
    epoch once."""
    out = _scratch(df.sparkSession, name)
    q = (df.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def stream_extract(pages_stream: DataFrame, transform, name: str = "extract") -> DataFrame:
    """Newly landed pages -> extraction results, appended. Per-page
    group-bys run inside ``foreachBatch`` (a page is complete in its row)."""
    spark = pages_stream.sparkSession
    out = _scratch(spark, name)

    def sink(batch: DataFrame, epoch: int):
        # a folder per epoch, overwritten: a retried micro-batch counts once; what the transformation
        # stored on its way is released after the epoch is written
        with temporary_tables(spark):
            transform(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (pages_stream.writeStream.foreachBatch(sink).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch")
