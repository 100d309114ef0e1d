"""Streams over tables that are folders of part files, and the TTL deduplication."""

import datetime as dt
import random

import pytest

from pageloom.plans.registry import QUERIES
from pageloom.streaming import streams as ST

HTML = "<html><head><title>T{0}</title></head><body><article><h1>Head {0}</h1><p>Some words of page {0} are here.</p></article></body></html>"


def tables(spark, folder, parts):
    """pages, conversations and events of 12 rows each, as one file or as a folder of part files."""
    made = {
        "pages": spark.createDataFrame([(i, f"https://a.com/{i}", HTML.format(i)) for i in range(12)], "page_id long, url string, html string"),
        "conversations": spark.createDataFrame([(i % 4, i // 4, "user", f"the words of turn {i} of this talk") for i in range(12)],
                                               "conv_id long, turn long, role string, text string"),
        "events": spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i), i % 2, "view", 1.0, "{}") for i in range(12)],
                                        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")}
    for name, df in made.items():
        at = f"{folder}/{name}.parquet"
        if parts == 1:
            df.toPandas().to_parquet(at, coerce_timestamps="us")
        else:
            df.repartition(parts).write.parquet(at)
    return str(folder)


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("name, rows", [("s1_stream_content_only", 12), ("s1_stream_selective", 12), ("s1_stream_arrays", 4),
                                        ("s6_stream_batch_summary", 1), ("s2_stream_rate_windows", 12)])
def test_streams_over_files_and_folders(spark, tmp_path, parts, name, rows):
    got = QUERIES[name](spark, tables(spark, tmp_path, parts)).collect()
    assert len(got) == rows
    if name == "s6_stream_batch_summary":
        assert got[0]["total_processed"] == 12


def hours(spark, n, keys, seed=5):
    draw = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(seconds=draw.randrange(20 * 86400)), draw.choice([*keys, None]), i) for i in range(n)],
                                 "ts timestamp, cache_key string, event_id long")


@pytest.mark.parametrize("day_rows", [1000, 10])
def test_dedup_by_buckets_against_a_plain_loop(spark, day_rows):
    """Several keys share a bucket, and one call: there were as many calls as keys of a day."""
    ev = hours(spark, 400, "abcdefghijk")
    days, files = ST.by_day(ev, "days", "cache_key", day_rows)
    assert files == 1 or day_rows == 10
    assert spark.read.parquet(days).drop("day").exceptAll(ev).isEmpty() and spark.read.parquet(days).count() == 400
    stream = ST.event_stream(spark, days, "day=*", ev.schema, max_files=files)
    got = ST.run_append_to_table(ST.stream_dedup_ttl(stream, ttl_seconds=48 * 3600, buckets=3), "ttl")
    want, last = set(), {}
    for ts, key, i in sorted(((r["ts"], r["cache_key"], r["event_id"]) for r in ev.collect()), key=lambda r: r[0]):
        if key not in last or (ts - last[key]).total_seconds() >= 48 * 3600:
            want.add(i)
            last[key] = ts
    assert {r["event_id"] for r in got.collect()} == want and got.columns == ev.columns
    assert got.count() == len(want)
