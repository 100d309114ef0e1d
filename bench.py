"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully computed with the no-op sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pageloom.plans.registry import QUERIES  # noqa: E402
from pageloom.session import get_spark, temporary_tables  # noqa: E402

HEADLINE = [
    "c1_regex_text", "b1_explode_nodes", "c4_page_title", "c7_content_only", "d1_sections", "d9_selective",
    "f17_array_extract", "l1_extract_links", "t1_rate_windows", "t2_rate_verdict", "t5_cache_lookup",
    "e1_dedup_sentences", "e3_dedup_blocks_exact", "e10_near_duplicates", "e11_duplicate_blocks_corpus",
]


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", partitions=max(cpus, 8))
    names = sys.argv[1:] or HEADLINE
    times = {}
    for n in names:
        t0 = time.time()
        with temporary_tables(spark):
            QUERIES[n](spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = d.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
