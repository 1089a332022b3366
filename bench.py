"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webloom.catalog import all_queries  # noqa: E402
from webloom.operators import snapshot  # noqa: E402
from webloom.plans.nodes import parse  # noqa: E402

HEADLINES = [
    "page_links", "link_importance", "page_main_content", "page_state_counts", "page_snapshots", "frontier",
    "lists_roundtrip", "forms_roundtrip", "scrape_products", "page_chain", "crawl_depth", "parse_report",
    "numbered_log", "redundant_actions", "compressed_history", "run_stats", "resolve_elements", "resolve_links",
    "best_match", "fallback_elements",
]


def _seconds(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("webloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Recording the Python line of every column call slows plan building down.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = sys.argv[1:] or HEADLINES
    times = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    count, dom = pages.count(), parse(pages)
    rates = {
        "nodes_pages_per_sec": round(count / _seconds(dom.nodes), 1),
        "snapshot_pages_per_sec": round(count / _seconds(snapshot.snapshot(dom)), 1),
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                **rates,
            }
        )
    )


if __name__ == "__main__":
    main()
