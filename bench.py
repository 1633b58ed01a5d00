"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from pagetide.plans.queries import QUERIES

HEADLINE = (
    "page_elements", "page_first_card", "first_match", "listing_cards", "page_content", "hero_images",
    "content_profile", "page_structure", "link_validation", "image_validation", "url_distributions",
    "text_counts", "keywords", "readability", "masked_text", "rolling_hour", "event_changes",
    "change_feed", "state_merge", "session_metrics", "parsed_responses", "outbox",
    "release_records", "page_edits", "stream_rates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["page_elements"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
