"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from textlake import registry
from textlake.plans.search import index_of

HEADLINE = ("search", "analyze", "build_postings", "bm25_rank", "tokenize_offsets", "refresh_batch", "parse_headings", "library_tree", "fix_visual_order", "latest_intent", "page_reading_order")

registry.load()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    # searches read a stored index; what it costs to build is told apart
    began = time.time()
    index_of(spark, sf)
    took["build_index"] = round(time.time() - began, 3)
    for name in HEADLINE:
        spark.catalog.clearCache()
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
