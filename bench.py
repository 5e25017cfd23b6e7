"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from pageloom.bindings import QUERIES

HEADLINE = (
    "page_tag_counts", "page_links", "clean_text", "page_sections", "nav_bullets", "page_markdown", "page_to_markdown",
    "price_names", "topics", "grid_markdown", "infobox_rows", "card_struct", "stats", "records_typed", "item_documents",
    "card_markdown", "pending_pages", "entity_lookup",
    "history", "prompts", "latest_state", "tool_responses", "answers", "stream_messages",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED", f"file://{tempfile.mkdtemp(prefix='bench-')}"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.time()
        # Everything the query computes, without sending it to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
