"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pagelake.plans.registered import registered  # noqa: E402
from pagelake.session import SETTINGS  # noqa: E402

HEADLINE = (
    "site_links", "build_pages", "page_contacts", "page_links", "needs_render", "html_tokens", "html_elements",
    "drop_subtrees", "template_cards", "generic_cards", "page_services", "next_page", "class_frequency",
    "jsonld_products", "api_products", "merge_products", "site_profile", "json_report", "markdown_report",
    "clean_page_text", "detect_language", "apply_dictionary", "frontier_round", "bfs_depth", "pagination_chain",
    "sitemap_urls", "stream_contacts", "stream_page_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    settings = {
        **SETTINGS, "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),  # the master is local
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("sum(length(html))").collect()  # start the executors
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
