"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS choose the data and the cores,
BENCH_ONLY a comma-separated choice of queries. Every
query is run once to warm up and once for the clock; all rows are fetched.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import QUERIES, table  # noqa: E402
from checks import catalog_queries, expr_queries, profile_queries, view_queries  # noqa: E402,F401
from tabscout.plans.catalog import select_views  # noqa: E402
from tabscout.plans.pipeline import analyze_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "missing_rates", "distinct_counts", "value_counts", "numeric_summary", "duplicate_rows",
    "sequence_test", "date_range", "largest_groups_of_lineitem",
    "outcome_rate_by_segment_of_lineitem", "metric_by_segment", "quantile_ranges",
    "outcome_rate_by_range_of_lineitem", "pair_correlations", "relationship_by_range",
    "distribution_of_lineitem", "histogram", "rows_over_time", "metric_over_time", "fixed_sample",
    "geo_points_sampled", "select_views", "select_by_ids", "near_same_turns", "json_from_text",
]


def profile_lineitem(spark: SparkSession, sf_dir: str):
    from tabscout.operators.profile import profile_columns
    return profile_columns(table(spark, sf_dir, "lineitem"), "lineitem")


def catalog_of_lineitem(spark: SparkSession, sf_dir: str):
    lineitem = table(spark, sf_dir, "lineitem")
    return select_views(analyze_table(lineitem, "lineitem", ["l_orderkey", "l_linenumber"]).catalog)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE}
    queries["profile_lineitem"] = profile_lineitem
    queries["catalog_of_lineitem"] = catalog_of_lineitem
    if only := os.environ.get("BENCH_ONLY"):
        queries = {name: queries[name] for name in only.split(",")}
    seconds = {}
    for name, run in queries.items():
        for _ in range(2):
            start = time.perf_counter()
            run(spark, SF_DIR).collect()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
