"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR   tables to read, /root/testdata/sf0.1 by default
BENCH_CPUS     threads of the local session, 8 by default
BENCH_QUERIES  comma-separated names, instead of the headline queries
BENCH_PAIRS    0 to leave out the job pairs on generated tables of full size
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline.operators import joins, layout, reuse  # noqa: E402
from plumbline.plans import queries  # noqa: E402
from plumbline.sources import generate  # noqa: E402

HEADLINE = [
    "evt_task_extract",
    "evt_stage_rollup",
    "evt_type_counts",
    "sql_durations",
    "stage_rollup",
    "stage_shuffle_skew",
    "app_rollup",
    "detect_skew",
    "detect_missing_broadcast",
    "detect_missing_cache",
    "all_findings",
    "recommendations",
    "compare_metrics",
    "compare_suite",
    "single_run_report",
    "shuffle_join_hot_key",
    "salted_join_hot_key",
    "salted_join_rows",
    "dim_join_shuffle",
    "dim_join_broadcast",
    "key_skew_profile",
    "small_files_region_total",
    "small_files_compacted",
    "reuse_uncached",
    "reuse_cached",
    "reuse_grouping_sets",
    "gen_skewed_orders",
    "findings_listing",
    "salted_join_grid",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Seconds from building the query to its last row, with the rows thrown away."""
    start = time.perf_counter()
    queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    spark.catalog.clearCache()
    return took


def run_pairs(spark: SparkSession) -> dict[str, float]:
    """Faults and fixes on 5,000,000 orders, 200,000 customers and 300 small files."""
    paths = generate.write_tables(spark, tempfile.mkdtemp(prefix="run-bench-"))
    table = {name: spark.read.parquet(path) for name, path in paths.items()}
    orders, customers = table["orders"], table["customers"]
    keyed = customers.select("customer_id", "signup_region")
    enriched = reuse.enrich_orders(orders.where("order_id < 300000"), customers)
    held = []

    def cached():
        results, frame = reuse.reuse_cached(enriched)
        held.append(frame)
        return results

    def of_rows(joined):
        """Pairs are formed as rows here, as the fault does."""
        return joined.groupBy("customer_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("order_amount").alias("total"))

    facts = (table["orders_join_fact"], table["events_join_fact"])
    small = paths["orders_small_files"]

    def per(key: str, frame):
        return frame.groupBy(key).agg(F.sum("order_amount").alias("total"))

    pairs = {
        "skewed_join_shuffle": lambda: of_rows(joins.shuffle_join(*facts, "customer_id")),
        "skewed_join_salted": lambda: of_rows(joins.salted_join(*facts, "customer_id", salt_by=["order_id"])),
        "skewed_join_summed_first": lambda: joins.pair_totals(*facts, "customer_id", "order_amount"),
        "dimension_shuffled": lambda: per("signup_region", joins.shuffle_join(orders, keyed, "customer_id")),
        "dimension_broadcast": lambda: per("signup_region", joins.broadcast_join(orders, keyed, "customer_id")),
        "small_files_as_is": lambda: per("region", table["orders_small_files"]),
        "small_files_compacted": lambda: per("region", layout.compact_scan(spark, small)),
        "three_results_recomputed": lambda: reuse.reuse_uncached(enriched),
        "three_results_cached": cached,
        "three_results_one_pass": lambda: reuse.reuse_grouping_sets(enriched),
    }
    times = {}
    for name, build in pairs.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        while held:
            held.pop().unpersist()
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    run(spark, "small_files_region_total", sf_dir)  # start-up is not a query's time
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    pairs = {} if os.environ.get("BENCH_PAIRS") == "0" else run_pairs(spark)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "job_pairs": pairs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
