"""Jobs that leave event logs: each fault as a baseline, and its fix as tuned.

    python tests/jobs.py <job> <baseline|tuned> <tables> <log folder> [plain|rolling]

The baselines are slow on purpose and need the settings that bring the fault out;
this belongs to tests and to ``measure_pairs.py``, not to the library.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline.operators import joins, layout, reuse  # noqa: E402
from plumbline.sources import generate  # noqa: E402

PAIRS = [
    ("Skewed join", "skewed_join_baseline", "skewed_join_tuned"),
    ("Small files", "small_files_baseline", "small_files_tuned"),
    ("Missing broadcast", "missing_broadcast_baseline", "missing_broadcast_tuned"),
    ("Missing cache", "missing_cache_baseline", "missing_cache_tuned"),
]

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}

# Settings per job: shuffle partitions, then what both modes and the baseline need.
SETTINGS = {
    "skewed_join": (100, {"spark.sql.adaptive.enabled": "false", **NO_BROADCAST}, {}),
    "small_files": (64, {}, {"spark.sql.files.maxPartitionBytes": "5242880"}),
    "missing_broadcast": (200, {}, NO_BROADCAST),
    "missing_cache": (64, {}, {}),
}


def skewed_join(spark, tables, tuned):
    orders = spark.read.parquet(f"{tables}/orders_join_fact.parquet")
    events = spark.read.parquet(f"{tables}/events_join_fact.parquet")
    if tuned:
        joined = joins.salted_join(orders, events, "customer_id", salt_by=["order_id"])
    else:
        joined = joins.shuffle_join(orders, events, "customer_id")
    joined.groupBy("customer_id").agg(F.count(F.lit(1)), F.sum("order_amount")).collect()


def small_files(spark, tables, tuned):
    path = f"{tables}/orders_small_files.parquet"
    orders = layout.compact_scan(spark, path) if tuned else spark.read.parquet(path)
    orders.groupBy("region").agg(F.sum("order_amount")).collect()


def missing_broadcast(spark, tables, tuned):
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    customers = spark.read.parquet(f"{tables}/customers.parquet")
    if tuned:
        keyed = customers.select("customer_id", "signup_region")
        # Two columns of eight bytes and eight for the row: no need to measure that.
        size = 24 * generate.CUSTOMERS
        joined = joins.broadcast_join(orders, keyed, "customer_id", dim_bytes=size)
    else:
        joined = joins.shuffle_join(orders, customers, "customer_id")
    joined.groupBy("signup_region").agg(F.sum("order_amount")).collect()


def missing_cache(spark, tables, tuned):
    orders = spark.read.parquet(f"{tables}/orders.parquet").limit(300_000)
    customers = spark.read.parquet(f"{tables}/customers.parquet")
    enriched = reuse.enrich_orders(orders, customers)

    def results(frame):
        for result in (reuse.by_region, reuse.by_bucket, reuse.by_signup):
            result(frame).collect()

    if not tuned:
        results(enriched)
        return
    used = enriched.select("region", "amount_bucket", "signup_region", "order_amount")
    with reuse.shared(used) as frame:
        frame.count()
        results(frame)


def main(job, mode, tables, logs, log_layout="rolling"):
    tuned = mode == "tuned"
    partitions, both, baseline = SETTINGS[job]
    rolling = str(log_layout == "rolling").lower()
    builder = (
        SparkSession.builder.appName(f"{job}_{mode}")
        .master("local[4]")
        .config("spark.driver.memory", "2g")
        .config("spark.ui.enabled", "false")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{logs}")
        .config("spark.eventLog.rolling.enabled", rolling)
        .config("spark.eventLog.compress", rolling)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**both, **({} if tuned else baseline)}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    globals()[job](spark, tables, tuned)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
