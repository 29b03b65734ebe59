"""Queries that use the fixes: joins, layout, reuse, and the table generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import joins, layout, reuse
from plumbline.settle import settled, shared_folder
from plumbline.sources import generate
from plumbline.sources.telemetry import table

_CENTS = "decimal(18,2)"


# --- generators, fed with the ids of the given tables --------------------------------


def _ids(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return table(spark, sf, name).select(F.col(key).alias("id"))


def _rows(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, name).count()


def gen_skewed_orders(spark, sf):
    """Orders of which one customer owns 35 percent."""
    hot = _rows(spark, sf, "orders") * 35 // 100
    customers = _rows(spark, sf, "customer")
    return generate.skewed_orders(_ids(spark, sf, "orders", "o_orderkey"), hot, customers).select(
        "order_id", "customer_id", "order_amount", F.col("order_ts").cast("timestamp_ntz").alias("order_ts"), "region"
    )


def gen_customers(spark, sf):
    """A customer dimension."""
    return generate.customers(_ids(spark, sf, "customer", "c_custkey"))


def gen_orders_join_fact(spark, sf):
    """The order side of a skewed join: 3 of 23 orders belong to the hot customer."""
    hot = _rows(spark, sf, "orders") * 3 // 23
    return generate.orders_join_fact(_ids(spark, sf, "orders", "o_orderkey"), hot)


def gen_events_join_fact(spark, sf):
    """The event side: 1 of 6 events belongs to the hot customer."""
    hot = _rows(spark, sf, "events") // 6
    return generate.events_join_fact(_ids(spark, sf, "events", "event_id"), hot)


def row_range(spark, sf):
    """Ids of a row range as long as the orders, and whether an order has the id."""
    ids = generate.row_ids(spark, _rows(spark, sf, "orders"))
    ordered = _ids(spark, sf, "orders", "o_orderkey").distinct().withColumn("ordered", F.lit(True))
    return ids.join(ordered, "id", "left").select("id", F.coalesce("ordered", F.lit(False)).alias("ordered"))


# --- joins ------------------------------------------------------------------------------


def _hot_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders and events of which customer 1 owns 35 and 17 percent."""
    hot_orders = _rows(spark, sf, "orders") * 35 // 100
    hot_events = _rows(spark, sf, "events") * 17 // 100

    def customer(key: str, hot: int, owner: str):
        return F.when(F.col(key) < hot, 1).otherwise(F.col(owner) + 2).cast("bigint")

    orders = table(spark, sf, "orders").select(
        customer("o_orderkey", hot_orders, "o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").cast(_CENTS).alias("order_amount"),
    )
    events = table(spark, sf, "events").select(
        customer("event_id", hot_events, "user_id").alias("customer_id"), "event_id", "event_type"
    )
    return orders, events


def _as_totals(joined: DataFrame) -> DataFrame:
    return joined.select(
        "customer_id",
        F.col("matched_pairs").cast("bigint").alias("matched_pairs"),
        F.col("total_amount").cast("double").alias("total_amount"),
    )


def shuffle_join_hot_key(spark, sf):
    """Pairs and amounts per customer, through a sort-merge join."""
    orders, events = _hot_facts(spark, sf)
    return _as_totals(joins.pair_totals(orders, events, "customer_id", "order_amount"))


def _rows_per_salt(spark: SparkSession, sf: str) -> int:
    """A twentieth of the orders: what one partition may hold of a customer here."""
    return max(_rows(spark, sf, "orders") // 20, 1)


def salted_join_hot_key(spark, sf):
    """The same through a salted join of order rows."""
    orders, events = _hot_facts(spark, sf)
    totals = joins.salted_pair_totals(
        orders, events, "customer_id", "order_amount", _rows_per_salt(spark, sf), ["order_id"]
    )
    return _as_totals(totals)


def salted_join_rows(spark, sf):
    """Order rows with the event count of their customer; only hot customers are salted."""
    orders, events = _hot_facts(spark, sf)
    per_customer = events.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_events"))
    hot = joins.hot_keys(orders, "customer_id", _rows_per_salt(spark, sf))
    joined = joins.salted_join(
        orders, per_customer, "customer_id", how="left", salt_by=["order_id"], hot=hot
    )
    return joined.select("order_id", "customer_id", "n_events")


def salted_join_grid(spark, sf):
    """Order rows with the counts of their customer's events by type, both sides salted.

    A customer has one row per type on the right, so no order meets more than a few.
    """
    orders, events = _hot_facts(spark, sf)
    by_type = events.groupBy("customer_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    hot = joins.hot_keys(orders, "customer_id", _rows_per_salt(spark, sf)).withColumn(
        "right_salts", F.lit(2)
    )
    joined = joins.salted_join(
        orders, by_type, "customer_id", salt_by=["order_id"], right_salt_by=["event_type"], hot=hot
    )
    return joined.select("order_id", "customer_id", "event_type", "n_events")


def skew_aware_join(spark, sf):
    """Orders and event counts with the choice of join left to the row counts."""
    orders, events = _hot_facts(spark, sf)
    per_customer = events.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_events"))
    joined = joins.skew_aware_join(
        orders, per_customer, "customer_id", "left", ["order_id"], _rows_per_salt(spark, sf)
    )
    return joined.select("order_id", "customer_id", "n_events")


def _fact_and_dimension(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("order_amount"),
        F.col("o_orderpriority").alias("region"),
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_nationkey").alias("signup_region"),
    )
    return orders, customers


def _per_signup_region(joined: DataFrame) -> DataFrame:
    total = F.sum(F.col("order_amount").cast(_CENTS)).cast("double")
    return joined.groupBy("signup_region").agg(total.alias("total"))


def dim_join_shuffle(spark, sf):
    """Amounts per region of the customer, both sides shuffled."""
    orders, customers = _fact_and_dimension(spark, sf)
    keyed = customers.select("customer_id", "signup_region")
    return _per_signup_region(joins.shuffle_join(orders, keyed, "customer_id"))


def dim_join_broadcast(spark, sf):
    """The same with the customers broadcast, if they are small enough."""
    orders, customers = _fact_and_dimension(spark, sf)
    keyed = customers.select("customer_id", "signup_region")
    return _per_signup_region(joins.broadcast_join(orders, keyed, "customer_id"))


def key_skew_profile(spark, sf):
    """How unevenly the orders fall on customers."""
    return joins.key_skew_profile(table(spark, sf, "orders"), "o_custkey")


def key_skew_profile_hot(spark, sf):
    """The same for the orders with a hot customer."""
    return joins.key_skew_profile(_hot_facts(spark, sf)[0], "customer_id")


def hot_keys(spark, sf):
    """Customers with more orders than a twentieth of them all, and the salts they call for."""
    return joins.hot_keys(_hot_facts(spark, sf)[0], "customer_id", _rows_per_salt(spark, sf))


# --- layout -------------------------------------------------------------------------------


def _per_priority(orders: DataFrame) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast(_CENTS)).cast("double")
    return orders.groupBy(F.col("o_orderpriority").alias("region")).agg(total.alias("region_total"))


def small_files_region_total(spark, sf):
    """Amounts per region from files read as they are."""
    return _per_priority(table(spark, sf, "orders"))


def small_files_compacted(spark, sf):
    """The same from a read whose partitions follow the file sizes."""
    return _per_priority(layout.compact_scan(spark, f"{sf}/orders.parquet"))


def _read_back(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows, amounts and files per value of ``key`` of a table of orders just written."""
    # Rows of a value and file combine before the files are counted.
    per_file = layout.files_of(spark.read.parquet(path)).groupBy(key, "file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast(_CENTS)).alias("amount")
    )
    return per_file.groupBy(key).agg(
        F.sum("n").alias("orders"),
        F.sum("amount").cast("double").alias("total"),
        F.count(F.lit(1)).alias("files"),
    )


def rebalanced_write(spark, sf):
    """Orders written below a folder per status in files that follow the bytes, and read back."""
    path = shared_folder(spark, "rebalanced")
    layout.write_rebalanced(table(spark, sf, "orders"), path, ["o_orderstatus"])
    return _read_back(spark, path, "o_orderstatus")


def small_files_write(spark, sf):
    """Orders written as many small files, and read back: rows, amounts and how many files there are."""
    path = shared_folder(spark, "small-files")
    layout.write_compacted(table(spark, sf, "orders"), path, generate.SMALL_FILES)
    back = layout.files_of(spark.read.parquet(path))
    files = back.select("file").distinct().count()
    per = back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast(_CENTS)).cast("double").alias("total")
    )
    return per.withColumn("files", F.lit(files).cast("bigint"))


# --- reuse --------------------------------------------------------------------------------


def _enriched(spark: SparkSession, sf: str, with_hash: bool = False) -> DataFrame:
    orders, customers = _fact_and_dimension(spark, sf)
    return reuse.enrich_orders(orders, customers, with_hash=with_hash)


def enrich_orders(spark, sf):
    """Orders with customer columns and a bucket."""
    return _enriched(spark, sf)


def enrich_orders_limited(spark, sf):
    """The first thousand orders by id, enriched."""
    orders, customers = _fact_and_dimension(spark, sf)
    return reuse.enrich_orders(orders, customers, limit=1_000, with_hash=False)


def enriched_hashes(spark, sf):
    """Per region, how many distinct hashes its orders have: as many as it has orders."""
    hashed = _enriched(spark, sf, with_hash=True)
    return hashed.groupBy("region").agg(F.countDistinct("name_hash").alias("hashes"))


def reuse_by_region(spark, sf):
    result = reuse.by_region(_enriched(spark, sf))
    return result.select("region", F.col("total").cast("double").alias("total"))


def reuse_by_bucket(spark, sf):
    return reuse.by_bucket(_enriched(spark, sf))


def reuse_by_signup(spark, sf):
    return reuse.by_signup(_enriched(spark, sf))


def reuse_uncached(spark, sf):
    """Three results, three passes."""
    return reuse.reuse_uncached(_enriched(spark, sf))


def reuse_cached(spark, sf):
    """Three results from one cached frame, which is released once they are there."""
    results, frame = reuse.reuse_cached(_enriched(spark, sf))
    try:
        return settled(results)
    finally:
        frame.unpersist()


def reuse_grouping_sets(spark, sf):
    """Three results in one pass."""
    return reuse.reuse_grouping_sets(_enriched(spark, sf))
