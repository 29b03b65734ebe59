"""Test tables with a built-in fault: a hot key, or far too many files.

Each generator turns a frame of row ids into columns.  Values come from
``mixed_bucket`` and so are the same in every run and for every task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import mixed_bucket

HOT_CUSTOMER = 1
FIRST_COLD_CUSTOMER = 2

# Default sizes of the generated tables.
ORDER_ROWS = 5_000_000
CUSTOMERS = 200_000
HOT_SHARE = 0.35
SMALL_FILE_ROWS = 300_000
SMALL_FILE_CUSTOMERS = 20_000
SMALL_FILES = 300
JOIN_HOT_ORDERS, JOIN_COLD_ORDERS = 3_000, 20_000
JOIN_HOT_EVENTS, JOIN_COLD_EVENTS = 1_000, 5_000
JOIN_COLD_CUSTOMERS = 2_000
REGIONS = 5
EVENT_TYPES = 4


def row_ids(spark: SparkSession, rows: int) -> DataFrame:
    """Ids ``0 .. rows-1`` in a column ``id``."""
    return spark.range(rows)


def _customer(hot_rows: int, customers: int, seed: int) -> Column:
    """The hot customer for the first ids, an even spread over the others after."""
    cold = mixed_bucket(F.col("id"), seed, customers) + F.lit(FIRST_COLD_CUSTOMER)
    return F.when(F.col("id") < hot_rows, F.lit(HOT_CUSTOMER)).otherwise(cold).cast("bigint")


def _amount(seed: int) -> Column:
    """An amount from 0 to 1000 in whole cents."""
    return F.round(mixed_bucket(F.col("id"), seed, 100_000) / 100, 2)


def skewed_orders(
    ids: DataFrame,
    hot_rows: int,
    customers: int = CUSTOMERS,
    base_ts: str = "2024-01-01 00:00:00",
) -> DataFrame:
    """Orders of which the hot customer owns the first ``hot_rows``."""
    return ids.select(
        F.col("id").alias("order_id"),
        _customer(hot_rows, customers - 2, seed=42).alias("customer_id"),
        _amount(seed=7).alias("order_amount"),
        F.lit(base_ts).cast("timestamp").alias("order_ts"),
        mixed_bucket(F.col("id"), 3, REGIONS).cast("int").alias("region"),
    )


def customers(ids: DataFrame) -> DataFrame:
    """A customer dimension, one row per id."""
    return ids.select(
        F.col("id").alias("customer_id"),
        F.concat(F.lit("customer_"), F.col("id").cast("string")).alias("customer_name"),
        mixed_bucket(F.col("id"), 11, REGIONS).cast("int").alias("signup_region"),
    )


def orders_join_fact(
    ids: DataFrame, hot_rows: int = JOIN_HOT_ORDERS, cold_customers: int = JOIN_COLD_CUSTOMERS
) -> DataFrame:
    """The order side of a join that is skewed on both sides."""
    return ids.select(
        F.col("id").alias("order_id"),
        _customer(hot_rows, cold_customers, seed=21).alias("customer_id"),
        _amount(seed=22).alias("order_amount"),
    )


def events_join_fact(
    ids: DataFrame, hot_rows: int = JOIN_HOT_EVENTS, cold_customers: int = JOIN_COLD_CUSTOMERS
) -> DataFrame:
    """The event side of the same join."""
    return ids.select(
        F.col("id").alias("event_id"),
        _customer(hot_rows, cold_customers, seed=23).alias("customer_id"),
        mixed_bucket(F.col("id"), 24, EVENT_TYPES).cast("int").alias("event_type"),
    )


def generate_skewed_orders(
    spark: SparkSession,
    rows: int = ORDER_ROWS,
    customer_count: int = CUSTOMERS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    return skewed_orders(row_ids(spark, rows), int(rows * hot_share), customer_count)


def generate_customers(spark: SparkSession, rows: int = CUSTOMERS) -> DataFrame:
    return customers(row_ids(spark, rows))


def generate_join_facts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    orders = orders_join_fact(row_ids(spark, JOIN_HOT_ORDERS + JOIN_COLD_ORDERS))
    events = events_join_fact(row_ids(spark, JOIN_HOT_EVENTS + JOIN_COLD_EVENTS))
    return orders, events


def write_tables(spark: SparkSession, out: str, scale: float = 1.0) -> dict[str, str]:
    """Write all generated tables below ``out`` and return their paths.

    ``scale`` shrinks or grows row counts; file counts stay, since the many small
    files are the point of one of the tables.
    """
    from plumbline.operators.layout import write_compacted

    def rows(count: int) -> int:
        return max(int(count * scale), 1)

    join_orders, join_events = generate_join_facts(spark)
    tables = {
        "orders": (generate_skewed_orders(spark, rows(ORDER_ROWS), rows(CUSTOMERS)), 64),
        "orders_small_files": (
            generate_skewed_orders(spark, rows(SMALL_FILE_ROWS), rows(SMALL_FILE_CUSTOMERS)),
            SMALL_FILES,
        ),
        "customers": (generate_customers(spark, rows(CUSTOMERS)), 8),
        "orders_join_fact": (join_orders, 8),
        "events_join_fact": (join_events, 8),
    }
    paths = {}
    for name, (table, files) in tables.items():
        paths[name] = f"{out.rstrip('/')}/{name}.parquet"
        write_compacted(table, paths[name], files)
    return paths
