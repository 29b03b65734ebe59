"""One derived frame, several results: recomputed, cached, or in a single pass."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import broadcast_join

BUCKET_WIDTH = 100


def enrich_orders(
    orders: DataFrame, customers: DataFrame, limit: int | None = None, with_hash: bool = True
) -> DataFrame:
    """Orders with their customer, an upper-case name, a hash and an amount bucket.

    ``limit`` keeps the first orders by id; what follows runs in many partitions again.
    The hash is a number, as long texts of random letters are slow to cache.
    """
    if limit is not None:
        orders = first_rows(orders, limit, "order_id")
    joined = broadcast_join(orders, customers, "customer_id")
    enriched = joined.withColumn("name_upper", F.upper("customer_name")).withColumn(
        "amount_bucket", (F.col("order_amount") / BUCKET_WIDTH).cast("int")
    )
    if with_hash:
        key = F.concat_ws("-", "name_upper", F.col("order_id").cast("string"))
        enriched = enriched.withColumn("name_hash", F.xxhash64(key))
    return enriched


def first_rows(df: DataFrame, n: int, by: str) -> DataFrame:
    """The first ``n`` rows by ``by``, and all rows that tie with the last of them.

    Only the value of ``by`` at rank ``n`` passes through one task; the rows are filtered
    where they are, so that the work after it stays in many tasks.
    """
    last = df.select(by).orderBy(by).limit(n).agg(F.max(by))
    return df.where(F.col(by) <= last.scalar())


@contextmanager
def shared(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Persist a frame for the length of a ``with`` block.

    Actions have to run inside the block.  Keep the frame narrow: what is cached
    costs time to encode.
    """
    held = df.persist(level)
    try:
        yield held
    finally:
        held.unpersist()


def by_region(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("region").agg(F.sum(_money()).alias("total"))


def by_bucket(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("amount_bucket").agg(F.count(F.lit(1)).alias("orders"))


def by_signup(enriched: DataFrame) -> DataFrame:
    average = F.sum(_money()).cast("double") / F.count("order_amount")
    return enriched.groupBy("signup_region").agg(average.alias("avg_amount"))


def _money() -> Column:
    return F.col("order_amount").cast("decimal(18,2)")


_KEYS = {"region": "region", "bucket": "amount_bucket", "signup": "signup_region"}
_USED = ["region", "amount_bucket", "signup_region", "order_amount"]


def _three_results(enriched: DataFrame) -> DataFrame:
    """The three results in one table, told apart by ``dim``."""
    parts = [
        _as_rows("region", by_region(enriched), "total"),
        _as_rows("bucket", by_bucket(enriched), "orders"),
        _as_rows("signup", by_signup(enriched), "avg_amount"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _as_rows(dim: str, result: DataFrame, value: str) -> DataFrame:
    return result.select(
        F.lit(dim).alias("dim"),
        F.col(_KEYS[dim]).cast("string").alias("dim_key"),
        F.col(value).cast("double").alias("value"),
    )


def reuse_uncached(enriched: DataFrame) -> DataFrame:
    """The three results, each from its own pass over the source."""
    return _three_results(enriched.select(*_USED))


def reuse_cached(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The three results from one cached pass, and the cached frame.

    Nothing runs yet: the first action on the results fills the cache.  The caller calls
    ``unpersist()`` on the frame when the results are done with.  Where the results are all that
    is wanted, ``reuse_grouping_sets`` needs no cache.
    """
    frame = enriched.select(*_USED).persist(StorageLevel.MEMORY_AND_DISK)
    return _three_results(frame), frame


def reuse_grouping_sets(enriched: DataFrame) -> DataFrame:
    """The three results from a single pass, with nothing cached."""
    keys = list(_KEYS.values())
    amounts = F.sum(_money()).cast("double")
    counts = F.count(F.lit(1))
    grouped = (
        enriched.select(*_USED)
        .groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
        .agg(
            F.grouping_id(*keys).alias("_set"),
            amounts.alias("_total"),
            counts.alias("_orders"),
            (amounts / F.count("order_amount")).alias("_avg"),
        )
    )
    # grouping_id has a bit set for each key left out, first key highest.
    by_set = {"region": (0b011, "_total"), "bucket": (0b101, "_orders"), "signup": (0b110, "_avg")}
    dim, key, value = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (bits, column) in by_set.items():
        here = F.col("_set") == bits
        dim = F.when(here, name).otherwise(dim)
        key = F.when(here, F.col(_KEYS[name]).cast("string")).otherwise(key)
        value = F.when(here, F.col(column).cast("double")).otherwise(value)
    return grouped.select(dim.alias("dim"), key.alias("dim_key"), value.alias("value"))
