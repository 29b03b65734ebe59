"""File and partition layout: profile it, read around it, write it right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import DEFAULTS, Thresholds
from plumbline.sources.files import PARTITION_BYTES, file_listing, twin_session


def small_file_profile(
    spark: SparkSession, path: str | list[str], limits: Thresholds = DEFAULTS
) -> DataFrame:
    """File count and sizes below ``path``, and whether the small-file rule is met."""
    average = F.col("total_bytes") / F.nullif(F.col("n_files"), F.lit(0))
    return (
        file_listing(spark, path)
        .where(F.col("path").rlike(r"/[^_./][^/]*$"))
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
            F.coalesce(F.max("length"), F.lit(0)).alias("largest_bytes"),
        )
        .withColumn("avg_bytes", average)
        .withColumn("target_partitions", F.greatest(F.ceil(F.col("total_bytes") / PARTITION_BYTES), F.lit(1)))
        .withColumn(
            "small_files",
            (F.col("n_files") >= limits.small_file_min_tasks)
            & (F.col("total_bytes") > 0)
            & (F.col("avg_bytes") < limits.small_file_bytes),
        )
    )


def compact_scan(
    spark: SparkSession, path: str | list[str], bytes_per_partition: int = PARTITION_BYTES
) -> DataFrame:
    """Read Parquet into partitions of up to the given size, without a shuffle.

    The scan packs files itself: in a session of its own, opening a file counts as little, so
    that small files share a partition.  Nothing is listed or coalesced.
    """
    reader = twin_session(spark)
    reader.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_per_partition))
    reader.conf.set("spark.sql.files.openCostInBytes", str(64 * 1024))
    return reader.read.parquet(*([path] if isinstance(path, str) else path))


def spread(df: DataFrame, partitions: int, *by: str) -> DataFrame:
    """Deal the rows out over ``partitions`` by ``by``, unless the read has as many by itself.

    For work that is heavy per row after a read that cannot be split further, such as one row group.
    """
    return df if df.rdd.getNumPartitions() >= partitions else df.repartition(partitions, *by)


def write_rebalanced(df: DataFrame, path: str, by: list[str] | None = None, bytes_per_file: int = PARTITION_BYTES) -> None:
    """Write ``df`` as Parquet whose files follow the bytes there are, below folders by ``by`` if given.

    Adaptive execution splits and merges the shuffled rows to about ``bytes_per_file`` a task: a value
    of few rows is one file, a value with a third of all rows is many, and no count is chosen by hand.
    Shuffled bytes are packed less than Parquet's, so files come out smaller rather than larger.
    """
    by = by or []
    conf = df.sparkSession.conf
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(bytes_per_file)}
    before = {name: conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def files_of(df: DataFrame) -> DataFrame:
    """``df`` read from files, with the file of each row in a column ``file``."""
    return df.withColumn("file", F.col("_metadata.file_path"))


def write_compacted(df: DataFrame, path: str, files: int) -> None:
    """Write ``df`` as Parquet in the given number of even files."""
    df.repartition(files).write.mode("overwrite").parquet(path)
