"""Files of a dataset as rows, without reading their content."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_BYTES = 128 * 1024**2


def file_listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length`` of every file below ``path``, one row each."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )


def twin_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one, to be changed on its own."""
    twin = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if twin.conf.isModifiable(name):
            twin.conf.set(name, value)
    return twin


def partitions_for(
    listing: DataFrame, bytes_per_partition: int = PARTITION_BYTES, at_least: int = 1
) -> int:
    """How many partitions of the given size the listed files fill."""
    total = listing.agg(F.sum("length")).first()[0] or 0
    return max(at_least, math.ceil(total / bytes_per_partition), 1)
