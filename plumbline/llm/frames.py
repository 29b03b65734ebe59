"""Small helpers all operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import broadcast_join, measured_bytes
from plumbline.settle import ensure_checkpoint_dir

# White space of every contract here: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
BROADCAST_BYTES = 48 * 1024**2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df`` dealt by ``keys`` once and kept so: joins on just these keys move the other side only.

    The table is known to the catalog for as long as it takes to read it back; its files stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"plumbline_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet")
    dealt.option("path", shared_folder(spark, what)).saveAsTable(table_name)
    found = spark.table(table_name)
    found.schema  # looked up before the name goes
    spark.sql(f"DROP TABLE {table_name}")
    return found


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain names ``c0, c1, ...``: functions over batches take no names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def number_of(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives to a column."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    return f"c{found[0]}"


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a table that is often small: broadcast after measuring, shuffle beyond the limit.

    ``small`` should be a written table, as it is read once to be measured.
    """
    return broadcast_join(big, small, on, how, BROADCAST_BYTES, measured_bytes(small))
