"""Results that are computed once and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder.

    For a frame that several results start from: without it each of them would
    roll up the tasks anew.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Only a local session without one gets a temporary folder of its own: on a
    cluster a machine's folder would be lost with the machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder, for tables that are written to be read again."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
