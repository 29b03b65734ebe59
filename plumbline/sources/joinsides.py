"""How large the inputs of sort-merge joins were, from the metrics in event logs.

The tree of a plan names the accumulators of its nodes.  The exchange below each side of a join
has one for the bytes it wrote, and every task reports what it added to it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of a node and of a metric as they stand in plan trees.
JOIN_NODE = "SortMergeJoin"
SIZE_METRIC = "data size"

_SIDES = "run_key string, execution_id bigint, left_id bigint, right_id bigint"


def join_side_bytes(events: DataFrame) -> DataFrame:
    """``run_key, execution_id, small_side_bytes``: bytes shuffled for the smaller side of a join.

    Of several sort-merge joins in an execution the one with the smallest side counts, as it is
    the first to broadcast.  Joins with a side that is not an exchange of its own (sorted by a join
    below, say) or that no task wrote for are left out, and so are executions without
    any other.  Failed tasks do not count; tasks that ran again after a lost executor do, so
    sizes are upper bounds.  Repeated events of one plan count once.
    """
    told = events.where(F.col("kind").isin("sql_start", "sql_update") & F.col("join_plan").isNotNull())
    # Plans are read where they are; only numbers go on.
    sides = (
        told.where(F.col("execution_id").isNotNull())
        .select("run_key", "execution_id", "join_plan")
        .mapInArrow(_sides_in, _SIDES)
        .distinct()
    )
    written = (
        events.where((F.col("kind") == "task_end") & ~F.col("failed"))
        .select("run_key", F.inline("exchange_bytes"))
        .where("bytes IS NOT NULL")
        .groupBy("run_key", "accumulator_id")
        .agg(F.sum("bytes").alias("bytes"))
    )
    # A self-join that reuses its exchange has the same accumulator on both sides.
    each = sides.withColumn("accumulator_id", F.explode(F.array("left_id", "right_id")))
    joins = (
        each.join(written, ["run_key", "accumulator_id"])
        .groupBy("run_key", "execution_id", "left_id", "right_id")
        .agg(F.count(F.lit(1)).alias("_known"), F.min("bytes").alias("_small"))
        .where("_known = 2")
    )
    return joins.groupBy("run_key", "execution_id").agg(F.min("_small").alias("small_side_bytes"))


def with_join_sides(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Signals with ``small_side_bytes``, null where it is not known."""
    return signals.join(join_side_bytes(events), ["run_key", "execution_id"], "left")


def _sides_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("run_key", "execution_id", "join_plan"))
        for run_key, execution, text in zip(*columns):
            rows += [(run_key, execution, *pair) for pair in sides_of(text)]
        found = list(zip(*rows)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(values, kind) for values, kind in zip(found, types)]
        yield pa.RecordBatch.from_arrays(arrays, ["run_key", "execution_id", "left_id", "right_id"])


def sides_of(plan: str) -> list[tuple[int, int]]:
    """Accumulators of both sides of each sort-merge join in a plan tree; none for what is no tree."""
    try:
        waiting = [json.loads(plan)]
    except ValueError:
        return []
    pairs = []
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            continue
        below = node.get("children") or []
        waiting += below
        if str(node.get("nodeName")).startswith(JOIN_NODE) and len(below) == 2:
            left, right = (_exchange_below(side) for side in below)
            if left is not None and right is not None:
                pairs.append((left, right))
    return pairs


def _exchange_below(node: dict) -> int | None:
    """The size accumulator of the first exchange on the way down, while there is but one way."""
    while isinstance(node, dict):
        for metric in node.get("metrics") or []:
            if metric.get("name") == SIZE_METRIC:
                return metric.get("accumulatorId")
        below = node.get("children") or []
        node = below[0] if len(below) == 1 else None
    return None
