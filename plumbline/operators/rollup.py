"""Task records rolled up to stages and to whole applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.median import exact_median
from plumbline.operators.joins import BROADCAST_BYTES, broadcast_join, measured_bytes
from plumbline.settle import settled

STAGE_KEY = ["run_key", "stage_id"]


def stage_rollup(
    tasks: DataFrame,
    stage_events: DataFrame | None = None,
    exclude_failed: bool = False,
    duration_skew: bool = True,
) -> DataFrame:
    """One row per stage that shows up in tasks or in stage events.

    All attempts of a stage count together and failed tasks count like any other
    unless ``exclude_failed``.  Without ``duration_skew`` the task-duration ratio
    is left null and its pass over the tasks is saved.
    """
    if exclude_failed:
        tasks = tasks.where(~F.col("failed"))

    ratios = {"shuffle_read_skew_ratio": "shuffle_read_bytes"}
    if duration_skew:
        ratios["task_duration_skew_ratio"] = "executor_run_time_ms"

    serde = F.col("executor_deserialize_time_ms") + F.col("result_serialization_time_ms")
    sums = tasks.groupBy(*STAGE_KEY).agg(
        F.count(F.lit(1)).alias("num_tasks"),
        F.sum("shuffle_read_bytes").alias("total_shuffle_read_bytes"),
        F.sum("shuffle_write_bytes").alias("total_shuffle_write_bytes"),
        F.sum("input_bytes").alias("total_input_bytes"),
        F.sum("memory_bytes_spilled").alias("total_memory_spilled"),
        F.sum("disk_bytes_spilled").alias("total_disk_spilled"),
        F.sum("gc_time_ms").alias("total_gc_time_ms"),
        F.sum("executor_run_time_ms").alias("total_executor_run_time_ms"),
        F.max("executor_run_time_ms").alias("max_task_run_time_ms"),
        F.sum(serde).alias("serde_time_ms"),
        *_extents(ratios),
    )

    # Every frame joined below has one row per stage and is already partitioned by
    # the stage key from its aggregation, so the joins add no shuffle.
    stages = sums.join(_medians(tasks, STAGE_KEY, ratios), STAGE_KEY, "left")
    for out in ("shuffle_read_skew_ratio", "task_duration_skew_ratio"):
        ratio = _ratio(out) if out in ratios else F.lit(None).cast("double")
        stages = stages.withColumn(out, ratio)

    if stage_events is None:
        stages = stages.select(
            "*",
            F.lit("").alias("name"),
            F.lit(None).cast("bigint").alias("submission_time_ms"),
            F.lit(None).cast("bigint").alias("completion_time_ms"),
        )
    else:
        stages = stages.join(stage_times(stage_events), STAGE_KEY, "full").fillna({"name": ""})

    counted = [c for c in stages.columns if c.startswith("total_")]
    counted += ["num_tasks", "max_task_run_time_ms", "serde_time_ms"]
    return (
        stages.fillna(0, counted)
        .withColumn("duration_ms", F.col("completion_time_ms") - F.col("submission_time_ms"))
        .select(*schemas.STAGES.names)
    )


def stage_times(stage_events: DataFrame) -> DataFrame:
    """Name and times per stage; the times of the last attempt win.

    A submission event's own time goes before the one repeated at completion.
    """
    submitted = F.max(F.when(~F.col("completed"), F.col("submission_time_ms")))
    repeated = F.max(F.when(F.col("completed"), F.col("submission_time_ms")))
    return stage_events.groupBy(*STAGE_KEY).agg(
        F.max("stage_name").alias("name"),
        F.coalesce(submitted, repeated).alias("submission_time_ms"),
        F.max(F.when(F.col("completed"), F.col("completion_time_ms"))).alias("completion_time_ms"),
    )


def stage_shuffle_skew(tasks: DataFrame) -> DataFrame:
    """Largest over median shuffle read, among the tasks that read any."""
    return max_over_median(tasks, STAGE_KEY, "shuffle_read_bytes", "shuffle_read_skew_ratio")


def stage_duration_skew(tasks: DataFrame) -> DataFrame:
    """Largest over median run time, among the tasks that ran at all."""
    return max_over_median(tasks, STAGE_KEY, "executor_run_time_ms", "task_duration_skew_ratio")


def max_over_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``keys, out``: skew ratio of the positive values, null for fewer than two."""
    positive = df.where(F.col(value) > 0)
    found = exact_median(positive, keys, value, f"_mid_{out}", count=f"_n_{out}", largest=f"_max_{out}")
    return found.select(*keys, _ratio(out).alias(out))


# A skew ratio has three parts: how many values are positive and the largest, from
# an aggregation, and the median of the positive ones.


def _extents(ratios: dict[str, str]) -> list[Column]:
    parts = []
    for out, value in ratios.items():
        parts.append(F.count_if(F.col(value) > 0).alias(f"_n_{out}"))
        parts.append(F.max(value).alias(f"_max_{out}"))
    return parts


def _medians(df: DataFrame, keys: list[str], ratios: dict[str, str]) -> DataFrame:
    """Medians of the positive values of several columns, from one pass."""
    values = F.array(
        *[
            F.struct(F.lit(number).alias("_of"), F.col(value).alias("_value"))
            for number, value in enumerate(ratios.values())
        ]
    )
    stacked = df.select(*keys, F.inline(values)).where(F.col("_value") > 0)
    found = exact_median(stacked, [*keys, "_of"], "_value", "_median", together=keys)
    return found.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_of") == number, F.col("_median"))).alias(f"_mid_{out}")
            for number, out in enumerate(ratios)
        ]
    )


def _ratio(out: str) -> Column:
    return F.when(F.col(f"_n_{out}") >= 2, F.col(f"_max_{out}") / F.col(f"_mid_{out}"))


def app_rollup(stages: DataFrame) -> DataFrame:
    """Totals per application.

    The total duration adds up the stages, which may overlap, and an unfinished
    stage adds nothing.
    """

    def total(name: str) -> Column:
        return F.sum(name).alias(name)

    return stages.groupBy("run_key").agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.sum("num_tasks").alias("total_tasks"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"),
        total("total_shuffle_read_bytes"),
        total("total_shuffle_write_bytes"),
        total("total_input_bytes"),
        total("total_memory_spilled"),
        total("total_disk_spilled"),
        total("total_gc_time_ms"),
        total("total_executor_run_time_ms"),
        F.max("max_task_run_time_ms").alias("max_task_run_time_ms"),
        F.max("shuffle_read_skew_ratio").alias("worst_skew_ratio"),
    )


def app_metrics(apps: DataFrame, stages: DataFrame) -> DataFrame:
    """``app_rollup`` beside the run's name; runs without stages show zeros."""
    rolled = app_rollup(stages)
    counted = [c for c in rolled.columns if c not in ("run_key", "worst_skew_ratio")]
    return (
        apps.select("run_key", "app_id", "app_name", "start_ms")
        .join(rolled, "run_key", "left")
        .fillna(0, counted)
    )


PLAN_SEPARATOR = "\n---\n"


def combined_plans(executions: DataFrame, per_part: int = 64, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All plan texts of a run, joined in start order: ``run_key, part, plans``.

    Execution ids count up as executions start, so ranges of ids cut a run into
    parts of at most ``per_part`` plans; the parts in order, joined by the same
    separator, are the whole text.  No run is gathered in one place.

    Jobs that run on schedule have the same plans again and again.  Each distinct text is kept once, in
    a dictionary by content hash that is written and measured; executions are dealt out with hashes
    alone.  Up to ``max_bytes`` the dictionary is broadcast to the parts, which then take no further
    shuffle, and beyond that it is joined by hash.
    """
    hashed = executions.select(
        "run_key",
        F.expr(f"execution_id div {int(per_part)}").alias("part"),
        "execution_id",
        "physical_plan",
        F.sha2("physical_plan", 256).alias("plan_hash"),
    )
    dictionary = settled(
        hashed.where("plan_hash IS NOT NULL").groupBy("plan_hash").agg(F.any_value("physical_plan").alias("physical_plan"))
    )
    dealt = (
        hashed.groupBy("run_key", "part")
        .agg(F.collect_list(F.struct("execution_id", "plan_hash")).alias("plans"))
        .select("run_key", "part", F.inline("plans"))
    )
    told = broadcast_join(dealt, dictionary, "plan_hash", "left", max_bytes, measured_bytes(dictionary))
    in_order = F.array_sort(F.collect_list(F.struct("execution_id", "physical_plan")))
    texts = F.transform(in_order, lambda row: row["physical_plan"])
    return told.groupBy("run_key", "part").agg(F.array_join(texts, PLAN_SEPARATOR).alias("plans"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """The head figures of each run."""
    return metrics.select(
        "run_key",
        "n_stages",
        "total_tasks",
        "total_shuffle_read_bytes",
        "total_shuffle_write_bytes",
        (F.col("total_memory_spilled") + F.col("total_disk_spilled")).alias("total_spill_bytes"),
    )
