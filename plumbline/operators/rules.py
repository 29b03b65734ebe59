"""Threshold rules over stages and SQL executions, giving rows of findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.formatting import fmt_fixed, round_fixed


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules.  The defaults are fixed values."""

    skew_ratio: float = 3.0
    skew_high_ratio: float = 10.0
    skew_min_tasks: int = 8
    small_file_bytes: int = 5 * 1024 * 1024
    small_file_min_tasks: int = 20
    spill_bytes: int = 1
    serde_ratio: float = 0.25
    serde_min_tasks: int = 8
    min_scans: int = 2
    # Joins whose smaller side is known to be above this many bytes are not reported; None reports all.
    broadcast_side_bytes: int | None = None


DEFAULTS = Thresholds()

# The order in which rules report.
SKEW, SMALL_FILES, MISSING_BROADCAST, MISSING_CACHE, SPILL, SERIALIZATION = range(1, 7)
CATEGORIES = {
    SKEW: "skew",
    SMALL_FILES: "small_files",
    MISSING_BROADCAST: "missing_broadcast",
    MISSING_CACHE: "missing_cache",
    SPILL: "spill",
    SERIALIZATION: "serialization_overhead",
}


def _finding(rule: int, severity: Column, message: Column, **evidence: Column) -> Column:
    pairs = [part for key, value in evidence.items() for part in (F.lit(key), value.cast("double"))]
    return F.struct(
        F.lit(rule).alias("detector_ord"),
        F.lit(CATEGORIES[rule]).alias("category"),
        severity.alias("severity"),
        message.alias("message"),
        F.create_map(*pairs).alias("evidence"),
    )


def _measured(*parts: str | float | Column) -> Column:
    """A message from names and values in turn: ``name = value; name = value``."""
    texts = []
    for name, value in zip(parts[::2], parts[1::2]):
        shown = value.cast("string") if isinstance(value, Column) else F.lit(f"{value:g}" if isinstance(value, (int, float)) else value)
        texts.append(F.concat(F.lit(f"{name} = "), shown))
    return F.concat_ws("; ", *texts)


# --- rules over stages -------------------------------------------------------


def _skew(limits: Thresholds) -> Column:
    ratio = F.col("shuffle_read_skew_ratio")
    hit = (F.col("num_tasks") >= limits.skew_min_tasks) & (ratio >= limits.skew_ratio)
    message = _measured(
        "largest / median shuffle read", fmt_fixed(ratio, 1), "limit", limits.skew_ratio, "tasks", F.col("num_tasks")
    )
    return F.when(
        hit,
        _finding(
            SKEW,
            F.when(ratio >= limits.skew_high_ratio, "high").otherwise("medium"),
            message,
            skew_ratio=round_fixed(ratio, 2),
            num_tasks=F.col("num_tasks"),
            total_shuffle_read_bytes=F.col("total_shuffle_read_bytes"),
        ),
    )


def _small_files(limits: Thresholds) -> Column:
    total = F.col("total_input_bytes")
    average = total / F.nullif(F.col("num_tasks"), F.lit(0))
    hit = (
        (F.col("num_tasks") >= limits.small_file_min_tasks)
        & (total > 0)
        & (average < limits.small_file_bytes)
    )
    message = _measured(
        "input per task, KB", fmt_fixed(average / 1024, 1),
        "limit", limits.small_file_bytes / 1024, "tasks", F.col("num_tasks"),
    )
    return F.when(
        hit,
        _finding(
            SMALL_FILES,
            F.lit("medium"),
            message,
            num_tasks=F.col("num_tasks"),
            avg_input_bytes_per_task=round_fixed(average, 1),
            total_input_bytes=total,
        ),
    )


def _spill(limits: Thresholds) -> Column:
    memory, disk = F.col("total_memory_spilled"), F.col("total_disk_spilled")
    message = _measured(
        "spilled from memory, MB", fmt_fixed(memory / 1e6, 1), "to disk, MB", fmt_fixed(disk / 1e6, 1)
    )
    return F.when(
        memory + disk > limits.spill_bytes,
        _finding(
            SPILL,
            F.when(disk > 0, "high").otherwise("medium"),
            message,
            memory_spilled_bytes=memory,
            disk_spilled_bytes=disk,
        ),
    )


def _serialization(limits: Thresholds) -> Column:
    run_time = F.col("total_executor_run_time_ms")
    ratio = F.col("serde_time_ms") / F.nullif(run_time, F.lit(0))
    hit = (
        (F.col("num_tasks") >= limits.serde_min_tasks)
        & (run_time > 0)
        & (ratio >= limits.serde_ratio)
    )
    message = _measured(
        "serialization, % of run time", fmt_fixed(ratio * 100, 0), "limit", limits.serde_ratio * 100
    )
    return F.when(
        hit,
        _finding(SERIALIZATION, F.lit("low"), message, overhead_ratio=round_fixed(ratio, 3)),
    )


def _from_stages(stages: DataFrame, *rules: Column) -> DataFrame:
    """Apply rules side by side in one pass over the stages."""
    hits = F.filter(F.array(*rules), lambda hit: hit.isNotNull())
    return stages.select("run_key", "stage_id", F.inline(hits)).select(
        "run_key",
        "detector_ord",
        "category",
        "severity",
        "stage_id",
        F.lit(None).cast("bigint").alias("execution_id"),
        "message",
        "evidence",
    )


def detect_skew(stages: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One task reads far more shuffle data than the median task."""
    return _from_stages(stages, _skew(limits))


def detect_small_files(stages: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Many tasks with little input each."""
    return _from_stages(stages, _small_files(limits))


def detect_spill(stages: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Data left execution memory for disk."""
    return _from_stages(stages, _spill(limits))


def detect_serialization_overhead(stages: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Serialization takes a large share of the run time."""
    return _from_stages(stages, _serialization(limits))


# --- rules over SQL executions -------------------------------------------------


def _small_side(signals: DataFrame) -> Column:
    """Bytes of the smaller side, where ``joinsides`` has told them."""
    known = "small_side_bytes" in signals.columns
    return F.col("small_side_bytes") if known else F.lit(None).cast("bigint")


def _unbroadcast(small: Column, limits: Thresholds, prefix: str) -> Column:
    hit = F.col(prefix + "has_sort_merge_join") & ~F.col(prefix + "has_broadcast_join")
    if limits.broadcast_side_bytes is not None:
        hit = hit & (small.isNull() | (small <= limits.broadcast_side_bytes))
    return hit


def _broadcast_finding(small: Column) -> Column:
    message = _measured(
        "execution", F.col("execution_id"), "sort-merge joins in the plan", "yes", "broadcast joins", "no"
    )
    found = _finding(
        MISSING_BROADCAST, F.lit("high"), message, execution_id=F.col("execution_id"), small_side_bytes=small
    )
    # A size that is not known is no evidence.
    return found.withField("evidence", F.map_filter(found["evidence"], lambda _, value: value.isNotNull()))


def _cache_finding(limits: Thresholds) -> Column:
    message = _measured(
        "executions that scan parquet", F.col("scans"), "limit", limits.min_scans, "cached scans", "none"
    )
    return _finding(MISSING_CACHE, F.lit("medium"), message, num_scanning_executions=F.col("scans"))


def detect_missing_broadcast(
    signals: DataFrame, use_final_plan: bool = False, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Executions that join by sort-merge and never by broadcast.

    The plan as first submitted is judged; ``use_final_plan`` judges the executed
    one instead, so joins that were turned into broadcasts at run time pass.  Where signals hold
    ``small_side_bytes`` it is evidence, and ``limits`` can leave out joins of two large sides.
    """
    small = _small_side(signals)
    hit = _unbroadcast(small, limits, "final_" if use_final_plan else "")
    found = _broadcast_finding(small)
    return signals.where(hit).select("run_key", "execution_id", F.inline(F.array(found))).select(
        "run_key",
        "detector_ord",
        "category",
        "severity",
        F.lit(None).cast("int").alias("stage_id"),
        "execution_id",
        "message",
        "evidence",
    )


def detect_missing_cache(signals: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Runs that scan files in several executions and cache nothing at all."""
    per_run = signals.groupBy("run_key").agg(
        F.count_if("has_parquet_scan").alias("scans"),
        F.max("has_cached_scan").alias("any_cached"),
    )
    found = _cache_finding(limits)
    hit = (F.col("scans") >= limits.min_scans) & ~F.col("any_cached")
    return per_run.where(hit).select("run_key", F.inline(F.array(found))).select(
        "run_key",
        "detector_ord",
        "category",
        "severity",
        F.lit(None).cast("int").alias("stage_id"),
        F.lit(None).cast("bigint").alias("execution_id"),
        "message",
        "evidence",
    )


def _plan_findings(signals: DataFrame, limits: Thresholds, use_final_plan: bool) -> DataFrame:
    """Both rules over SQL executions from one pass over the signals.

    The executions to report are few; the run's counts come from the same rows, as grouping
    sets, so that plans are read once.
    """
    small = _small_side(signals)
    hit = _unbroadcast(small, limits, "final_" if use_final_plan else "")
    judged = signals.select(
        "run_key",
        F.when(hit, F.col("execution_id")).alias("execution_id"),
        F.when(hit, small).alias("_small"),
        F.col("has_parquet_scan").cast("int").alias("_scan"),
        F.col("has_cached_scan").cast("int").alias("_cached"),
    )
    # One partial row per run and reported execution; null stands for all that are not reported.
    counted = judged.groupBy("run_key", "execution_id").agg(
        F.sum("_scan").alias("_scans"), F.max("_cached").alias("_any"), F.max("_small").alias("_small")
    )
    rolled = counted.groupingSets(
        [[F.col("run_key"), F.col("execution_id")], [F.col("run_key")]], "run_key", "execution_id"
    ).agg(
        F.grouping_id().alias("_set"),
        F.sum("_scans").alias("scans"),
        F.max("_any").alias("_any"),
        F.max("_small").alias("_small"),
    )
    one, run = F.col("_set") == 0, F.col("_set") != 0
    rules = F.array(
        F.when(one & F.col("execution_id").isNotNull(), _broadcast_finding(F.col("_small"))),
        F.when(run & (F.col("scans") >= limits.min_scans) & (F.col("_any") == 0), _cache_finding(limits)),
    )
    hits = F.filter(rules, lambda found: found.isNotNull())
    return rolled.select("run_key", "execution_id", F.inline(hits)).select(
        "run_key", "detector_ord", "category", "severity", F.lit(None).cast("int").alias("stage_id"),
        "execution_id", "message", "evidence",
    )


def all_findings(
    stages: DataFrame,
    signals: DataFrame,
    limits: Thresholds = DEFAULTS,
    use_final_plan: bool = False,
) -> DataFrame:
    """Findings of all rules, from one pass over the stages and one over the signals."""
    by_stage = _from_stages(
        stages, _skew(limits), _small_files(limits), _spill(limits), _serialization(limits)
    )
    by_plan = _plan_findings(signals, limits, use_final_plan)
    return by_stage.unionByName(by_plan).select(*schemas.FINDINGS.names)


def with_app_name(findings: DataFrame, apps: DataFrame) -> DataFrame:
    """Findings of the given runs, with the app name beside the run key."""
    return findings.join(apps.select("run_key", "app_name"), "run_key")


# The order in which findings are listed within a run; executions go by number after stages.
LISTING_ORDER = ["detector_ord", "stage_id", "execution_id"]
# Findings of a run are numbered in blocks of so many stages or executions.
_BLOCK = 4096


def findings_listing(findings: DataFrame) -> DataFrame:
    """Findings with their ``listing_position`` in their run, counted from one.

    A run with millions of findings is not sorted in one task: findings are counted per
    rule and block of stage or execution numbers first, the running total of those counts is
    where a block begins, and only within its block is a finding ranked.
    """
    of = F.coalesce(F.col("stage_id").cast("bigint"), F.col("execution_id"), F.lit(0))
    placed = findings.withColumn("_of", of).withColumn("_block", F.floor(F.col("_of") / _BLOCK))
    block = ["run_key", "detector_ord", "_block"]
    sizes = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("run_key").orderBy("detector_ord", "_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("_of"))
    return (
        placed.join(begins, block)
        .withColumn("listing_position", F.col("_before") + rank)
        .select(*findings.columns, "listing_position")
    )
