"""Column layouts shared by the sources and the operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

APPS = _fields(run_key=_S, app_id=_S, app_name=_S, log_path=_S, start_ms=_L, finished=_B)

TASK_METRICS = (
    "executor_run_time_ms",
    "executor_deserialize_time_ms",
    "result_serialization_time_ms",
    "gc_time_ms",
    "memory_bytes_spilled",
    "disk_bytes_spilled",
    "shuffle_read_bytes",
    "shuffle_read_records",
    "shuffle_write_bytes",
    "input_bytes",
)

TASKS = _fields(
    run_key=_S,
    stage_id=_I,
    stage_attempt=_I,
    task_id=_L,
    duration_ms=_L,
    **{name: _L for name in TASK_METRICS},
    failed=_B,
)

STAGE_EVENTS = _fields(
    run_key=_S,
    stage_id=_I,
    stage_attempt=_I,
    completed=_B,
    stage_name=_S,
    submission_time_ms=_L,
    completion_time_ms=_L,
)

STAGES = _fields(
    run_key=_S,
    stage_id=_I,
    name=_S,
    num_tasks=_L,
    submission_time_ms=_L,
    completion_time_ms=_L,
    duration_ms=_L,
    total_shuffle_read_bytes=_L,
    total_shuffle_write_bytes=_L,
    total_input_bytes=_L,
    total_memory_spilled=_L,
    total_disk_spilled=_L,
    total_gc_time_ms=_L,
    total_executor_run_time_ms=_L,
    max_task_run_time_ms=_L,
    serde_time_ms=_L,
    shuffle_read_skew_ratio=_D,
    task_duration_skew_ratio=_D,
)

SQL_EXECUTIONS = _fields(
    run_key=_S,
    execution_id=_L,
    description=_S,
    physical_plan=_S,
    final_plan=_S,
    start_ms=_L,
    duration_ms=_L,
)

FINDINGS = _fields(
    run_key=_S,
    detector_ord=_I,
    category=_S,
    severity=_S,
    stage_id=_I,
    execution_id=_L,
    message=_S,
    evidence=T.MapType(_S, _D),
)

RECOMMENDATIONS = _fields(
    category=_S,
    title=_S,
    detail=_S,
    spark_conf=T.MapType(_S, _S),
    code_change=_S,
)

PAIRS = _fields(label=_S, baseline_app=_S, tuned_app=_S)

# One schema for every event kind that is read; a line fills the fields its kind
# has and leaves the rest null.  Names are the literal JSON names.
EVENT_JSON = """
`Event` string,
`App Name` string, `App ID` string, `Timestamp` bigint,
`Stage ID` int, `Stage Attempt ID` int,
`Stage Info` struct<
  `Stage ID`: int, `Stage Attempt ID`: int, `Stage Name`: string,
  `Submission Time`: bigint, `Completion Time`: bigint>,
`Task Info` struct<
  `Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint,
  `Accumulables`: array<struct<`ID`: bigint, `Name`: string, `Update`: string>>>,
`Task End Reason` struct<`Reason`: string>,
`Task Metrics` struct<
  `Executor Run Time`: bigint, `Executor Deserialize Time`: bigint,
  `Result Serialization Time`: bigint, `JVM GC Time`: bigint,
  `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
  `Shuffle Read Metrics`: struct<
    `Remote Bytes Read`: bigint, `Local Bytes Read`: bigint, `Total Records Read`: bigint>,
  `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>,
  `Input Metrics`: struct<`Bytes Read`: bigint>>,
`executionId` bigint, `description` string, `physicalPlanDescription` string, `time` bigint,
`sparkPlanInfo` string
"""
