"""Event-log records worked out from business tables.

The driver's tables hold no event logs, so these fixed formulas read them as if
they did: a line item is a task, a supplier a stage, an order a SQL execution.
That runs the rules over whole tables, with faults of known size built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators.layout import spread
from plumbline.sources.eventlog import EVENT_KINDS

RUNS = 4
DAY_MS = 86_400_000

# App names of the four runs, and the pairs to compare.
APP_NAMES = ["report_baseline", "ingest_baseline", "report_tuned", "ingest_tuned"]
PAIRS = [
    ("Report job", "report_baseline", "report_tuned"),
    ("Ingest job", "ingest_baseline", "ingest_tuned"),
    ("Absent job", "absent_baseline", "absent_tuned"),
]

# Plan texts by order key modulo five.
PLAN_SORT_MERGE = "SortMergeJoin [k] +- FileScan: Scan parquet orders"
PLAN_BROADCAST = "BroadcastHashJoin [k] +- FileScan: Scan parquet orders"
PLAN_CACHED = "InMemoryTableScan [k] +- InMemoryRelation +- Scan parquet orders"
PLAN_PLAIN = "HashAggregate [k] +- Scan parquet orders"
PLAN_BOTH = "SortMergeJoin [k] +- BroadcastHashJoin [j]"
PLAN_NO_SCAN = "LocalTableScan [k]"
FINAL_TREE = "BroadcastHashJoin [k] +- ShuffleQueryStage 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day_ms(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS


def _run(app_no: Column) -> Column:
    return F.concat(F.lit("run_"), app_no.cast("string"))


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task records from ``lineitem``, in the task schema."""
    s, line = F.col("l_suppkey"), F.col("l_linenumber").cast("bigint")
    p = F.floor("l_extendedprice")
    q = F.col("l_quantity").cast("bigint")
    none = F.lit(0).cast("bigint")
    hot = (s % 3 == 0) & (F.col("l_orderkey") % 97 == 5)
    return table(spark, sf_dir, "lineitem").select(
        _run(s % RUNS).alias("run_key"),
        F.floor(s / RUNS).cast("int").alias("stage_id"),
        F.lit(0).alias("stage_attempt"),
        (F.col("l_orderkey") * 10 + line).alias("task_id"),
        F.greatest(q * 12 - line * 20, none).alias("duration_ms"),
        (q * 10).alias("executor_run_time_ms"),
        F.when(s % 6 == 0, q * 3).otherwise(q).alias("executor_deserialize_time_ms"),
        F.when(s % 6 == 0, q).otherwise(none).alias("result_serialization_time_ms"),
        F.floor(F.col("l_discount") * 100 + 0.5).alias("gc_time_ms"),
        F.when(s % 7 == 0, line * 1000).otherwise(none).alias("memory_bytes_spilled"),
        F.when(s % 14 == 0, line * 500).otherwise(none).alias("disk_bytes_spilled"),
        F.when(line == 1, none).when(hot, p * 12).otherwise(p).alias("shuffle_read_bytes"),
        (line * 10).alias("shuffle_read_records"),
        (p * 3).alias("shuffle_write_bytes"),
        F.when(s % 5 == 0, p * 200).when(s % 5 == 1, p).otherwise(none).alias("input_bytes"),
        (F.col("l_returnflag") == "R").alias("failed"),
    )


def stage_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission and a completion per stage, from the ship dates of a supplier."""
    s = F.col("l_suppkey")
    per_stage = (
        table(spark, sf_dir, "lineitem")
        .groupBy(_run(s % RUNS).alias("run_key"), F.floor(s / RUNS).cast("int").alias("stage_id"))
        .agg(
            F.min(_day_ms("l_shipdate")).alias("first_ms"),
            F.max(_day_ms("l_shipdate")).alias("last_ms"),
        )
    )
    name = F.concat(F.lit("stage "), F.col("stage_id").cast("string"))
    unknown = F.lit(None).cast("bigint")

    def event(completed: bool, completion: Column) -> Column:
        return F.struct(
            F.lit(0).alias("stage_attempt"),
            F.lit(completed).alias("completed"),
            name.alias("stage_name"),
            F.col("first_ms").alias("submission_time_ms"),
            completion.alias("completion_time_ms"),
        )

    both = F.array(event(False, unknown), event(True, F.col("last_ms")))
    return per_stage.select("run_key", "stage_id", F.inline(both)).select(
        *schemas.STAGE_EVENTS.names
    )


def sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL executions from ``orders``; pending orders are executions without an end."""
    key, app_no = F.col("o_orderkey"), F.col("o_custkey") % RUNS
    kind = key % 5
    plan = (
        F.when(kind == 0, PLAN_SORT_MERGE)
        .when(kind == 1, PLAN_BROADCAST)
        .when((kind == 2) & (app_no == 0), PLAN_PLAIN)
        .when(kind == 2, PLAN_CACHED)
        .when(kind == 3, PLAN_BOTH)
        .otherwise(PLAN_NO_SCAN)
    )
    ended = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").select(
        _run(app_no).alias("run_key"),
        key.alias("execution_id"),
        F.col("o_orderpriority").alias("description"),
        plan.alias("physical_plan"),
        F.when(key % 10 == 0, FINAL_TREE).alias("final_plan"),
        _day_ms("o_orderdate").alias("start_ms"),
        F.when(ended, F.floor(F.col("o_totalprice") / 100)).alias("duration_ms"),
    )


def app_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four runs, each from its first order date."""
    app_no = F.col("o_custkey") % RUNS
    names = F.array(*[F.lit(n) for n in APP_NAMES])
    return (
        table(spark, sf_dir, "orders")
        .groupBy(app_no.alias("app_no"))
        .agg(F.min(_day_ms("o_orderdate")).alias("start_ms"))
        .select(
            _run(F.col("app_no")).alias("run_key"),
            F.concat(F.lit("app-"), F.col("app_no").cast("string")).alias("app_id"),
            F.element_at(names, (F.col("app_no") + 1).cast("int")).alias("app_name"),
            _run(F.col("app_no")).alias("log_path"),
            "start_ms",
            F.lit(True).alias("finished"),
        )
    )


def many_app_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per customer: many runs of the same few app names, to search in."""
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("logs/"), key).alias("run_key"),
        F.concat(F.lit("app-"), key).alias("app_id"),
        F.concat(F.lit("job_"), F.col("c_nationkey").cast("string")).alias("app_name"),
        F.concat(F.lit("logs/"), key).alias("log_path"),
        F.floor(F.col("c_acctbal") / 10).alias("start_ms"),
        F.lit(True).alias("finished"),
    )


def pair_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, schemas.PAIRS)


# --- the same records as lines of JSON ------------------------------------------

_NAMES = {kind: name for name, kind in EVENT_KINDS.items()}


def _line(kind: str, **fields: Column) -> Column:
    """A JSON event; underscores in field names stand for spaces."""
    parts = [value.alias(name.replace("_", " ")) for name, value in fields.items()]
    return F.to_json(F.struct(F.lit(_NAMES[kind]).alias("Event"), *parts))


def _as_lines(rows: DataFrame, *lines: Column) -> DataFrame:
    """``run_key, value``: the lines of each row, null ones left out.

    Going through explode() keeps text filters from writing the JSON once per filter.  The array is
    a plain one, as Spark compiles no expression below a function like array_compact().
    """
    value = F.explode(F.array(*lines))
    return rows.select("run_key", value.alias("value")).where(F.col("value").isNotNull())


def _named(**fields: Column | str) -> Column:
    return F.struct(
        *[
            (F.col(value) if isinstance(value, str) else value).alias(name.replace("_", " "))
            for name, value in fields.items()
        ]
    )


def task_lines(spark: SparkSession, sf_dir: str, partitions: int = 1) -> DataFrame:
    """``run_key, value``: a task-end event per line item, made and parsed in ``partitions`` tasks or more."""
    remote = F.floor(F.col("shuffle_read_bytes") / 3)
    # Some launches lie after the finish, so that the raw duration is negative.
    launch = F.lit(1_700_000_000_000).cast("bigint")
    finish = launch + F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(-5)
    line = _line(
        "task_end",
        Stage_ID=F.col("stage_id"),
        Stage_Attempt_ID=F.col("stage_attempt"),
        Task_End_Reason=_named(
            Reason=F.when(F.col("failed"), "ExceptionFailure").otherwise("Success")
        ),
        Task_Info=_named(Task_ID="task_id", Launch_Time=launch, Finish_Time=finish),
        Task_Metrics=_named(
            Executor_Run_Time="executor_run_time_ms",
            Executor_Deserialize_Time="executor_deserialize_time_ms",
            Result_Serialization_Time="result_serialization_time_ms",
            JVM_GC_Time="gc_time_ms",
            Memory_Bytes_Spilled="memory_bytes_spilled",
            Disk_Bytes_Spilled="disk_bytes_spilled",
            Shuffle_Read_Metrics=_named(
                Remote_Bytes_Read=remote,
                Local_Bytes_Read=F.col("shuffle_read_bytes") - remote,
                Total_Records_Read="shuffle_read_records",
            ),
            Shuffle_Write_Metrics=_named(Shuffle_Bytes_Written="shuffle_write_bytes"),
            Input_Metrics=_named(Bytes_Read="input_bytes"),
        ),
    )
    return _as_lines(spread(task_rows(spark, sf_dir), partitions, "task_id"), line)


def stage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission and completion events of the stages."""
    info = dict(
        Stage_ID="stage_id",
        Stage_Attempt_ID="stage_attempt",
        Stage_Name="stage_name",
        Submission_Time="submission_time_ms",
    )
    done = _line("stage_completed", Stage_Info=_named(**info, Completion_Time="completion_time_ms"))
    begun = _line("stage_submitted", Stage_Info=_named(**info))
    line = F.when(F.col("completed"), done).otherwise(begun)
    return _as_lines(stage_event_rows(spark, sf_dir), line)


def sql_lines(spark: SparkSession, sf_dir: str, partitions: int = 1) -> DataFrame:
    """Start, end and plan-update events of the SQL executions, in ``partitions`` tasks or more."""
    execution = F.col("execution_id")
    start = _line(
        "sql_start",
        executionId=execution,
        description=F.col("description"),
        physicalPlanDescription=F.col("physical_plan"),
        time=F.col("start_ms"),
    )
    end = F.when(
        F.col("duration_ms").isNotNull(),
        _line("sql_end", executionId=execution, time=F.col("start_ms") + F.col("duration_ms")),
    )
    text = F.concat(
        F.lit("AdaptiveSparkPlan\n+- == Final Plan ==\n"),
        F.col("final_plan"),
        F.lit("\n+- == Initial Plan ==\n"),
        F.col("physical_plan"),
    )
    update = F.when(
        F.col("final_plan").isNotNull(),
        _line("sql_update", executionId=execution, physicalPlanDescription=text),
    )
    return _as_lines(spread(sql_rows(spark, sf_dir), partitions, "execution_id"), start, update, end)


def sized_join_lines(spark: SparkSession, sf_dir: str, partitions: int = 1) -> DataFrame:
    """Starts of SQL executions with plan trees, and task ends of their joins.

    The join of order ``k`` has accumulators ``2k`` and ``2k + 1``; its line items are the
    tasks that wrote for its two sides, a whole price each.
    """
    execution = F.col("execution_id")

    def node(name: str, size_id: Column | None, *below: Column) -> Column:
        metric = '{"name":"data size","accumulatorId":%d,"metricType":"size"}' if size_id is not None else ""
        inner = ",".join(["%s"] * len(below))
        text = f'{{"nodeName":"{name}","children":[{inner}],"metrics":[{metric}]}}'
        return F.format_string(text, *below, *([size_id] if size_id is not None else []))

    sides = [node("Sort", None, node("Exchange", execution * 2 + side, node("Scan", None))) for side in (0, 1)]
    tree = F.when(F.col("physical_plan").contains("SortMergeJoin"), node("SortMergeJoin", None, *sides))
    start = _line(
        "sql_start",
        executionId=execution,
        physicalPlanDescription=F.col("physical_plan"),
        time=F.col("start_ms"),
    )
    # The tree goes in as JSON and not as a text.
    start = F.when(tree.isNull(), start).otherwise(
        F.concat(F.regexp_replace(start, r"\}$", ""), F.lit(',"sparkPlanInfo":'), tree, F.lit("}"))
    )
    executions = spread(sql_rows(spark, sf_dir), partitions, "execution_id")

    orders = table(spark, sf_dir, "orders").select("o_orderkey", _run(F.col("o_custkey") % RUNS).alias("run_key"))
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    side = F.col("l_linenumber").cast("bigint") % 2
    update = _named(
        ID=F.col("l_orderkey") * 2 + side,
        Name=F.lit("data size"),
        Update=F.floor("l_extendedprice").cast("string"),
    )
    other = _named(ID=F.lit(1).cast("bigint"), Name=F.lit("records read"), Update=F.lit("17"))
    end = _line(
        "task_end",
        Stage_ID=F.lit(0),
        Task_End_Reason=_named(Reason=F.when(F.col("l_returnflag") == "R", "ExceptionFailure").otherwise("Success")),
        Task_Info=_named(Task_ID="l_orderkey", Accumulables=F.array(other, update)),
    )
    return _as_lines(executions, start).unionByName(_as_lines(items, end))


def app_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end events of the runs."""
    start = _line(
        "app_start",
        App_Name=F.col("app_name"),
        App_ID=F.col("app_id"),
        Timestamp=F.col("start_ms"),
    )
    end = _line("app_end", Timestamp=F.col("start_ms") + DAY_MS)
    return _as_lines(app_rows(spark, sf_dir), start, end)


def log_lines(spark: SparkSession, sf_dir: str, partitions: int = 1) -> DataFrame:
    """The whole event log of all runs."""
    return (
        task_lines(spark, sf_dir, partitions)
        .unionByName(stage_lines(spark, sf_dir))
        .unionByName(sql_lines(spark, sf_dir, partitions))
        .unionByName(app_lines(spark, sf_dir))
    )
