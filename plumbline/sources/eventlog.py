"""Directories of Spark event logs as tables.

The logs are the big input, so they are parsed once: ``ingest`` writes every
line of interest to Parquet, partitioned by event kind, without a shuffle.  The
tables below are then column-pruned, partition-pruned reads of that copy.  They
accept the unsaved events of ``parse_events`` just as well.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.sources import joinsides, packed
from plumbline.sources.files import PARTITION_BYTES, file_listing, twin_session

_SQL_EVENT = "org.apache.spark.sql.execution.ui.SparkListenerSQL"

# Event names as they stand in the logs, and our short kind names.
EVENT_KINDS = {
    "SparkListenerApplicationStart": "app_start",
    "SparkListenerApplicationEnd": "app_end",
    "SparkListenerStageSubmitted": "stage_submitted",
    "SparkListenerStageCompleted": "stage_completed",
    "SparkListenerTaskEnd": "task_end",
    _SQL_EVENT + "ExecutionStart": "sql_start",
    _SQL_EVENT + "ExecutionEnd": "sql_end",
    _SQL_EVENT + "AdaptiveExecutionUpdate": "sql_update",
}

UNFINISHED_SUFFIX = ".inprogress"
COMPRESSED_SUFFIX = ".zstd"
# What may follow a log's name without packing it.
PLAIN_SUFFIXES = ("compact", "json", "jsonl", "log", "txt")

# Headings around the executed tree in the plan text of a finished adaptive query.
_FINAL_TREE = r"(?s)== Final Plan ==\n(.*?)\n\s*\+- == Initial Plan =="


# --- reading ---------------------------------------------------------------


def run_key_of(path: Column) -> Column:
    """The run a log file belongs to.

    A rolling log is a directory of files, a single-file log stands for itself.
    The whole path is kept, since names may recur between log directories.
    """
    rolling_dir = F.regexp_extract(path, r"^(.*/eventlog_v2_[^/]+)/[^/]+$", 1)
    return F.when(rolling_dir != "", rolling_dir).otherwise(path)


def log_form(path: Column) -> Column:
    """How a log file has to be read: ``plain``, ``zstd``, ``hidden_zstd`` or ``unreadable``.

    Hidden are zstd logs whose last suffix is another one, as that of compacted rolling logs:
    readers go by the last suffix and would take packed bytes for text.  Unreadable are Spark's
    other codecs and suffixes that are not known.
    """
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    finished = F.regexp_replace(name, r"\.inprogress$", "")
    bare = F.regexp_replace(finished, r"\.compact$", "")
    suffix = F.regexp_extract(bare, r"\.([^.]+)$", 1)
    form = F.when(name.endswith(COMPRESSED_SUFFIX), "zstd").otherwise("hidden_zstd")
    return (
        F.when(suffix == COMPRESSED_SUFFIX[1:], form)
        .when((suffix == "") | suffix.isin(*PLAIN_SUFFIXES), "plain")
        .otherwise("unreadable")
    )


def unreadable_logs(spark: SparkSession, path: str | list[str], include_unfinished: bool = False) -> DataFrame:
    """``path, length`` of the files below ``path`` that ``read_log_lines`` cannot read."""
    listing = _wanted_files(file_listing(spark, path), F.col("path"), include_unfinished)
    return listing.where(log_form(F.col("path")) == "unreadable")


def _wanted_files(df: DataFrame, path: Column, include_unfinished: bool) -> DataFrame:
    return df if include_unfinished else df.where(~path.endswith(UNFINISHED_SUFFIX))


def read_log_lines(
    spark: SparkSession,
    path: str | list[str],
    include_unfinished: bool = False,
    bytes_per_task: int = PARTITION_BYTES,
    tolerate_cut_off: bool = False,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Lines of all logs below ``path``: ``run_key, value``.

    Rolling, compacted and single-file logs, plain or compressed with zstd, are read alike.
    Scans pack plain logs into tasks of up to ``bytes_per_task`` and split larger ones; zstd
    logs are read whole.  Compacted zstd logs, which Spark's readers do not know as such, are read as
    streams and split at their frames, see ``packed``.

    A log in another codec, or with a suffix that is not known, is an error that names it;
    ``skip_unreadable`` leaves such logs out, and ``unreadable_logs`` lists them.  A compressed
    log that a killed job left cut off in mid-block fails the read.  ``tolerate_cut_off`` reads
    such logs up to the cut instead; as Spark treats any read error on a file like that then, it
    is off unless asked for.
    """
    listing = _wanted_files(file_listing(spark, path), F.col("path"), include_unfinished).withColumn(
        "form", log_form(F.col("path"))
    )
    if not skip_unreadable:
        bad = [r.path for r in listing.where("form = 'unreadable'").select("path").limit(10).collect()]
        if bad:
            raise ValueError(f"logs in a codec or with a suffix that cannot be read: {', '.join(bad)}")
    seen = {r.form: r for r in listing.groupBy("form").agg(F.max("length").alias("largest"), F.sum("length").alias("total")).collect()}

    def text(reader: SparkSession, form: str) -> DataFrame:
        if tolerate_cut_off:
            reader.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
        file_path = F.col("_metadata.file_path")
        lines = reader.read.option("recursiveFileLookup", "true").text(path)
        lines = _wanted_files(lines, file_path, include_unfinished).where(log_form(file_path) == form)
        return lines.select(run_key_of(file_path).alias("run_key"), "value")

    plain = twin_session(spark)
    plain.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_per_task))
    lines = text(plain, "plain")
    if "zstd" in seen:
        # Spark takes a .zstd text file for one it may read from the middle, and then fails to.
        # Splits as large as the largest such file leave it whole.  A log that grows while it is
        # listed is an unfinished one.
        whole, least = twin_session(spark), 2 * seen["zstd"].largest
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            whole.conf.set(name, str(max(least, bytes_per_task)))
        tasks = max(math.ceil(seen["zstd"].total / bytes_per_task), spark.sparkContext.defaultParallelism)
        lines = lines.union(text(whole, "zstd").coalesce(tasks))
    if "hidden_zstd" in seen:
        hidden = listing.where("form = 'hidden_zstd'").select("path", "length")
        stores = F.regexp_extract("path", "^([^:/]+):", 1).isin(*packed.OPENABLE)
        opened = packed.packed_lines(hidden.where(stores), bytes_per_task, tolerate_cut_off)
        lines = lines.union(opened.select(run_key_of(F.col("path")).alias("run_key"), "value"))
        if not hidden.where(~stores).isEmpty():
            lines = lines.union(_unpacked(spark, path, include_unfinished, tolerate_cut_off, ~stores))
    return lines


def _unpacked(spark: SparkSession, path: str | list[str], include_unfinished: bool, tolerate: bool, which: Column) -> DataFrame:
    """Lines of hidden zstd logs in stores that only Spark can open, each packed log one cell of up to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(which)
    files = _wanted_files(files, F.col("path"), include_unfinished).where(log_form(F.col("path")) == "hidden_zstd")
    keyed = files.select(run_key_of(F.col("path")).alias("run_key"), "content")
    return keyed.mapInArrow(_zstd_lines(tolerate), "run_key string, value string")


def _zstd_lines(tolerate: bool):
    def unpack(batches):
        for batch in batches:
            for key, content in zip(batch.column("run_key").to_pylist(), batch.column("content")):
                unpacked = zstandard.ZstdDecompressor().stream_reader(
                    io.BytesIO(content.as_py()), read_across_frames=True
                )
                lines = io.TextIOWrapper(unpacked, encoding="utf-8", errors="replace", newline="\n")
                values, size = [], 0
                try:
                    for line in lines:
                        values.append(line.rstrip("\r\n"))
                        size += len(line)
                        if size > 4 << 20:
                            yield _batch(key, values)
                            values, size = [], 0
                except zstandard.ZstdError:
                    if not tolerate:
                        raise
                if values:
                    yield _batch(key, values)

    return unpack


def _batch(key: str, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"run_key": [key] * len(values), "value": values})


def parse_events(lines: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """One flat row per event of interest from lines of JSON.

    Other events, blank lines, truncated lines and JSON that is not an object
    are left out.  ``kinds`` narrows the work to some kinds of event.
    """
    wanted = _wanted(kinds)
    parsed = _of_kinds(lines, wanted, schemas.EVENT_JSON)

    def info(name: str) -> Column:
        return F.col(f"`Stage Info`.`{name}`")

    def metric(*path: str) -> Column:
        inner = ".".join(f"`{part}`" for part in ("Task Metrics", *path))
        return F.coalesce(F.col(inner), F.lit(0))

    launch = F.coalesce(F.col("`Task Info`.`Launch Time`"), F.lit(0))
    finish = F.coalesce(F.col("`Task Info`.`Finish Time`"), F.lit(0))
    succeeded = F.col("`Task End Reason`.`Reason`").eqNullSafe(F.lit("Success"))

    # What a task added to the sizes of exchanges; a join's inputs are told by them, see joinsides.
    updates = F.filter("`Task Info`.`Accumulables`", lambda a: a["Name"] == joinsides.SIZE_METRIC)
    sizes = F.transform(
        updates,
        lambda a: F.struct(a["ID"].alias("accumulator_id"), a["Update"].try_cast("bigint").alias("bytes")),
    )

    # The task columns mean something on task events only.
    return parsed.select(
        _kind(wanted),
        "run_key",
        F.col("`App ID`").alias("app_id"),
        F.col("`App Name`").alias("app_name"),
        F.coalesce("Timestamp", "time").alias("event_ms"),
        F.coalesce(F.col("`Stage ID`"), info("Stage ID")).alias("stage_id"),
        F.coalesce(F.col("`Stage Attempt ID`"), info("Stage Attempt ID")).alias("stage_attempt"),
        info("Stage Name").alias("stage_name"),
        info("Submission Time").alias("submission_time_ms"),
        info("Completion Time").alias("completion_time_ms"),
        F.coalesce(F.col("`Task Info`.`Task ID`"), F.lit(-1)).alias("task_id"),
        F.greatest(finish - launch, F.lit(0)).alias("duration_ms"),
        metric("Executor Run Time").alias("executor_run_time_ms"),
        metric("Executor Deserialize Time").alias("executor_deserialize_time_ms"),
        metric("Result Serialization Time").alias("result_serialization_time_ms"),
        metric("JVM GC Time").alias("gc_time_ms"),
        metric("Memory Bytes Spilled").alias("memory_bytes_spilled"),
        metric("Disk Bytes Spilled").alias("disk_bytes_spilled"),
        (
            metric("Shuffle Read Metrics", "Remote Bytes Read")
            + metric("Shuffle Read Metrics", "Local Bytes Read")
        ).alias("shuffle_read_bytes"),
        metric("Shuffle Read Metrics", "Total Records Read").alias("shuffle_read_records"),
        metric("Shuffle Write Metrics", "Shuffle Bytes Written").alias("shuffle_write_bytes"),
        metric("Input Metrics", "Bytes Read").alias("input_bytes"),
        (~succeeded).alias("failed"),
        F.col("executionId").alias("execution_id"),
        "description",
        F.col("physicalPlanDescription").alias("physical_plan"),
        F.when(F.col("sparkPlanInfo").contains(joinsides.JOIN_NODE), F.col("sparkPlanInfo")).alias("join_plan"),
        sizes.alias("exchange_bytes"),
    )


def event_counts(lines: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """``kind, events``: how many events of each kind there are, parsing nothing else."""
    wanted = _wanted(kinds)
    named = _of_kinds(lines, wanted, "Event string").select(_kind(wanted))
    return named.groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


def _wanted(kinds: Iterable[str] | None) -> dict[str, str]:
    chosen = set(EVENT_KINDS.values()) if kinds is None else set(kinds)
    return {name: kind for name, kind in EVENT_KINDS.items() if kind in chosen}


def _kind(wanted: dict[str, str]) -> Column:
    by_name = F.create_map(*[F.lit(part) for pair in wanted.items() for part in pair])
    return F.element_at(by_name, F.col("Event")).alias("kind")


def _of_kinds(lines: DataFrame, wanted: dict[str, str], schema: str) -> DataFrame:
    """Lines of the wanted events, parsed."""
    # A cheap text test first: most lines need not be parsed at all.
    mentioned = F.lit(False)
    for name in wanted:
        mentioned = mentioned | F.col("value").contains(name)
    # Going through inline() keeps the last filter from repeating the parse.
    return (
        lines.where(mentioned)
        .select("run_key", F.inline(F.array(F.from_json("value", schema))))
        .where(F.col("Event").isin(*wanted))
    )


def ingest(
    spark: SparkSession,
    path: str | list[str],
    out: str,
    include_unfinished: bool = False,
    bytes_per_task: int = PARTITION_BYTES,
    tolerate_cut_off: bool = False,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Parse all logs below ``path`` once and keep the events at ``out`` as Parquet.

    Before they are written events are dealt out by kind, in partitions that adaptive
    execution splits and merges by size: a kind of few events is one file, however many tasks
    read the logs.
    """
    lines = read_log_lines(
        spark, path, include_unfinished, bytes_per_task, tolerate_cut_off, skip_unreadable
    )
    events = parse_events(lines)
    events.hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").parquet(out)
    # The schema is known, so no file need be opened for it, nor need there be any.
    return spark.read.schema(events.schema).parquet(out)


def of_runs(events: DataFrame, app_rows: DataFrame) -> DataFrame:
    """Events of the given runs alone."""
    return events.join(app_rows.select("run_key"), "run_key", "left_semi").select(*events.columns)


# --- tables ----------------------------------------------------------------


def apps(events: DataFrame, include_unfinished: bool = False) -> DataFrame:
    """One row per run, also for runs whose start event is missing.

    The suffix that marks an unfinished rolling log is on an empty side file that
    a line reader cannot see, so such a run counts as finished by its end event.
    """
    seen = events.groupBy("run_key").agg(
        F.max(F.when(F.col("kind") == "app_end", 1).otherwise(0)).alias("ended")
    )
    # Start events are one per run; keeping their text apart leaves the pass over
    # all events with a plain number to combine.
    starts = (
        events.where(F.col("kind") == "app_start")
        .groupBy("run_key")
        .agg(
            F.max("app_id").alias("app_id"),
            F.max("app_name").alias("app_name"),
            F.max("event_ms").alias("start_ms"),
        )
    )
    rolling = F.col("run_key").rlike(r"/eventlog_v2_[^/]+$")
    found = seen.join(starts, "run_key", "left").select(
        "run_key",
        _or_unknown("app_id"),
        _or_unknown("app_name"),
        F.col("run_key").alias("log_path"),
        "start_ms",
        ((F.col("ended") == 1) | ~rolling).alias("finished"),
    )
    return found if include_unfinished else found.where("finished")


def tasks(events: DataFrame) -> DataFrame:
    """Task records; events that name no stage are left out."""
    return events.where((F.col("kind") == "task_end") & F.col("stage_id").isNotNull()).select(
        *schemas.TASKS.names
    )


def stage_events(events: DataFrame) -> DataFrame:
    """Submission and completion records of stages."""
    return (
        events.where(F.col("kind").isin("stage_submitted", "stage_completed"))
        .where(F.col("stage_id").isNotNull())
        .withColumn("completed", F.col("kind") == "stage_completed")
        .select(*schemas.STAGE_EVENTS.names)
    )


def sql_times(events: DataFrame) -> DataFrame:
    """Start and run time of SQL executions, without their texts: sums of plain numbers.

    An end without a start is left out; a start without an end has no duration.
    """
    kind = F.col("kind")
    return (
        events.where(kind.isin("sql_start", "sql_end") & F.col("execution_id").isNotNull())
        .groupBy("run_key", "execution_id")
        .agg(
            F.max(F.when(kind == "sql_start", 1)).alias("_started"),
            F.max(F.when(kind == "sql_start", F.col("event_ms"))).alias("start_ms"),
            F.max(F.when(kind == "sql_end", F.col("event_ms"))).alias("_end_ms"),
        )
        .where(F.col("_started") == 1)
        .select("run_key", "execution_id", "start_ms", (F.col("_end_ms") - F.col("start_ms")).alias("duration_ms"))
    )


def sql_executions(events: DataFrame) -> DataFrame:
    """SQL executions with their plan texts and run time; for the times alone see ``sql_times``.

    ``final_plan`` is the executed tree of an adaptive query.
    """
    kind = F.col("kind")
    started = kind == "sql_start"
    final_tree = F.regexp_extract("physical_plan", _FINAL_TREE, 1)
    texts = (
        events.where(kind.isin("sql_start", "sql_update") & F.col("execution_id").isNotNull())
        .groupBy("run_key", "execution_id")
        .agg(
            F.max(F.when(started, F.coalesce("description", F.lit("")))).alias("description"),
            F.max(F.when(started, F.coalesce("physical_plan", F.lit("")))).alias("physical_plan"),
            F.max(F.when((kind == "sql_update") & (final_tree != ""), final_tree)).alias(
                "final_plan"
            ),
        )
    )
    return sql_times(events).join(texts, ["run_key", "execution_id"]).select(*schemas.SQL_EXECUTIONS.names)


# Operator names searched for in plan text.
PLAN_FLAGS = {
    "has_sort_merge_join": ("SortMergeJoin",),
    "has_broadcast_join": ("BroadcastHashJoin",),
    "has_parquet_scan": ("Scan parquet",),
    "has_cached_scan": ("InMemoryTableScan", "InMemoryRelation"),
}


def plan_flags(plan: Column, names: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Which operators a plan text mentions; any of its names raises a flag."""
    flags = {}
    for flag, spellings in names.items():
        found = F.lit(False)
        for spelling in spellings:
            found = found | plan.contains(spelling)
        flags[flag] = found
    return flags


def sql_signals(events: DataFrame, names: dict[str, tuple[str, ...]] = PLAN_FLAGS) -> DataFrame:
    """Plan flags per SQL execution, for the rules.

    The text is searched where it is read; only flags are shuffled.  ``names`` may
    list more spellings, such as those of other scans, under the same flags.
    """
    started = F.col("kind") == "sql_start"
    text = F.col("physical_plan")
    final_tree = F.regexp_extract("physical_plan", _FINAL_TREE, 1)
    is_final = (F.col("kind") == "sql_update") & (final_tree != "")
    plan = F.when(started, F.coalesce(text, F.lit(""))).when(is_final, final_tree)
    flagged = events.where(F.col("kind").isin("sql_start", "sql_update")).select(
        "run_key",
        "execution_id",
        started.alias("_started"),
        is_final.alias("_final"),
        *[flag.alias(name) for name, flag in plan_flags(plan, names).items()],
    )
    return (
        flagged.where("_started or _final")
        .groupBy("run_key", "execution_id")
        .agg(
            F.max("_started").alias("_any_start"),
            *[F.max(F.when(F.col("_started"), F.col(f))).alias(f) for f in names],
            *[F.max(F.when(F.col("_final"), F.col(f))).alias("final_" + f) for f in names],
        )
        .where("_any_start")
        .select(
            "run_key",
            "execution_id",
            *names,
            *[F.coalesce("final_" + f, f).alias("final_" + f) for f in names],
        )
    )


def signals_of(
    executions: DataFrame, names: dict[str, tuple[str, ...]] = PLAN_FLAGS
) -> DataFrame:
    """``sql_signals`` for executions that are at hand with their plan text."""
    first = plan_flags(F.col("physical_plan"), names)
    last = plan_flags(F.coalesce("final_plan", "physical_plan"), names)
    return executions.select(
        "run_key",
        "execution_id",
        *[flag.alias(name) for name, flag in first.items()],
        *[flag.alias("final_" + name) for name, flag in last.items()],
    )


# --- finding runs ----------------------------------------------------------


def latest_runs(app_rows: DataFrame) -> DataFrame:
    """The newest run of each app name; equal start times go to the larger key.

    A maximum combines map-side, so a name with very many runs costs no more
    than another.
    """
    newest = F.max(F.struct("start_ms", "run_key", "app_id", "log_path")).alias("newest")
    return (
        app_rows.groupBy("app_name")
        .agg(newest)
        .select("app_name", "newest.run_key", "newest.app_id", "newest.log_path", "newest.start_ms")
    )


def find_run(app_rows: DataFrame, app_name: str) -> DataFrame:
    """The newest run with exactly this app name; no row if there is none."""
    return latest_runs(app_rows.where(F.col("app_name") == app_name))


def latest_run(app_rows: DataFrame, prefix: str) -> DataFrame:
    """The newest run among all app names that start with ``prefix``."""
    newest = F.max(F.struct("start_ms", "run_key", "app_name", "app_id", "log_path")).alias("newest")
    return (
        app_rows.where(F.col("app_name").startswith(prefix))
        .agg(newest)
        .where(F.col("newest").isNotNull())
        .select("newest.app_name", "newest.run_key", "newest.app_id", "newest.log_path", "newest.start_ms")
    )


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown")).alias(name)
