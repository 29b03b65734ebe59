"""Queries over telemetry: parsing, roll-ups, rules, advice, comparison, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.formatting import fmt_bytes, fmt_pct_change, pct_change
from plumbline.operators import advice, compare, report, rollup, rules
from plumbline.settle import settled, shared_folder
from plumbline.sources import eventlog, joinsides, telemetry

# --- frames the queries share ------------------------------------------------


def _cores(spark: SparkSession) -> int:
    """Tasks that JSON is made and parsed in at least, also where a table is one row group."""
    return spark.sparkContext.defaultParallelism


def _stages(spark: SparkSession, sf: str, duration_skew: bool = False) -> DataFrame:
    return rollup.stage_rollup(
        telemetry.task_rows(spark, sf),
        telemetry.stage_event_rows(spark, sf),
        duration_skew=duration_skew,
    )


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return eventlog.signals_of(telemetry.sql_rows(spark, sf))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return rules.all_findings(_stages(spark, sf), _signals(spark, sf))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.app_metrics(telemetry.app_rows(spark, sf), _stages(spark, sf))


def _settled_metrics_and_findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both from one roll-up, for queries that come back to them several times."""
    stages = settled(_stages(spark, sf))
    metrics = rollup.app_metrics(telemetry.app_rows(spark, sf), stages)
    findings = rules.all_findings(stages, _signals(spark, sf))
    return settled(metrics), settled(findings)


def _compared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return telemetry.pair_rows(spark), telemetry.app_rows(spark, sf)


# --- event logs -----------------------------------------------------------------


def evt_type_counts(spark, sf):
    """Events of each kind among the lines of the logs."""
    return eventlog.event_counts(telemetry.log_lines(spark, sf, _cores(spark)))


def evt_task_extract(spark, sf):
    """Task records out of JSON lines."""
    lines = telemetry.task_lines(spark, sf, _cores(spark))
    return eventlog.tasks(eventlog.parse_events(lines, ["task_end"]))


def evt_stage_rollup(spark, sf):
    """Stages straight from JSON lines."""
    lines = telemetry.task_lines(spark, sf, _cores(spark)).unionByName(telemetry.stage_lines(spark, sf))
    # Parsed once, and only the columns kept that the roll-up comes back to.
    events = settled(
        eventlog.parse_events(lines, ["task_end", "stage_submitted", "stage_completed"]).drop(
            "app_id", "app_name", "event_ms", "execution_id", "description", "physical_plan", "join_plan", "exchange_bytes"
        )
    )
    return rollup.stage_rollup(
        eventlog.tasks(events), eventlog.stage_events(events), duration_skew=False
    ).drop("task_duration_skew_ratio")


def evt_apps(spark, sf):
    """The runs found in the logs."""
    events = eventlog.parse_events(telemetry.log_lines(spark, sf, _cores(spark)))
    return eventlog.apps(settled(events.select("kind", "run_key", "app_id", "app_name", "event_ms")))


def sql_durations(spark, sf):
    """Start and end events of SQL executions brought together."""
    lines = telemetry.sql_lines(spark, sf, _cores(spark))
    return eventlog.sql_executions(eventlog.parse_events(lines))


def plan_signals(spark, sf):
    """Operators mentioned in the plans, from JSON lines."""
    lines = telemetry.sql_lines(spark, sf, _cores(spark))
    return eventlog.sql_signals(eventlog.parse_events(lines))


def latest_runs(spark, sf):
    """The newest run of every app name."""
    return eventlog.latest_runs(telemetry.many_app_rows(spark, sf))


def find_run(spark, sf):
    """The newest run of one app name."""
    return eventlog.find_run(telemetry.many_app_rows(spark, sf), "job_7")


def latest_run(spark, sf):
    """The newest run among the names with a prefix."""
    return eventlog.latest_run(telemetry.many_app_rows(spark, sf), "job_1")


# --- roll-ups --------------------------------------------------------------------


def stage_rollup(spark, sf):
    """All figures of every stage."""
    return _stages(spark, sf, duration_skew=True)


def stage_rollup_succeeded(spark, sf):
    """The same without failed tasks."""
    return rollup.stage_rollup(
        telemetry.task_rows(spark, sf), exclude_failed=True, duration_skew=False
    ).select("run_key", "stage_id", "num_tasks", "total_shuffle_read_bytes", "shuffle_read_skew_ratio")


def stage_shuffle_skew(spark, sf):
    return rollup.stage_shuffle_skew(telemetry.task_rows(spark, sf))


def stage_duration_skew(spark, sf):
    return rollup.stage_duration_skew(telemetry.task_rows(spark, sf))


def app_rollup(spark, sf):
    """Totals of every application."""
    return rollup.app_rollup(_stages(spark, sf))


def combined_plans(spark, sf):
    """Plan texts of a run in start order, in parts."""
    return rollup.combined_plans(telemetry.sql_rows(spark, sf))


def run_summary(spark, sf):
    return rollup.run_summary(_metrics(spark, sf))


# --- rules ---------------------------------------------------------------------------


def _evidence(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings with their evidence as columns."""
    ids = [c for c in ("run_key", "stage_id", "execution_id") if c in findings.columns]
    return findings.select(
        *ids, "category", "severity", *[F.col("evidence")[key].alias(key) for key in keys]
    )


def detect_skew(spark, sf):
    found = rules.detect_skew(_stages(spark, sf))
    return _evidence(found, "skew_ratio", "num_tasks", "total_shuffle_read_bytes")


def detect_small_files(spark, sf):
    found = rules.detect_small_files(_stages(spark, sf))
    return _evidence(found, "num_tasks", "avg_input_bytes_per_task", "total_input_bytes")


def detect_missing_broadcast(spark, sf):
    return _evidence(rules.detect_missing_broadcast(_signals(spark, sf)))


def detect_missing_broadcast_final(spark, sf):
    """The same rule on the plans as executed."""
    return _evidence(rules.detect_missing_broadcast(_signals(spark, sf), use_final_plan=True))


# Bytes of a join's smaller side up to which the next query still reports it.
SIDE_BYTES = 50_000


def detect_missing_broadcast_sized(spark, sf):
    """The same rule with the bytes of the smaller side as evidence, without joins of two large sides."""
    lines = telemetry.sized_join_lines(spark, sf, _cores(spark))
    needed = ["kind", "run_key", "execution_id", "physical_plan", "join_plan", "failed", "exchange_bytes"]
    # Parsed once: plans are searched for operators and read as trees, and tasks are added up.
    events = settled(eventlog.parse_events(lines, ["sql_start", "task_end"]).select(*needed))
    signals = joinsides.with_join_sides(eventlog.sql_signals(events), events)
    found = rules.detect_missing_broadcast(signals, limits=rules.Thresholds(broadcast_side_bytes=SIDE_BYTES))
    return _evidence(found, "small_side_bytes")


def detect_missing_cache(spark, sf):
    found = rules.detect_missing_cache(_signals(spark, sf))
    return _evidence(found, "num_scanning_executions")


def detect_spill(spark, sf):
    found = rules.detect_spill(_stages(spark, sf))
    return _evidence(found, "memory_spilled_bytes", "disk_spilled_bytes")


def detect_serialization(spark, sf):
    found = rules.detect_serialization_overhead(_stages(spark, sf))
    return _evidence(found, "overhead_ratio")


def all_findings(spark, sf):
    """Findings of all rules with the app they belong to."""
    named = rules.with_app_name(_findings(spark, sf), telemetry.app_rows(spark, sf))
    return named.select(
        "run_key", "app_name", "detector_ord", "category", "severity", "stage_id", "execution_id", "message"
    )


def findings_listing(spark, sf):
    """Findings with their place in the listing of their run."""
    return rules.findings_listing(settled(_findings(spark, sf))).select(
        "run_key", "category", "stage_id", "execution_id", "listing_position"
    )


def finding_recommendations(spark, sf):
    """Every finding with the settings recommended for it."""
    return advice.recommend(_findings(spark, sf)).select(
        "run_key",
        "stage_id",
        "execution_id",
        "category",
        F.map_keys("spark_conf")[0].alias("conf_key"),
        F.map_values("spark_conf")[0].alias("conf_value"),
    )


def recommendations(spark, sf):
    """Each category once per run, in rule order."""
    return advice.recommendations_per_run(_findings(spark, sf)).select(
        "run_key", "category", "first_seen", "n_findings"
    )


# --- comparison ------------------------------------------------------------------------


def compare_metrics(spark, sf):
    pairs, apps = _compared(spark, sf)
    rows = compare.compare_metrics(pairs, apps, settled(_metrics(spark, sf)))
    return rows.select(
        "label",
        "report_name",
        "metric_ord",
        "metric",
        "baseline",
        "tuned",
        F.round(pct_change(F.col("baseline"), F.col("tuned")), 6).alias("pct"),
    )


def compare_findings(spark, sf):
    pairs, apps = _compared(spark, sf)
    found = compare.compare_findings(pairs, apps, _findings(spark, sf))
    return found.select(
        "label", "phase", "run_key", "category", "severity", "stage_id", "execution_id"
    )


def compare_recommendations(spark, sf):
    pairs, apps = _compared(spark, sf)
    fixes = compare.compare_recommendations(pairs, apps, _findings(spark, sf))
    return fixes.select("label", "report_name", "category", "first_seen", "n_findings")


def compare_suite(spark, sf):
    pairs, apps = _compared(spark, sf)
    metrics, findings = _settled_metrics_and_findings(spark, sf)
    return compare.compare_suite(pairs, apps, metrics, findings)


def pct_change_query(spark, sf):
    """Change of tax against discount per part, as a number."""
    per_part = _tax_and_discount(spark, sf)
    change = pct_change(F.col("discounts"), F.col("taxes"))
    return per_part.select("l_partkey", F.round(change, 6).alias("pct"))


def _tax_and_discount(spark: SparkSession, sf: str) -> DataFrame:
    def cents(name: str):
        return F.sum(F.floor(F.col(name) * 100 + 0.5))

    return telemetry.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        cents("l_discount").alias("discounts"), cents("l_tax").alias("taxes")
    )


# --- text ----------------------------------------------------------


def fmt_bytes_cases(spark, sf):
    """Bytes and changes as the reports print them."""
    stages = _stages(spark, sf)
    return stages.select(
        "run_key",
        "stage_id",
        fmt_bytes(F.col("total_shuffle_read_bytes")).alias("shuffle_read"),
        fmt_pct_change(
            F.col("total_shuffle_read_bytes"), F.col("total_shuffle_write_bytes")
        ).alias("change"),
    )


def single_run_report(spark, sf):
    """Lines of the report of every run."""
    return report.single_run_lines(*_settled_metrics_and_findings(spark, sf))


def single_run_report_files(spark, sf):
    """The same reports written as text files and read back, lines numbered in reading order."""
    path = shared_folder(spark, "reports")
    report.write_reports(single_run_report(spark, sf), path)
    return report.read_reports(spark, path)


def comparison_report(spark, sf):
    """Lines of the report of every pair."""
    pairs, apps = _compared(spark, sf)
    metrics, findings = _settled_metrics_and_findings(spark, sf)
    return report.comparison_lines(pairs, settled(apps), metrics, findings)


def suite_report(spark, sf):
    """Lines of the summary over all pairs."""
    return report.suite_lines(compare_suite(spark, sf))
