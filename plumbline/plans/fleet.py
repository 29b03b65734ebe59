"""From directories of event logs to findings, comparisons and reports.

Every step is written as a table below one folder before the next one reads it.
The logs are parsed once, the tasks rolled up once, and a step whose executors
are lost is all that has to be done again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import advice, compare, report, rollup, rules
from plumbline.sources import eventlog, joinsides


@dataclass(frozen=True)
class Fleet:
    """Tables about all runs below one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)


def diagnose(
    spark: SparkSession,
    logs: str | list[str],
    folder: str,
    limits: rules.Thresholds = rules.DEFAULTS,
    include_unfinished: bool = False,
    exclude_failed: bool = False,
    use_final_plan: bool = False,
    tolerate_cut_off: bool = False,
    skip_unreadable: bool = False,
) -> Fleet:
    """Read all logs and write ``events, apps, stages, signals, metrics, findings``
    and ``recommendations`` below ``folder``; with ``skip_unreadable`` also ``unreadable``.

    Events are kept of all logs; every other table is of the runs that ``apps`` names."""
    fleet = Fleet(spark, folder.rstrip("/"))
    events = eventlog.ingest(
        spark,
        logs,
        f"{fleet.folder}/events",
        include_unfinished,
        tolerate_cut_off=tolerate_cut_off,
        skip_unreadable=skip_unreadable,
    )
    if skip_unreadable:
        fleet._save("unreadable", eventlog.unreadable_logs(spark, logs, include_unfinished))
    apps = fleet._save("apps", eventlog.apps(events, include_unfinished))
    events = eventlog.of_runs(events, apps)
    stages = fleet._save(
        "stages",
        rollup.stage_rollup(eventlog.tasks(events), eventlog.stage_events(events), exclude_failed),
    )
    signals = fleet._save("signals", joinsides.with_join_sides(eventlog.sql_signals(events), events))
    fleet._save("metrics", rollup.app_metrics(apps, stages))
    found = rules.all_findings(stages, signals, limits, use_final_plan)
    findings = fleet._save("findings", rules.with_app_name(found, apps))
    fleet._save("recommendations", advice.recommendations_per_run(findings))
    return fleet


def compare_pairs(fleet: Fleet, pairs: DataFrame) -> None:
    """Write ``comparison`` and ``suite`` for pairs of app names."""
    apps, metrics, findings = (fleet.table(n) for n in ("apps", "metrics", "findings"))
    fleet._save("comparison", compare.compare_metrics(pairs, apps, metrics))
    fleet._save("suite", compare.compare_suite(pairs, apps, metrics, findings))


def write_run_reports(fleet: Fleet, app_name: str | None = None) -> None:
    """Write the report of every run, or of the newest run of one app."""
    metrics, findings = fleet.table("metrics"), fleet.table("findings")
    if app_name is not None:
        chosen = eventlog.find_run(fleet.table("apps"), app_name).select("run_key")
        metrics = metrics.join(chosen, "run_key", "left_semi")
        findings = findings.join(chosen, "run_key", "left_semi")
    report.write_reports(report.single_run_lines(metrics, findings), f"{fleet.folder}/run_reports")


def write_pair_reports(fleet: Fleet, pairs: DataFrame) -> None:
    """Write the report of every pair and the summary over all of them."""
    apps, metrics, findings = (fleet.table(n) for n in ("apps", "metrics", "findings"))
    lines = report.comparison_lines(pairs, apps, metrics, findings)
    report.write_reports(lines, f"{fleet.folder}/pair_reports")
    suite = compare.compare_suite(pairs, apps, metrics, findings)
    (
        report.suite_lines(suite)
        .repartitionByRange("label", "line_no")
        .sortWithinPartitions("label", "line_no")
        .select("line")
        .write.mode("overwrite")
        .text(f"{fleet.folder}/summary")
    )
