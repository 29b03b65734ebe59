"""Markdown reports as tables of ordered lines.

A report is never gathered into one value: a run with millions of findings is as
long a table as it needs to be.  ``write_reports`` range-partitions the lines, so
a long report becomes several files that follow each other in name order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.formatting import fmt_bytes, fmt_fixed
from plumbline.operators.advice import recommendations_per_run
from plumbline.operators.compare import (
    COMPARED,
    compare_findings,
    compare_metrics,
    compare_recommendations,
    compare_suite,
)

LINE_ORDER = ["report", "label", "section", "item", "sub_item", "line_no"]


def _text(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _lines(
    df: DataFrame,
    report: str,
    section: int,
    texts: list[Column | str] | Column,
    item: Column | None = None,
    sub_item: Column | None = None,
) -> DataFrame:
    """One row per text and input row; null texts give no line.

    Pairs may share a report name, so lines of pairs are kept apart by label.
    """
    if isinstance(texts, list):
        texts = F.array_compact(F.array(*[_text(t) for t in texts]))
    zero = F.lit(0)
    return df.select(
        F.col(report).alias("report"),
        (F.col("label") if "label" in df.columns else F.lit("")).alias("label"),
        F.lit(section).alias("section"),
        (zero if item is None else item).cast("bigint").alias("item"),
        (zero if sub_item is None else sub_item).cast("bigint").alias("sub_item"),
        F.posexplode(texts).alias("line_no", "line"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return lines


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def _finding_text(with_stage: bool) -> Column:
    stage = F.lit("")
    if with_stage:
        named = F.format_string(" (stage %d)", "stage_id")
        stage = F.when(F.col("stage_id").isNotNull(), named).otherwise("")
    return F.concat(
        F.lit("- **["), F.upper("severity"), F.lit("] "), F.col("category"), F.lit("**"),
        stage, F.lit(": "), F.col("message"),
    )


def _within_rule() -> Column:
    return F.coalesce(F.col("stage_id").cast("bigint"), F.col("execution_id"), F.lit(0))


def single_run_lines(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """The report of each run; ``metrics`` is ``app_metrics``."""
    counts = findings.groupBy("run_key").agg(F.count(F.lit(1)).alias("n_findings"))
    runs = metrics.join(counts, "run_key", "left").fillna(0, ["n_findings"])
    found = F.col("n_findings") > 0
    spill = F.col("total_memory_spilled") + F.col("total_disk_spilled")
    head = [
        F.concat(F.lit("# Spark application "), F.col("app_name")),
        "",
        "## Summary",
        _labelled("Stages", F.col("n_stages")),
        _labelled("Tasks", F.col("total_tasks")),
        _labelled("Shuffle read", fmt_bytes(F.col("total_shuffle_read_bytes"))),
        _labelled("Shuffle written", fmt_bytes(F.col("total_shuffle_write_bytes"))),
        _labelled("Spilled", fmt_bytes(spill)),
        "",
        F.when(found, "## Findings").otherwise("No rule found anything."),
    ]
    after_findings = [F.when(found, ""), F.when(found, "## Recommendations")]

    settings = F.transform(
        F.map_entries("spark_conf"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])
    )
    nothing = F.array().cast("array<string>")
    settings_block = F.when(
        F.col("spark_conf").isNotNull(),
        F.concat(_array("", "Settings:", "```"), settings, _array("```")),
    ).otherwise(nothing)
    code_block = F.when(
        F.col("code_change").isNotNull(),
        F.concat(_array("", "Code:", "```python"), F.array("code_change"), _array("```")),
    ).otherwise(nothing)
    advice = F.concat(
        F.array(F.concat(F.lit("### "), F.col("title")), F.col("detail")),
        settings_block,
        code_block,
        _array(""),
    )
    return _union([
        _lines(runs, "run_key", 0, head),
        _lines(findings, "run_key", 1, [_finding_text(True)], F.col("detector_ord"), _within_rule()),
        _lines(runs, "run_key", 2, after_findings),
        _lines(recommendations_per_run(findings), "run_key", 3, advice, F.col("first_seen")),
    ])


def _array(*texts: str) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def comparison_lines(
    pairs: DataFrame, apps: DataFrame, metrics: DataFrame, findings: DataFrame
) -> DataFrame:
    """The before-and-after report of each compared pair."""
    suite = compare_suite(pairs, apps, metrics, findings).where(F.col("status") == COMPARED)
    both = compare_findings(pairs, apps, findings)
    rows = compare_metrics(pairs, apps, metrics)
    fixes = compare_recommendations(pairs, apps, findings)

    none_found = "- none"
    before = [
        F.concat(F.lit("# "), F.col("label"), F.lit(": baseline and tuned")),
        "",
        "## Findings in the baseline",
        F.when(F.col("baseline_findings") == 0, none_found),
    ]
    after = ["", "## Findings in the tuned run", F.when(F.col("tuned_findings") == 0, none_found)]
    table_head = ["", "## Metrics", "| metric | baseline | tuned | change |", "|---|---|---|---|"]
    table_row = F.concat(
        F.lit("| "), F.concat_ws(" | ", "metric", "baseline_disp", "tuned_disp", "change"), F.lit(" |")
    )
    fixed = F.col("baseline_findings") > 0
    fixes_head = [F.when(fixed, ""), F.when(fixed, "## What fixed it")]
    fix = F.concat(F.lit("- **"), F.col("title"), F.lit("**: "), F.col("detail"))

    note = F.concat(
        F.lit("largest / median shuffle read: "), _ratio("baseline_skew_ratio"), F.lit(" -> "), _ratio("tuned_skew_ratio"),
        F.lit("; longest task, ms: "), F.col("baseline_longest_task_ms").cast("string"),
        F.lit(" -> "), F.col("tuned_longest_task_ms").cast("string"),
        F.lit(". Read both beside the summed executor time, which salting raises."),
    )
    skewed = F.col("has_skew_note")
    skew_note = [F.when(skewed, t) for t in ("", "## About the longest task")]
    skew_note.append(F.when(skewed, note))

    def findings_of(phase: str, section: int) -> DataFrame:
        chosen = both.where(F.col("phase") == phase)
        text = [_finding_text(False)]
        return _lines(chosen, "report_name", section, text, F.col("detector_ord"), _within_rule())

    return _union([
        _lines(suite, "report_name", 0, before),
        findings_of("before", 1),
        _lines(suite, "report_name", 2, after),
        findings_of("after", 3),
        _lines(suite, "report_name", 4, table_head),
        _lines(rows, "report_name", 5, [table_row], F.col("metric_ord")),
        _lines(suite, "report_name", 6, fixes_head),
        _lines(fixes, "report_name", 7, [fix], F.col("first_seen")),
        _lines(suite, "report_name", 8, skew_note),
    ])


def _ratio(name: str) -> Column:
    return F.coalesce(F.concat(fmt_fixed(F.col(name), 1), F.lit("x")), F.lit("n/a"))


def suite_lines(suite: DataFrame) -> DataFrame:
    """A summary of all pairs, ordered by label; ``suite`` is ``compare_suite``."""
    outcome = F.when(
        F.col("status") == COMPARED,
        F.concat(F.lit("See `"), F.col("report_name"), F.lit("`")),
    ).otherwise(F.concat(F.lit("_skipped: no event log of "), F.col("missing_app"), F.lit("_")))
    return suite.select(
        "label",
        F.posexplode(
            F.array(F.concat(F.lit("## "), F.col("label")), outcome, F.lit(""))
        ).alias("line_no", "line"),
    )


def write_reports(lines: DataFrame, path: str) -> None:
    """Write each report as text files below ``path/report=<name>``.

    File names ascend with the lines, so listing order is reading order.
    """
    (
        lines.repartitionByRange(*LINE_ORDER)
        .sortWithinPartitions(*LINE_ORDER)
        .select("report", "line")
        .write.mode("overwrite")
        .partitionBy("report")
        .text(path)
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``report, line_no, line``: reports that ``write_reports`` wrote, in reading order from 0.

    A file holds a bounded range of a report; what its lines count from is a running sum over the
    report's files, not over its lines.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("report").cast("string").alias("report"),
        F.col("_metadata.file_name").alias("file"),
        # Every line ends with a line feed, the last one too.
        F.split(F.regexp_replace("value", "\n\\z", ""), "\n").alias("lines"),
    )
    earlier = Window.partitionBy("report").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("report", "file", F.coalesce(F.sum(F.size("lines")).over(earlier), F.lit(0)).alias("first"))
    lines = files.select("report", "file", F.posexplode("lines").alias("place", "line"))
    return lines.join(sizes, ["report", "file"]).select("report", (F.col("first") + F.col("place")).alias("line_no"), "line")
