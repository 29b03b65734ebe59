import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import compare, report
from plumbline.operators.advice import RECOMMENDATIONS
from plumbline.plans import queries

APPS = [
    ("r1", "1", "a_baseline", "r1", 10, True),
    ("r0", "0", "a_baseline", "r0", 5, True),
    ("r2", "2", "a_tuned", "r2", 20, True),
    ("r3", "3", "b_baseline", "r3", 20, True),
    ("r4", "4", "b_tuned", "r4", 20, True),
]
PAIRS = [("A", "a_baseline", "a_tuned"), ("B", "b_baseline", "b_tuned"), ("C", "c_baseline", "b_tuned")]
METRICS = (
    "run_key string, app_name string, n_stages bigint, total_tasks bigint, "
    "total_shuffle_read_bytes bigint, total_shuffle_write_bytes bigint, total_memory_spilled bigint, "
    "total_disk_spilled bigint, total_executor_run_time_ms bigint, max_task_run_time_ms bigint, "
    "worst_skew_ratio double"
)


@pytest.fixture(scope="module")
def frames(spark):
    metrics = [
        ("r0", "a_baseline", 1, 1, 1, 1, 1, 1, 1, 1, 99.0),
        ("r1", "a_baseline", 2, 15, 52_428_800, 2048, 0, 0, 5598, 734, 1.1),
        ("r2", "a_tuned", 1, 11, 1280, 2048, 0, 0, 2513, 378, None),
        ("r3", "b_baseline", 1, 4, 0, 0, 3, 4, 10, 10, None),
        ("r4", "b_tuned", 1, 4, 9, 0, 0, 0, 10, 10, None),
    ]
    findings = [
        ("r1", 3, "missing_broadcast", "high", None, 0, "m0", {}),
        ("r1", 1, "skew", "medium", 4, None, "m1", {}),
        ("r1", 1, "skew", "high", 2, None, "m2", {}),
        ("r4", 5, "spill", "medium", 1, None, "m3", {}),
    ]
    return {
        "pairs": spark.createDataFrame(PAIRS, schemas.PAIRS),
        "apps": spark.createDataFrame(APPS, schemas.APPS),
        "metrics": spark.createDataFrame(metrics, METRICS),
        "findings": spark.createDataFrame(findings, schemas.FINDINGS),
    }


def lines_of(df, name):
    return [r.line for r in df.where(F.col("report") == name).orderBy(*report.LINE_ORDER).collect()]


def test_pairs_take_the_newest_run(frames):
    rows = {r.label: r for r in compare.paired_runs(frames["pairs"], frames["apps"]).collect()}
    assert (rows["A"].baseline_run, rows["A"].tuned_run, rows["A"].status) == ("r1", "r2", "compared")
    assert (rows["C"].status, rows["C"].missing_app, rows["C"].report_name) == ("skipped", "c_baseline", "c")


def test_metric_rows(frames):
    rows = compare.compare_metrics(frames["pairs"], frames["apps"], frames["metrics"])
    shown = {
        (r.label, r.metric): (r.baseline_disp, r.tuned_disp, r.change)
        for r in rows.orderBy("metric_ord").collect()
    }
    assert shown == {
        ("A", "tasks"): ("15", "11", "↓27%"),
        ("A", "shuffle_read_bytes"): ("50.0MB", "1.2KB", "↓100%"),
        ("A", "shuffle_write_bytes"): ("2.0KB", "2.0KB", "↑0%"),
        ("A", "spill_bytes"): ("0.0B", "0.0B", "n/a"),
        ("A", "executor_run_time_ms"): ("5598", "2513", "↓55%"),
        ("A", "longest_task_ms"): ("734", "378", "↓49%"),
        ("A", "worst_skew_ratio"): ("1.1x", "n/a", "↓100%"),
        ("B", "tasks"): ("4", "4", "↑0%"),
        ("B", "shuffle_read_bytes"): ("0.0B", "9.0B", "new"),
        ("B", "shuffle_write_bytes"): ("0.0B", "0.0B", "n/a"),
        ("B", "spill_bytes"): ("7.0B", "0.0B", "↓100%"),
        ("B", "executor_run_time_ms"): ("10", "10", "↑0%"),
        ("B", "longest_task_ms"): ("10", "10", "↑0%"),
    }


def test_skew_only_in_the_tuned_run(spark, frames):
    swapped = spark.createDataFrame([("S", "a_tuned", "a_baseline")], schemas.PAIRS)
    rows = compare.compare_metrics(swapped, frames["apps"], frames["metrics"])
    skew = rows.where("metric = 'worst_skew_ratio'").first()
    assert (skew.baseline_disp, skew.tuned_disp, skew.change) == ("n/a", "1.1x", "n/a")


def test_single_run_report(frames):
    lines = lines_of(report.single_run_lines(frames["metrics"], frames["findings"]), "r1")
    assert lines[:15] == [
        "# Spark application a_baseline",
        "",
        "## Summary",
        "- Stages: 2",
        "- Tasks: 15",
        "- Shuffle read: 50.0MB",
        "- Shuffle written: 2.0KB",
        "- Spilled: 0.0B",
        "",
        "## Findings",
        "- **[HIGH] skew** (stage 2): m2",
        "- **[MEDIUM] skew** (stage 4): m1",
        "- **[HIGH] missing_broadcast**: m0",
        "",
        "## Recommendations",
    ]
    advice = {r[0]: r for r in RECOMMENDATIONS}
    assert lines[15:27] == [
        "### " + advice["skew"][1], advice["skew"][2],
        "", "Settings:", "```", "spark.sql.adaptive.skewJoin.enabled = true", "```",
        "", "Code:", "```python", advice["skew"][4], "```",
    ]
    assert lines[28] == "### " + advice["missing_broadcast"][1]
    assert len([x for x in lines if x.startswith("### ")]) == 2


def test_single_run_report_without_findings(frames):
    lines = lines_of(report.single_run_lines(frames["metrics"], frames["findings"]), "r3")
    assert lines[-1] == "No rule found anything." and len(lines) == 10
    assert "- Spilled: 7.0B" in lines


def test_recommendation_without_settings_or_code(spark, frames):
    found = spark.createDataFrame(
        [("r3", 4, "missing_cache", "medium", None, None, "m", {}), ("r3", 5, "spill", "high", 1, None, "m", {})],
        schemas.FINDINGS,
    )
    lines = lines_of(report.single_run_lines(frames["metrics"], found), "r3")
    cache = lines.index("### " + RECOMMENDATIONS[3][1])
    assert lines[cache + 2 : cache + 5] == ["", "Code:", "```python"]
    spill = lines.index("### " + RECOMMENDATIONS[4][1])
    assert lines[spill + 2 :] == ["", "Settings:", "```", "spark.sql.shuffle.partitions = <increase from current value>", "```", ""]


def test_comparison_report(frames):
    all_lines = report.comparison_lines(**frames)
    lines = lines_of(all_lines, "a")
    assert lines[:13] == [
        "# A: baseline and tuned",
        "",
        "## Findings in the baseline",
        "- **[HIGH] skew**: m2",
        "- **[MEDIUM] skew**: m1",
        "- **[HIGH] missing_broadcast**: m0",
        "",
        "## Findings in the tuned run",
        "- none",
        "",
        "## Metrics",
        "| metric | baseline | tuned | change |",
        "|---|---|---|---|",
    ]
    assert lines[13] == "| tasks | 15 | 11 | ↓27% |"
    assert lines[19] == "| worst_skew_ratio | 1.1x | n/a | ↓100% |"
    assert lines[20:22] == ["", "## What fixed it"]
    assert [x.split("**")[1] for x in lines[22:24]] == [RECOMMENDATIONS[0][1], RECOMMENDATIONS[2][1]]
    assert lines[24:26] == ["", "## About the longest task"]
    assert "1.1x -> n/a" in lines[26] and "longest task, ms: 734 -> 378" in lines[26]

    other = lines_of(all_lines, "b")
    assert other[3] == "- none" and "## What fixed it" not in other
    assert "## About the longest task" not in other and "- **[MEDIUM] spill**: m3" in other
    assert all_lines.select("report").distinct().count() == 2


def test_pairs_of_one_baseline_follow_each_other(spark, frames):
    pairs = [("First", "a_baseline", "a_tuned"), ("Second", "a_baseline", "b_tuned")]
    both = {**frames, "pairs": spark.createDataFrame(pairs, schemas.PAIRS)}
    lines = lines_of(report.comparison_lines(**both), "a")
    second = lines.index("# Second: baseline and tuned")
    assert lines[0] == "# First: baseline and tuned"
    assert "- none" in lines[:second] and "- **[MEDIUM] spill**: m3" in lines[second:]
    assert [x for x in lines if x.startswith("| tasks")] == [
        "| tasks | 15 | 11 | ↓27% |", "| tasks | 15 | 4 | ↓73% |",
    ]


def test_suite(frames):
    suite = compare.compare_suite(**{k: frames[k] for k in ("pairs", "apps", "metrics", "findings")})
    rows = {r.label: r for r in suite.collect()}
    assert (rows["A"].baseline_findings, rows["A"].tuned_findings, rows["A"].has_skew_note) == (3, 0, True)
    assert (rows["C"].status, rows["C"].baseline_findings, rows["C"].tuned_findings) == ("skipped", None, None)
    lines = [r.line for r in report.suite_lines(suite).orderBy("label", "line_no").collect()]
    assert lines == [
        "## A", "See `a`", "", "## B", "See `b`", "", "## C", "_skipped: no event log of c_baseline_", "",
    ]


def test_reports_on_disk(spark, frames, tmp_path):
    lines = report.single_run_lines(frames["metrics"], frames["findings"])
    report.write_reports(lines, str(tmp_path / "out"))
    folder = tmp_path / "out" / "report=r1"
    text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.endswith(".txt"))
    assert text == "\n".join(lines_of(lines, "r1")) + "\n"


def test_formatted_telemetry(spark):
    rows = queries()["fmt_bytes_cases"](spark, SMALL).collect()
    assert rows and all(r.shuffle_read[-1] == "B" and r.change[-1] == "%" for r in rows)
