"""The whole way from logs that Spark wrote to reports, in both log layouts."""

import glob
import io
import json
import os
import subprocess
import sys

import jobs
import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.plans import fleet
from plumbline.sources import eventlog, generate

RUNS = [
    ("skewed_join", "baseline", "rolling"),
    ("skewed_join", "tuned", "plain"),
    ("missing_cache", "baseline", "plain"),
    ("missing_cache", "tuned", "rolling"),
]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("real")
    tables, folder = str(root / "tables"), root / "logs"
    folder.mkdir()
    generate.write_tables(spark, tables, scale=0.01)
    script = os.path.abspath(jobs.__file__)
    for job, mode, log_layout in RUNS:
        command = [sys.executable, script, job, mode, tables, str(folder), log_layout]
        subprocess.run(command, check=True, timeout=300, capture_output=True)
    return str(folder)


@pytest.fixture(scope="module")
def result(spark, logs, tmp_path_factory):
    return fleet.diagnose(spark, logs, str(tmp_path_factory.mktemp("fleet") / "out"))


def lines_of(path):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    return [json.loads(line) for line in raw.decode().splitlines()]


def test_both_layouts_are_there(logs):
    assert len(glob.glob(f"{logs}/eventlog_v2_*/events_1_*.zstd")) == 2
    assert len([p for p in glob.glob(f"{logs}/*") if os.path.isfile(p)]) == 2


def test_counts_agree_with_the_lines(logs, result):
    expected = {}
    files = [p for p in glob.glob(f"{logs}/**", recursive=True) if os.path.isfile(p)]
    for path in files:
        events = lines_of(path) if os.path.getsize(path) else []
        names = [e["App Name"] for e in events if e["Event"] == "SparkListenerApplicationStart"]
        if names:
            ends = [e for e in events if e["Event"] == "SparkListenerTaskEnd"]
            starts = [e for e in events if e["Event"].endswith("SQLExecutionStart")]
            run_time = sum(e["Task Metrics"]["Executor Run Time"] for e in ends)
            expected[names[0]] = (len(ends), run_time, len({e["Stage ID"] for e in ends}), len(starts))
    sql = result.table("signals").groupBy("run_key").agg(F.count(F.lit(1)).alias("n_sql"))
    found = result.table("metrics").join(sql, "run_key").collect()
    got = {
        r.app_name: (r.total_tasks, r.total_executor_run_time_ms, r.n_stages, r.n_sql) for r in found
    }
    assert got == expected and len(got) == 4


def test_findings_name_the_fault_and_go_with_the_fix(result):
    found = {(r.app_name, r.category) for r in result.table("findings").collect()}
    assert ("skewed_join_baseline", "skew") in found
    assert ("skewed_join_tuned", "skew") not in found
    assert ("skewed_join_baseline", "missing_broadcast") in found
    assert ("missing_cache_baseline", "missing_cache") in found
    assert ("missing_cache_tuned", "missing_cache") not in found


def test_declared_schemas(result):
    for name, schema in (("stages", schemas.STAGES), ("apps", schemas.APPS)):
        assert result.table(name).schema.simpleString() == schema.simpleString()


def test_comparison_and_reports(spark, result):
    pairs = spark.createDataFrame(jobs.PAIRS, schemas.PAIRS)
    fleet.compare_pairs(result, pairs)
    suite = {r.label: r for r in result.table("suite").collect()}
    assert {label: r.status for label, r in suite.items()} == {
        "Skewed join": "compared", "Missing cache": "compared",
        "Small files": "skipped", "Missing broadcast": "skipped",
    }
    assert suite["Skewed join"].has_skew_note
    assert suite["Skewed join"].baseline_skew_ratio > suite["Skewed join"].tuned_skew_ratio

    fleet.write_pair_reports(result, pairs)
    fleet.write_run_reports(result, "skewed_join_baseline")

    def text(pattern):
        return "".join(open(p).read() for p in sorted(glob.glob(f"{result.folder}/{pattern}")))

    report = text("pair_reports/report=skewed_join/*.txt")
    assert report.startswith("# Skewed join: baseline and tuned\n")
    assert report.rstrip().endswith("which salting raises.")
    assert "_skipped: no event log of small_files_baseline_" in text("summary/*.txt")
    assert len(glob.glob(f"{result.folder}/run_reports/report=*")) == 1
    assert "# Spark application skewed_join_baseline" in text("run_reports/*/*.txt")


def test_final_plans_are_found(spark, result):
    events = spark.read.parquet(f"{result.folder}/events")
    plans = eventlog.sql_executions(events).join(result.table("apps"), "run_key")
    adaptive = plans.where("app_name = 'missing_cache_baseline'").collect()
    assert len(adaptive) == 4  # measuring the customers is one execution, the results are three
    assert all(p.final_plan and "Initial Plan" not in p.final_plan for p in adaptive)


def test_an_unfinished_log_is_left_out(spark, result):
    """This session's own log is still being written."""
    own = spark.conf.get("spark.eventLog.dir")
    assert eventlog.apps(eventlog.parse_events(eventlog.read_log_lines(spark, own))).count() == 0
    everything = eventlog.parse_events(eventlog.read_log_lines(spark, own, include_unfinished=True))
    assert eventlog.apps(everything, include_unfinished=True).first().app_name == "plumbline-tests"
