import json

import pytest

from plumbline import schemas
from plumbline.operators.rollup import app_metrics, combined_plans, stage_rollup
from plumbline.sources import eventlog

SQL = "org.apache.spark.sql.execution.ui.SparkListenerSQL"


def task(stage=1, **over):
    event = {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage,
        "Stage Attempt ID": 0,
        "Task End Reason": {"Reason": "Success"},
        "Task Info": {"Task ID": 9, "Launch Time": 100, "Finish Time": 250},
        "Task Metrics": {
            "Executor Run Time": 120,
            "Shuffle Read Metrics": {"Remote Bytes Read": 30, "Local Bytes Read": 12},
            "Input Metrics": {"Bytes Read": 77},
        },
    }
    event.update(over)
    return {k: v for k, v in event.items() if v != "absent"}


@pytest.fixture
def parse(spark):
    def run(*events):
        lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
        df = spark.createDataFrame([("r", line) for line in lines], "run_key string, value string")
        return eventlog.parse_events(df)

    return run


def one_task(parse, event):
    rows = eventlog.tasks(parse(event)).collect()
    assert len(rows) == 1
    return rows[0]


def test_task_fields(parse):
    row = one_task(parse, task())
    assert row.asDict() == {
        "run_key": "r", "stage_id": 1, "stage_attempt": 0, "task_id": 9, "duration_ms": 150,
        "executor_run_time_ms": 120, "executor_deserialize_time_ms": 0,
        "result_serialization_time_ms": 0, "gc_time_ms": 0, "memory_bytes_spilled": 0,
        "disk_bytes_spilled": 0, "shuffle_read_bytes": 42, "shuffle_read_records": 0,
        "shuffle_write_bytes": 0, "input_bytes": 77, "failed": False,
    }


def test_schema_is_the_declared_one(parse):
    assert eventlog.tasks(parse(task())).schema.simpleString() == schemas.TASKS.simpleString()


@pytest.mark.parametrize(
    "line",
    [
        "",
        "   ",
        '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task In',
        '["SparkListenerTaskEnd"]',
        '"SparkListenerTaskEnd"',
        '{"Event":"SparkListenerSomethingNew","Stage ID":1}',
        '{"Event":"SparkListenerBlockManagerAdded","note":"SparkListenerTaskEnd"}',
    ],
)
def test_lines_left_out(parse, line):
    assert parse(line).count() == 0


def test_spacing_does_not_matter(parse):
    assert eventlog.tasks(parse(json.dumps(task(), indent=None, separators=(" , ", " : ")))).count() == 1


def test_task_without_stage_is_left_out(parse):
    assert eventlog.tasks(parse(task(**{"Stage ID": "absent"}))).count() == 0


@pytest.mark.parametrize("metrics", [None, "absent"])
def test_failed_task_without_metrics_counts(parse, metrics):
    event = task(**{"Task Metrics": metrics, "Task End Reason": {"Reason": "ExceptionFailure"}})
    row = one_task(parse, event)
    assert row.failed and row.executor_run_time_ms == 0 and row.shuffle_read_bytes == 0


@pytest.mark.parametrize("reason", [None, "absent", {}])
def test_missing_reason_is_failure(parse, reason):
    assert one_task(parse, task(**{"Task End Reason": reason})).failed


def test_finish_before_launch(parse):
    info = {"Task ID": 1, "Launch Time": 300, "Finish Time": 200}
    assert one_task(parse, task(**{"Task Info": info})).duration_ms == 0


def test_missing_task_id(parse):
    assert one_task(parse, task(**{"Task Info": {"Launch Time": 1, "Finish Time": 3}})).task_id == -1
    assert one_task(parse, task(**{"Task Info": None})).task_id == -1


def stage(kind, sid=1, name="s", **times):
    info = {"Stage ID": sid, "Stage Attempt ID": 0, "Stage Name": name, **times}
    return {"Event": f"SparkListenerStage{kind}", "Stage Info": info}


def rolled(events):
    return {
        r.stage_id: r
        for r in stage_rollup(eventlog.tasks(events), eventlog.stage_events(events)).collect()
    }


def test_stage_known_from_any_event(parse):
    stages = rolled(
        parse(
            task(stage=1),
            stage("Submitted", 2, **{"Submission Time": 10}),
            stage("Completed", 3, **{"Submission Time": 20, "Completion Time": 50}),
        )
    )
    assert sorted(stages) == [1, 2, 3]
    assert stages[1].name == "" and stages[1].num_tasks == 1
    assert stages[2].duration_ms is None and stages[2].num_tasks == 0
    assert stages[3].submission_time_ms == 20 and stages[3].duration_ms == 30
    assert stages[3].shuffle_read_skew_ratio is None and stages[3].total_input_bytes == 0


def test_submission_event_goes_before_completion(parse):
    stages = rolled(
        parse(
            stage("Submitted", 1, name="real", **{"Submission Time": 10}),
            stage("Completed", 1, name="real", **{"Submission Time": 12, "Completion Time": 50}),
        )
    )
    assert stages[1].submission_time_ms == 10 and stages[1].name == "real"


def test_attempts_count_together(parse):
    stages = rolled(parse(task(), task(**{"Stage Attempt ID": 1})))
    assert stages[1].num_tasks == 2


def sql_start(eid, plan="p", time=100, **more):
    return {"Event": SQL + "ExecutionStart", "executionId": eid, "description": "d",
            "physicalPlanDescription": plan, "time": time, **more}


def sql_end(eid, time):
    return {"Event": SQL + "ExecutionEnd", "executionId": eid, "time": time}


def test_sql_executions(parse):
    events = parse(sql_start(0), sql_end(0, 130), sql_start(1), sql_end(2, 900))
    rows = {r.execution_id: r for r in eventlog.sql_executions(events).collect()}
    assert sorted(rows) == [0, 1]
    assert rows[0].duration_ms == 30 and rows[1].duration_ms is None
    assert rows[0].final_plan is None
    assert eventlog.sql_executions(events).schema.simpleString() == schemas.SQL_EXECUTIONS.simpleString()


def test_final_plan_is_cut_from_the_update(parse):
    final = "+- BroadcastHashJoin (2)\n   +- Scan parquet (1)"
    text = (
        "== Physical Plan ==\nAdaptiveSparkPlan (9)\n+- == Final Plan ==\n   " + final
        + "\n+- == Initial Plan ==\n   SortMergeJoin (5)\n\n(5) SortMergeJoin\n"
    )
    current = text.replace("Final Plan", "Current Plan")
    update = {"Event": SQL + "AdaptiveExecutionUpdate", "executionId": 0}
    events = parse(
        sql_start(0, plan="SortMergeJoin (5)"),
        {**update, "physicalPlanDescription": current},
        {**update, "physicalPlanDescription": text},
    )
    row = eventlog.sql_executions(events).first()
    assert row.final_plan.strip() == final
    signals = eventlog.sql_signals(events).first()
    assert signals.has_sort_merge_join and not signals.has_broadcast_join
    assert signals.final_has_broadcast_join and not signals.final_has_sort_merge_join
    of_rows = eventlog.signals_of(eventlog.sql_executions(events)).first()
    assert of_rows == signals


def test_unknown_app_and_empty_run(parse):
    events = parse(task())
    row = app_metrics(eventlog.apps(events), stage_rollup(eventlog.tasks(events))).first()
    assert (row.app_name, row.app_id, row.n_stages, row.total_tasks) == ("unknown", "unknown", 1, 1)
    only_start = parse({"Event": "SparkListenerApplicationStart", "App Name": "a", "App ID": "1", "Timestamp": 5})
    row = app_metrics(eventlog.apps(only_start), stage_rollup(eventlog.tasks(only_start))).first()
    assert (row.app_name, row.n_stages, row.worst_skew_ratio) == ("a", 0, None)


def test_plans_join_in_start_order_across_parts(spark, parse):
    plans = eventlog.sql_executions(parse(*[sql_start(i, plan=f"plan {i}", time=i) for i in range(7)]))
    parts = combined_plans(plans, per_part=3).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2]
    assert "\n---\n".join(p.plans for p in parts) == "\n---\n".join(f"plan {i}" for i in range(7))


def test_run_key(spark):
    paths = ["file:/l/app-1", "file:/l/eventlog_v2_app-2/events_1_app-2.zstd", "file:/m/eventlog_v2_x/events_2_x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    keys = [r.k for r in df.select(eventlog.run_key_of(df.p).alias("k")).collect()]
    assert keys == ["file:/l/app-1", "file:/l/eventlog_v2_app-2", "file:/m/eventlog_v2_x"]


def test_layouts_and_unfinished_logs(spark, tmp_path):
    start = {"Event": "SparkListenerApplicationStart", "App Name": "n", "App ID": "i", "Timestamp": 1}
    end = {"Event": "SparkListenerApplicationEnd", "Timestamp": 2}

    def write(name, *events):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(json.dumps(e) for e in events))

    write("plain", start, task())
    write("plain2.inprogress", start, task())
    write("eventlog_v2_done/events_1_done", start, task())
    write("eventlog_v2_done/events_2_done", task(), end)
    write("eventlog_v2_done/appstatus_done")
    write("eventlog_v2_open/events_1_open", start, task())
    write("eventlog_v2_open/appstatus_open.inprogress")

    def names(include):
        events = eventlog.ingest(spark, str(tmp_path), str(tmp_path) + "-out", include)
        apps = eventlog.apps(events, include_unfinished=include)
        counts = eventlog.tasks(events).groupBy("run_key").count()
        return {
            r.run_key.rsplit("/", 1)[1]: r["count"] for r in apps.join(counts, "run_key").collect()
        }

    assert names(False) == {"plain": 1, "eventlog_v2_done": 2}
    assert names(True) == {
        "plain": 1, "eventlog_v2_done": 2, "plain2.inprogress": 1, "eventlog_v2_open": 1,
    }


def test_ingested_events_prune_by_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log").write_text(json.dumps(task()) + "\n" + json.dumps(sql_start(0)))
    events = eventlog.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    plan = eventlog.tasks(events)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "physical_plan" not in plan


def test_a_folder_without_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = eventlog.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert eventlog.apps(events).count() == 0
    assert stage_rollup(eventlog.tasks(events), eventlog.stage_events(events)).count() == 0
    assert eventlog.sql_signals(events).count() == 0


def test_large_compressed_logs_are_read_whole(spark, tmp_path):
    """Texts that hardly compress, so that each log is larger than a usual split."""
    import os
    import random

    import zstandard

    rng = random.Random(5)
    logs = tmp_path / "logs" / "eventlog_v2_big"
    logs.mkdir(parents=True)
    for part in (1, 2):
        lines = [
            json.dumps(sql_start(1000 * part + i, plan=f"SortMergeJoin {rng.randbytes(20_000).hex()}"))
            for i in range(500)
        ]
        end = json.dumps({"Event": "SparkListenerApplicationEnd", "Timestamp": 2})
        text = "\n".join([*lines, end]).encode()
        (logs / f"events_{part}_big.zstd").write_bytes(zstandard.compress(text))
    (tmp_path / "logs" / "plain").write_text("\n".join(json.dumps(sql_start(i)) for i in range(9)))
    assert os.path.getsize(logs / "events_1_big.zstd") > 2 * 4 * 1024**2

    events = eventlog.ingest(spark, str(tmp_path / "logs"), str(tmp_path / "out"))
    counts = {r.run_key.rsplit("/", 1)[1]: r["count"] for r in events.where("kind = 'sql_start'").groupBy("run_key").count().collect()}
    assert counts == {"eventlog_v2_big": 1000, "plain": 9}

    lines = eventlog.read_log_lines(spark, str(tmp_path / "logs"))
    labels = spark.createDataFrame([(r,) for r in ["x"]], "label string")
    signals = eventlog.sql_signals(eventlog.parse_events(lines))
    assert signals.where("has_sort_merge_join").count() == 1000
    assert labels.join(signals, labels.label == signals.run_key, "left").count() == 1
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4194304b", "4194304", "4MB")


def test_no_log_vanishes_by_its_suffix(spark, tmp_path):
    import zstandard

    end = {"Event": "SparkListenerApplicationEnd", "Timestamp": 2}
    text = "\n".join(json.dumps(e) for e in (task(), task(), end)).encode()
    rolling = tmp_path / "eventlog_v2_x"
    rolling.mkdir()
    (rolling / "events_1_x.zstd.compact").write_bytes(zstandard.compress(text) + zstandard.compress(b"\n" + text))
    (rolling / "events_2_x.zstd").write_bytes(zstandard.compress(text))
    (tmp_path / "y.compact").write_bytes(text)
    (tmp_path / "z.zstd.inprogress").write_bytes(zstandard.compress(text))
    (tmp_path / "plain").write_bytes(text)

    def counts(**options):
        events = eventlog.parse_events(eventlog.read_log_lines(spark, str(tmp_path), **options))
        found = eventlog.tasks(events).groupBy("run_key").count().collect()
        return {r.run_key.rsplit("/", 1)[1]: r["count"] for r in found}

    assert counts() == {"eventlog_v2_x": 6, "y.compact": 2, "plain": 2}
    assert counts(include_unfinished=True) == {"eventlog_v2_x": 6, "y.compact": 2, "plain": 2, "z.zstd.inprogress": 2}

    bad = ["a.lzf", "b.lz4", "c.snappy", "d.lz4.compact", "e.bin"]
    for name in bad:
        (tmp_path / name).write_bytes(b"\x00\x01")
    with pytest.raises(ValueError, match="a.lzf"):
        eventlog.read_log_lines(spark, str(tmp_path))
    assert counts(skip_unreadable=True) == {"eventlog_v2_x": 6, "y.compact": 2, "plain": 2}
    skipped = eventlog.unreadable_logs(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in skipped) == bad


def test_tiny_logs_make_few_files_and_no_run_is_half_there(spark, tmp_path):
    import glob

    from plumbline.plans import fleet

    logs = tmp_path / "logs"
    logs.mkdir()
    start = {"Event": "SparkListenerApplicationStart", "App Name": "n", "App ID": "i", "Timestamp": 1}
    end = {"Event": "SparkListenerApplicationEnd", "Timestamp": 2}
    for i in range(100):
        (logs / f"app-{i}").write_text("\n".join(json.dumps(e) for e in (start, task(), sql_start(0), end)))
    (logs / "eventlog_v2_open").mkdir()
    (logs / "eventlog_v2_open" / "events_1_open").write_text("\n".join(json.dumps(e) for e in (start, task(), sql_start(0))))
    found = fleet.diagnose(spark, str(logs), str(tmp_path / "out"))
    for kind in ("task_end", "app_start", "app_end", "sql_start"):
        n = len(glob.glob(f"{tmp_path}/out/events/kind={kind}/*.parquet"))
        assert 1 <= n <= spark.sparkContext.defaultParallelism
    runs = {r.run_key for r in found.table("apps").collect()}
    assert len(runs) == 100
    for name in ("stages", "signals", "metrics", "findings", "recommendations"):
        assert {r.run_key for r in found.table(name).select("run_key").collect()} <= runs


def test_cut_off_log_is_read_up_to_the_cut(spark, tmp_path):
    import random

    import zstandard

    rng = random.Random(1)
    lines = [json.dumps(task(note=rng.randbytes(2_000).hex())) for _ in range(1000)]
    packed = zstandard.compress("\n".join(lines).encode())
    (tmp_path / "a.zstd").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "b").write_text(json.dumps(task()))

    def count(tolerate):
        lines = eventlog.read_log_lines(spark, str(tmp_path), tolerate_cut_off=tolerate)
        return eventlog.tasks(eventlog.parse_events(lines)).count()

    assert 100 < count(True) < 1001
    with pytest.raises(Exception, match="a.zstd"):
        count(False)


def test_combined_plans_shuffle_hashes_and_no_text(spark):
    """Repeated, null and distinct texts, with the dictionary broadcast and joined by hash."""
    rows = [(f"r{i % 3}", i, f"plan {i % 4}" if i % 7 else None) for i in range(200)]
    executions = spark.createDataFrame(rows, "run_key string, execution_id bigint, physical_plan string")
    expected = {}
    for run, i, text in rows:
        expected.setdefault((run, i // 10), []).append(text)
    for max_bytes in (0, 1 << 20):
        found = combined_plans(executions, per_part=10, max_bytes=max_bytes)
        got = {(r.run_key, r.part): r.plans for r in found.collect()}
        assert got == {key: "\n---\n".join(t for t in texts if t is not None) for key, texts in expected.items()}
    # The last plan, with the broadcast: what is shuffled by run and part has no text.
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges and all("physical_plan" not in lines[i + 1].split("functions=")[1] for i in exchanges)
