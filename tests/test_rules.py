import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import rules
from plumbline.operators.advice import RECOMMENDATIONS, recommend, recommendations_per_run
from plumbline.operators.rollup import stage_rollup
from plumbline.sources import eventlog

MB5 = 5 * 1024 * 1024


@pytest.fixture
def stages(spark):
    """Stages rolled up from tasks given as dictionaries of metrics."""

    def make(*tasks):
        row = {name: 0 for name in schemas.TASKS.names}
        row.update(run_key="r", stage_id=1, failed=False)
        rows = [{**row, **t} for t in tasks]
        df = spark.createDataFrame([tuple(r[n] for n in schemas.TASKS.names) for r in rows], schemas.TASKS)
        return stage_rollup(df)

    return make


def reads(*values):
    return [{"shuffle_read_bytes": v} for v in values]


@pytest.mark.parametrize(
    "values, severity, ratio",
    [
        ([10] * 7 + [30], "medium", 3.0),
        ([10] * 7 + [29], None, None),
        ([10] * 7 + [100], "high", 10.0),
        ([10] * 6 + [100], None, None),
        ([0] * 7 + [100], None, None),
        ([0, 0, 0, 0, 10, 10, 20, 90], "medium", 6.0),
    ],
)
def test_skew(stages, values, severity, ratio):
    rows = rules.detect_skew(stages(*reads(*values))).collect()
    if severity is None:
        assert rows == []
    else:
        assert (rows[0].severity, rows[0].evidence["skew_ratio"]) == (severity, ratio)
        assert rows[0].stage_id == 1 and rows[0].category == "skew"
        assert rows[0].message.startswith(f"largest / median shuffle read = {ratio}; limit = 3; tasks = ")


@pytest.mark.parametrize(
    "n, size, found",
    [(20, MB5, False), (20, MB5 - 1, True), (19, 1024, False), (20, 0, False)],
)
def test_small_files(stages, n, size, found):
    rows = rules.detect_small_files(stages(*[{"input_bytes": size}] * n)).collect()
    assert bool(rows) == found
    if found:
        assert rows[0].severity == "medium"
        assert rows[0].evidence["avg_input_bytes_per_task"] == float(size)


@pytest.mark.parametrize(
    "memory, disk, severity", [(1, 0, None), (2, 0, "medium"), (1, 1, "high"), (0, 0, None)]
)
def test_spill(stages, memory, disk, severity):
    rows = rules.detect_spill(
        stages({"memory_bytes_spilled": memory, "disk_bytes_spilled": disk})
    ).collect()
    assert [r.severity for r in rows] == ([severity] if severity else [])


@pytest.mark.parametrize(
    "run, serde, tasks, found",
    [(1000, 250, 8, True), (1000, 249, 8, False), (0, 250, 8, False), (1000, 900, 7, False)],
)
def test_serialization(stages, run, serde, tasks, found):
    first = {
        "executor_run_time_ms": run,
        "executor_deserialize_time_ms": serde - 100,
        "result_serialization_time_ms": 100,
    }
    rows = rules.detect_serialization_overhead(stages(first, *[{}] * (tasks - 1))).collect()
    assert [r.evidence["overhead_ratio"] for r in rows] == ([0.25] if found else [])


@pytest.fixture
def signals(spark):
    def make(*plans, run="r"):
        rows = [(run, i, "", p, None, i, None) for i, p in enumerate(plans)]
        return eventlog.signals_of(spark.createDataFrame(rows, schemas.SQL_EXECUTIONS))

    return make


@pytest.mark.parametrize(
    "plans, ids",
    [
        (["SortMergeJoin"], [0]),
        (["SortMergeJoin BroadcastHashJoin"], []),
        (["SortMergeJoin", "x", "SortMergeJoin"], [0, 2]),
    ],
)
def test_missing_broadcast(signals, plans, ids):
    rows = rules.detect_missing_broadcast(signals(*plans)).orderBy("execution_id").collect()
    assert [r.execution_id for r in rows] == ids
    assert all(r.severity == "high" and r.evidence["execution_id"] == r.execution_id for r in rows)


@pytest.mark.parametrize(
    "plans, scans",
    [
        (["Scan parquet"] * 2, 2),
        (["Scan parquet"], None),
        (["Scan parquet"] * 3 + ["InMemoryTableScan"], None),
        (["Scan parquet"] * 3 + ["InMemoryRelation"], None),
    ],
)
def test_missing_cache(signals, plans, scans):
    rows = rules.detect_missing_cache(signals(*plans)).collect()
    assert [r.evidence["num_scanning_executions"] for r in rows] == ([scans] if scans else [])


def test_other_scans_can_be_named(spark):
    rows = [("r", i, "", "BatchScan orders", None, i, None) for i in range(2)]
    plans = spark.createDataFrame(rows, schemas.SQL_EXECUTIONS)
    assert rules.detect_missing_cache(eventlog.signals_of(plans)).isEmpty()
    named = {**eventlog.PLAN_FLAGS, "has_parquet_scan": ("Scan parquet", "BatchScan")}
    assert rules.detect_missing_cache(eventlog.signals_of(plans, named)).count() == 1


def test_all_findings_and_advice(spark, stages, signals):
    bad = [{"shuffle_read_bytes": 10, "memory_bytes_spilled": 5}] * 7 + [{"shuffle_read_bytes": 40}]
    two = [dict(t, stage_id=s) for s in (1, 2) for t in bad]
    found = rules.all_findings(stages(*two), signals("SortMergeJoin"))
    assert found.schema.simpleString() == schemas.FINDINGS.simpleString()
    listed = rules.findings_listing(found).orderBy("listing_position").collect()
    assert [f.listing_position for f in listed] == [1, 2, 3, 4, 5]
    assert [(f.category, f.stage_id) for f in listed] == [
        ("skew", 1), ("skew", 2), ("missing_broadcast", None), ("spill", 1), ("spill", 2),
    ]
    per_run = recommendations_per_run(found).orderBy("first_seen").collect()
    assert [(r.category, r.n_findings) for r in per_run] == [
        ("skew", 2), ("missing_broadcast", 1), ("spill", 2),
    ]
    assert recommend(found).count() == 5


def test_one_pass_over_plans_equals_the_two_rules(spark, stages, signals):
    several = signals("SortMergeJoin", "Scan parquet", "Scan parquet SortMergeJoin", "x").unionByName(
        signals("Scan parquet", "Scan parquet", "InMemoryRelation", "SortMergeJoin", run="cached")
    ).unionByName(signals("SortMergeJoin BroadcastHashJoin", "Scan parquet", run="clean"))
    apart = rules.detect_missing_broadcast(several).unionByName(rules.detect_missing_cache(several))
    together = rules.all_findings(stages({}).limit(0), several)
    key = lambda r: (r.run_key, r.detector_ord, r.execution_id or 0)
    assert sorted(together.select(*apart.columns).collect(), key=key) == sorted(apart.collect(), key=key)


def test_listing_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rules, "_BLOCK", 7)
    rows = [("r", 3, "c", "high", None, i * 3, "m", {}) for i in range(50)] + [("r", 1, "c", "high", i, None, "m", {}) for i in range(30)]
    found = spark.createDataFrame(rows, schemas.FINDINGS)
    listed = rules.findings_listing(found).orderBy("listing_position").collect()
    assert [(r.detector_ord, r.stage_id or r.execution_id or 0) for r in listed] == sorted((r[1], r[4] or r[5] or 0) for r in rows)
    assert [r.listing_position for r in listed] == list(range(1, 81))


def test_each_rule_has_advice():
    assert [r[0] for r in RECOMMENDATIONS] == [rules.CATEGORIES[i] for i in range(1, 7)]


def test_failed_tasks_can_be_left_out(spark, stages):
    rows = [{"shuffle_read_bytes": 10}] * 3 + [{"shuffle_read_bytes": 90, "failed": True}]
    assert stages(*rows).first().num_tasks == 4
    base = {name: 0 for name in schemas.TASKS.names} | {"run_key": "r", "stage_id": 1, "failed": False}
    df = spark.createDataFrame(
        [tuple({**base, **r}[n] for n in schemas.TASKS.names) for r in rows], schemas.TASKS
    )
    kept = stage_rollup(df, exclude_failed=True).first()
    assert kept.num_tasks == 3 and kept.shuffle_read_skew_ratio == 1.0


def test_limits_are_parameters(stages):
    strict = rules.Thresholds(skew_ratio=2.0, skew_min_tasks=2)
    rows = rules.detect_skew(stages(*reads(10, 10, 20)), strict).collect()
    assert rows[0].evidence["skew_ratio"] == 2.0


def test_stage_schema(stages):
    assert stages({}).schema.simpleString() == schemas.STAGES.simpleString()
    assert stages({"executor_run_time_ms": 5}).select(F.col("task_duration_skew_ratio")).first()[0] is None
