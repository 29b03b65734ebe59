"""Sizes of join inputs, from hand-made events and from the log of a real job."""

import json
import subprocess
import sys

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plumbline.operators import rules
from plumbline.plans import fleet
from plumbline.sources import eventlog, joinsides, telemetry

SQL = "org.apache.spark.sql.execution.ui.SparkListenerSQL"


def node(name, *below, size_id=None):
    metrics = [{"name": "rows", "accumulatorId": 1}]
    if size_id is not None:
        metrics.append({"name": "data size", "accumulatorId": size_id, "metricType": "size"})
    return {"nodeName": name, "simpleString": name, "children": list(below), "metrics": metrics}


def join(left, right):
    return node("SortMergeJoin", node("Sort", left), node("Sort", right))


def exchange(size_id):
    return node("Exchange", node("Scan parquet"), size_id=size_id)


@pytest.mark.parametrize(
    "tree, pairs",
    [
        (join(exchange(5), exchange(6)), [(5, 6)]),
        (join(exchange(5), node("ReusedExchange", exchange(5))), [(5, 5)]),
        # A side that a join below has sorted already is no exchange; the join below counts.
        (join(join(exchange(5), exchange(6)), exchange(7)), [(5, 6)]),
        (node("Project", join(exchange(5), node("Scan parquet"))), []),
        (node("SortMergeJoin(skew=true)", exchange(5), exchange(6)), [(5, 6)]),
        (node("BroadcastHashJoin", exchange(5), exchange(6)), []),
        (node("SortMergeJoin"), []),
        ([], []),
        (None, []),
    ],
)
def test_sides_in_a_tree(tree, pairs):
    assert joinsides.sides_of(json.dumps(tree)) == pairs


@pytest.mark.parametrize("text", ["", "{", '{"nodeName":"SortMergeJoin","children":null}', '{"nodeName":null}'])
def test_what_is_no_tree_has_no_sides(text):
    assert joinsides.sides_of(text) == []


def test_a_very_deep_tree():
    deep = exchange(6)
    for _ in range(300):
        deep = node("Project", deep)
    assert joinsides.sides_of(json.dumps(join(exchange(5), deep))) == [(5, 6)]


def started(execution, tree, event="ExecutionStart"):
    return {
        "Event": SQL + event, "executionId": execution, "time": 1, "description": "",
        "physicalPlanDescription": "SortMergeJoin", "sparkPlanInfo": tree,
    }


def wrote(updates, reason="Success", name="data size"):
    accumulables = [{"ID": i, "Name": name, "Update": u, "Value": "9", "Metadata": "sql"} for i, u in updates]
    # Updates of other metrics need not be numbers.
    accumulables.append({"ID": 99, "Name": "internal.metrics.updatedBlockStatuses", "Update": [{"Block ID": "b"}]})
    return {
        "Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task End Reason": {"Reason": reason},
        "Task Info": {"Task ID": 1, "Accumulables": accumulables},
    }


@pytest.fixture
def parse(spark):
    def run(*events):
        lines = [("r", json.dumps(e)) for e in events]
        return eventlog.parse_events(spark.createDataFrame(lines, "run_key string, value string"))

    return run


def sizes(events):
    return {r.execution_id: r.small_side_bytes for r in joinsides.join_side_bytes(events).collect()}


def test_sizes_add_up_over_tasks(parse):
    events = parse(
        started(1, join(exchange(5), exchange(6))),
        started(1, join(exchange(5), exchange(6)), "AdaptiveExecutionUpdate"),  # told twice
        wrote([(5, "100"), (6, "7")]),
        wrote([(5, 100)]),  # a number, not a text
        wrote([(6, "5")]),
        wrote([(6, "1000")], reason="ExceptionFailure"),
        wrote([(6, "1000")], name="number of output rows"),
        wrote([(6, "many")]),
    )
    assert sizes(events) == {1: 12}


def test_joins_whose_sides_are_not_known(parse):
    events = parse(
        started(1, join(exchange(5), exchange(6))),  # no task wrote for 6
        started(2, join(exchange(7), exchange(7))),  # a self-join, one exchange
        started(3, join(join(exchange(8), exchange(9)), exchange(10))),
        started(4, node("BroadcastHashJoin", exchange(5), exchange(7))),
        started(None, join(exchange(7), exchange(8))),
        wrote([(5, "50"), (7, "30"), (8, "80"), (9, "90"), (10, "1")]),
    )
    assert sizes(events) == {2: 30, 3: 80}
    assert sizes(parse(wrote([(5, "1")]))) == {} == sizes(parse(started(1, join(exchange(5), exchange(6)))))


def test_rule_with_sizes(parse):
    large, small = join(exchange(5), exchange(6)), join(exchange(5), exchange(7))
    events = parse(
        started(1, large), started(2, small), started(3, join(exchange(8), exchange(9))),
        wrote([(5, "5000"), (6, "4000"), (7, "40")]),
    )
    signals = joinsides.with_join_sides(eventlog.sql_signals(events), events)

    def found(**limits):
        rows = rules.detect_missing_broadcast(signals, limits=rules.Thresholds(**limits)).collect()
        return {r.execution_id: r.evidence.get("small_side_bytes") for r in rows}

    assert found() == {1: 4000.0, 2: 40.0, 3: None}
    assert found(broadcast_side_bytes=4000) == {1: 4000.0, 2: 40.0, 3: None}
    assert found(broadcast_side_bytes=3999) == {2: 40.0, 3: None}
    both = rules._plan_findings(signals, rules.Thresholds(broadcast_side_bytes=3999), False)
    assert {r.execution_id: dict(r.evidence) for r in both.collect()} == {
        2: {"execution_id": 2.0, "small_side_bytes": 40.0}, 3: {"execution_id": 3.0},
    }


JOB = """
import sys
from pyspark.sql import SparkSession
builder = SparkSession.builder.master("local[2]").appName("two_joins").config("spark.ui.enabled", "false")
for key, value in {
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + sys.argv[1],
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4",
    "spark.sql.adaptive.enabled": sys.argv[2],
}.items():
    builder = builder.config(key, value)
spark = builder.getOrCreate()
large = spark.range(60_000)
for other in (spark.range(50_000), spark.range(100)):
    large.join(other.selectExpr("id", "id * 2 AS twice"), "id").selectExpr("sum(twice)").collect()
spark.stop()
"""


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_two_large_sides_are_told_from_a_small_one(spark, tmp_path, adaptive):
    logs = tmp_path / "logs"
    logs.mkdir()
    command = [sys.executable, "-c", JOB, str(logs), adaptive]
    subprocess.run(command, check=True, timeout=300, capture_output=True)
    limits = rules.Thresholds(broadcast_side_bytes=100_000)
    every = fleet.diagnose(spark, str(logs), str(tmp_path / "all"))
    large = fleet.diagnose(spark, str(logs), str(tmp_path / "limited"), limits)

    def joins(result):
        rows = result.table("findings").where("category = 'missing_broadcast'").collect()
        return {r.execution_id: r.evidence["small_side_bytes"] for r in rows}

    # A row takes 8 bytes and 8 for each whole number; 60,000 rows of one meet 50,000 and 100 rows of two.
    assert joins(every) == {0: min(16.0 * 60_000, 24.0 * 50_000), 1: 24.0 * 100}
    assert joins(large) == {1: 24.0 * 100}


def test_lines_are_written_by_compiled_code(spark):
    """JSON is not written below a higher-order function, which Spark interprets with all its arguments."""
    for lines in (telemetry.sized_join_lines, telemetry.task_lines, telemetry.sql_lines):
        plan = lines(spark, SMALL, 2).where(F.col("value").contains("Start"))._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and "lambda" not in plan


def test_missing_lines_are_left_out(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "run_key string, n int")
    text = F.col("n").cast("string")
    found = telemetry._as_lines(rows, text, F.lit("x"), F.concat(text, F.lit("!"))).collect()
    assert sorted(map(tuple, found)) == [("a", "1"), ("a", "1!"), ("a", "x"), ("b", "x")]
