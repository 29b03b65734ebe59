import glob

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plumbline.operators import layout, reuse
from plumbline.settle import ensure_checkpoint_dir
from plumbline.sources import generate
from plumbline.sources.files import file_listing


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return generate.write_tables(spark, str(tmp_path_factory.mktemp("tables")), scale=0.01)


def test_written_files(tables):
    files = {name: len(glob.glob(f"{path}/*.parquet")) for name, path in tables.items()}
    assert files == {
        "orders": 64, "orders_small_files": 300, "customers": 8,
        "orders_join_fact": 8, "events_join_fact": 8,
    }


def test_small_files_are_seen_and_read_together(spark, tables):
    path = tables["orders_small_files"]
    profile = layout.small_file_profile(spark, path).first()
    assert profile.n_files == 300 and profile.small_files and profile.target_partitions == 1
    # With a limit of 5 MB and 4 MB per opened file, two files share a partition.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(5 * 1024 * 1024))
    try:
        as_is = spark.read.parquet(path)
        assert as_is.rdd.getNumPartitions() == 150
        compacted = layout.compact_scan(spark, path)
        assert compacted.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 150
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(5 * 1024 * 1024)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    total = F.sum(F.col("order_amount").cast("decimal(18,2)"))
    assert rows(as_is.groupBy("region").agg(total)) == rows(compacted.groupBy("region").agg(total))


def test_large_files_are_not_small(spark, tmp_path):
    layout.write_compacted(spark.range(1000), str(tmp_path / "t"), 19)
    assert not layout.small_file_profile(spark, str(tmp_path / "t")).first().small_files


def test_generated_orders(spark):
    orders = generate.generate_skewed_orders(spark, rows=20_000, customer_count=500)
    found = orders.agg(
        F.expr("count_if(customer_id = 1)").alias("hot"),
        F.count_distinct("order_id").alias("ids"),
        F.min(F.when(F.col("customer_id") != 1, F.col("customer_id"))).alias("low"),
        F.max("customer_id").alias("high"),
        F.min("order_amount").alias("least"),
        F.max("order_amount").alias("most"),
        F.collect_set("region").alias("regions"),
    ).first()
    assert (found.hot, found.ids, found.low, found.high) == (7_000, 20_000, 2, 499)
    assert 0 <= found.least < found.most < 1000 and sorted(found.regions) == [0, 1, 2, 3, 4]
    assert orders.schema.simpleString() == (
        "struct<order_id:bigint,customer_id:bigint,order_amount:double,order_ts:timestamp,region:int>"
    )


def test_generated_values_repeat(spark):
    one = generate.generate_skewed_orders(spark, 1_000, 100).repartition(3)
    two = generate.generate_skewed_orders(spark, 1_000, 100)
    assert rows(one) == rows(two)


def test_generated_dimension_and_facts(spark):
    first = generate.generate_customers(spark, 50).orderBy("customer_id").first()
    assert (first.customer_id, first.customer_name) == (0, "customer_0")
    orders, events = generate.generate_join_facts(spark)
    for df, size, hot in ((orders, 23_000, 3_000), (events, 6_000, 1_000)):
        cold = df.where("customer_id <> 1").agg(F.min("customer_id"), F.max("customer_id")).first()
        assert df.count() == size and df.where("customer_id = 1").count() == hot
        assert 2 <= cold[0] and cold[1] <= 2001


def test_enriched_frame(spark, tables):
    orders = spark.read.parquet(tables["orders"])
    customers = spark.read.parquet(tables["customers"])
    enriched = reuse.enrich_orders(orders, customers, limit=1_000)
    assert enriched.agg(F.max("order_id")).first()[0] == 999
    row = enriched.where("order_id = 5").first()
    assert row.name_upper == row.customer_name.upper()
    assert row.amount_bucket == int(row.order_amount / 100)
    text = f"{row.name_upper}-5"
    assert row.name_hash == spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def test_first_rows_stay_in_many_tasks(spark):
    df = spark.range(0, 10_000, 1, 8).selectExpr("9999 - id AS order_id")
    first = reuse.first_rows(df, 1_000, "order_id")
    assert sorted(r.order_id for r in first.collect()) == list(range(1_000))
    assert first.rdd.getNumPartitions() == 8


def test_three_ways_to_reuse_agree(spark, tables):
    enriched = reuse.enrich_orders(
        spark.read.parquet(tables["orders"]), spark.read.parquet(tables["customers"])
    )
    expected = rows(reuse.reuse_uncached(enriched))
    results, frame = reuse.reuse_cached(enriched)
    assert rows(results) == expected and "InMemoryTableScan" in results._jdf.queryExecution().executedPlan().toString()
    assert frame.is_cached and not frame.unpersist().is_cached
    assert rows(reuse.reuse_grouping_sets(enriched)) == expected
    plan = reuse.reuse_grouping_sets(enriched)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2


def test_shared_frame_is_cached_and_released(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    with reuse.shared(df) as frame:
        frame.count()
        plan = frame.groupBy("x").count()._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan and frame.is_cached
    assert not df.is_cached
    with pytest.raises(RuntimeError), reuse.shared(df):
        raise RuntimeError
    assert not df.is_cached


def test_checkpoint_folder_is_the_one_named(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = ensure_checkpoint_dir(spark)
    assert named is None or named.removeprefix("file:") in folder


def test_listing_reads_no_content(spark):
    df = file_listing(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_rebalanced_files_follow_the_bytes(spark, tmp_path):
    """A value with most rows is many files, a small one a single file, and the session keeps its settings."""
    rows = spark.range(200_000).selectExpr(
        "IF(id < 150000, 'hot', IF(id < 150010, 'small', 'mid')) AS part", "id", "sha2(CAST(id AS STRING), 256) AS text"
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    layout.write_rebalanced(rows, str(tmp_path / "t"), ["part"], bytes_per_file=1 << 20)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) == before
    back = layout.files_of(spark.read.parquet(str(tmp_path / "t")))
    files = {r.part: r.n for r in back.select("part", "file").distinct().groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert files["small"] == 1 and files["hot"] >= 5 and files["hot"] > 2 * files["mid"]
    assert back.count() == 200_000 and back.select("id").distinct().count() == 200_000
    layout.write_rebalanced(rows.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_work_is_spread_only_where_a_read_has_too_few_tasks(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(20)
    assert layout.spread(few, 8, "id").rdd.getNumPartitions() == 8
    assert layout.spread(many, 8, "id") is many


def test_cached_results_leave_no_cache_behind(spark):
    from plumbline.plans import queries

    names = ("reuse_cached", "reuse_uncached", "reuse_grouping_sets")
    found = {}
    for name in names:
        df = queries()[name](spark, SMALL)
        assert "InMemoryTableScan" not in df._jdf.queryExecution().executedPlan().toString()
        found[name] = sorted(map(tuple, df.collect()), key=str)
    assert found["reuse_cached"] == found["reuse_uncached"] == found["reuse_grouping_sets"]


def test_reports_read_back_in_the_order_they_were_written(spark, tmp_path):
    from plumbline.operators import report

    lines = [("b 1", "x", s, i, 0, n, f"line {s} {i} {n}" if n else "") for s in range(3) for i in range(40) for n in range(4)]
    lines += [("a", "x", 0, 0, 0, 0, "only")]
    frame = spark.createDataFrame(lines, "report string, label string, section int, item bigint, sub_item bigint, line_no int, line string")
    report.write_reports(frame.repartition(7), str(tmp_path / "r"))
    got = {}
    for r in report.read_reports(spark, str(tmp_path / "r")).orderBy("report", "line_no").collect():
        got.setdefault(r.report, []).append((r.line_no, r.line))
    assert got["a"] == [(0, "only")]
    assert got["b 1"] == list(enumerate(line[-1] for line in sorted(l for l in lines if l[0] == "b 1")))
