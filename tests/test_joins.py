import random

import pytest
from conftest import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import joins
from plumbline.sources import generate
from plumbline.sources.telemetry import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def sides(spark):
    """Two tables with one key that is hot on both sides, a null key and unmatched keys."""
    rng = random.Random(1)
    left = [(i, 1 if i < 60 else rng.choice([None, *range(2, 30)])) for i in range(150)]
    right = [(i, 1 if i < 20 else rng.choice([None, *range(10, 40)])) for i in range(70)]
    return (
        spark.createDataFrame(left, "a int, k int").cache(),
        spark.createDataFrame(right, "b int, k int").cache(),
    )


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(salts=st.integers(1, 25), how=st.sampled_from(joins.SALTABLE))
def test_salted_join_equals_the_plain_one(sides, salts, how):
    left, right = sides
    assert same(left.join(right, "k", how), joins.salted_join(left, right, "k", salts, how))


@pytest.mark.parametrize("how", joins.SALTABLE)
def test_salting_hot_keys_only(sides, how):
    left, right = sides
    hot = joins.hot_keys(left, "k", rows_per_salt=30)
    assert [r.k for r in hot.collect()] == [1]
    assert same(left.join(right, "k", how), joins.salted_join(left, right, "k", 8, how, hot=hot))


@pytest.mark.parametrize("how", joins.SALTABLE)
def test_salts_by_size_of_the_key(sides, how):
    left, right = sides
    hot = joins.hot_keys(left, "k", rows_per_salt=3)
    counts = {r.k: (r.rows, r.salts) for r in hot.collect()}
    assert counts[1] == (60, 20) and all(n > 3 and s == -(-n // 3) for n, s in counts.values())
    assert same(left.join(right, "k", how), joins.salted_join(left, right, "k", how=how, hot=hot))


@pytest.mark.parametrize("rows_per_salt, salted", [(8, True), (1_000, False)])
def test_skew_aware_join(sides, rows_per_salt, salted):
    left, right = sides
    joined = joins.skew_aware_join(left, right, "k", "left", ["a"], rows_per_salt)
    assert ("explode" in plan(joined)) == salted
    assert same(left.join(right, "k", "left"), joined)


@pytest.mark.parametrize("hot_only", [False, True])
def test_salting_both_sides(sides, hot_only):
    left, right = sides
    hot = joins.hot_keys(left, "k", rows_per_salt=30) if hot_only else None
    gridded = joins.salted_join(left, right, "k", salts=5, right_salts=3, hot=hot)
    assert same(left.join(right, "k"), gridded)


@pytest.mark.parametrize("how", ["right", "full", "right_outer", "cross"])
def test_sides_that_cannot_be_copied(sides, how):
    with pytest.raises(ValueError):
        joins.salted_join(*sides, "k", how=how)
    with pytest.raises(ValueError):
        joins.salted_join(*sides, "k", how="left", right_salts=2)


def test_many_keys_of_small_share_are_salted(spark):
    """200 keys of half a percent each, all above the rows a salt may have."""
    left = spark.range(20_000).selectExpr("id AS a", "id % 200 AS k")
    right = spark.range(200).selectExpr("id AS k", "id * 2 AS b")
    hot = joins.hot_keys(left, "k", rows_per_salt=10)
    assert hot.count() == 200 and {r.salts for r in hot.collect()} == {10}
    assert same(left.join(right, "k"), joins.skew_aware_join(left, right, "k", salt_by=["a"], rows_per_salt=10))


def test_a_key_that_is_hot_on_the_right(sides):
    left, right = sides
    few = left.where("a >= 55")
    joined = joins.skew_aware_join(few, right, "k", salt_by=["a"], rows_per_salt=10, right_salt_by=["b"])
    assert "explode" in plan(joined) and same(few.join(right, "k"), joined)


def test_copies_in_two_steps(sides, monkeypatch):
    left, right = sides
    monkeypatch.setattr(joins, "_COPIES_AT_ONCE", 4)
    hot = joins.hot_keys(left, "k", rows_per_salt=5)
    for how in joins.SALTABLE:
        assert same(left.join(right, "k", how), joins.salted_join(left, right, "k", how=how, hot=hot))
    grid = hot.withColumn("right_salts", F.lit(7))
    assert same(left.join(right, "k"), joins.salted_join(left, right, "k", hot=grid))


def test_salt_spreads_the_hot_key(spark):
    orders = generate.orders_join_fact(generate.row_ids(spark, 20_000), hot_rows=7_000)
    salt = joins.row_salt(["order_id"], 20).alias("s")
    sizes = [r["count"] for r in orders.where("customer_id = 1").groupBy(salt).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1.3 * 7_000 / 20


def test_pair_totals_equal_the_joined_rows(sides):
    left, right = sides
    by_rows = left.join(right, "k").groupBy("k").agg(
        F.count(F.lit(1)).alias("matched_pairs"), F.sum("a").alias("total_amount")
    )
    assert same(by_rows, joins.pair_totals(left, right, "k", "a"))
    assert same(by_rows, joins.salted_pair_totals(left, right, "k", "a", rows_per_salt=9))


def test_hot_pairs_of_the_generated_facts(spark):
    orders, events = generate.generate_join_facts(spark)
    totals = joins.pair_totals(orders, events, "customer_id", "order_amount")
    assert totals.where("customer_id = 1").first().matched_pairs == 3_000_000


def test_join_strategies(spark):
    orders = table(spark, SMALL, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, SMALL, "customer")
    assert "SortMergeJoin" in plan(joins.shuffle_join(orders, customers, "c_custkey"))
    assert "BroadcastHashJoin" in plan(joins.broadcast_join(orders, customers, "c_custkey"))
    too_large = joins.broadcast_join(orders, customers, "c_custkey", max_bytes=1_000)
    assert "SortMergeJoin" in plan(too_large) and "Broadcast" not in plan(too_large)
    assert same(too_large, joins.broadcast_join(orders, customers, "c_custkey"))
    known = joins.broadcast_join(orders, customers, "c_custkey", dim_bytes=2**40)
    assert "SortMergeJoin" in plan(known)


def test_measured_bytes(spark):
    df = spark.createDataFrame([("abcd", 1, [1, 2]), (None, 2, None)], "s string, n int, xs array<int>")
    size = joins.measured_bytes(df)
    assert 2 * 32 + 4 <= size <= 2 * 32 + 4 + 40
    assert joins.measured_bytes(df.limit(0)) == 0


def test_key_skew_profile(spark):
    df = spark.createDataFrame([(k,) for k in [1] * 9 + [2, 2, 3, 3, 3, 4]], "k int")
    row = joins.key_skew_profile(df, "k").first()
    assert row.asDict() == {
        "n_keys": 4, "n_rows": 15, "max_rows": 9, "median_rows": 2.5, "skew_ratio": 3.6,
    }
    assert joins.key_skew_profile(df.where("k = 4"), "k").first().skew_ratio is None
    assert joins.key_skew_profile(df.limit(0), "k").count() == 0
    odd = joins.key_skew_profile(df.where("k < 4"), "k").first()
    assert (odd.median_rows, odd.skew_ratio) == (3.0, 3.0)


@pytest.mark.parametrize("limit", [1, 9, 10, 11, 4_999, 5_000, 5_001])
def test_heavy_keys_on_both_sides_of_the_limit(spark, limit):
    """Sketched candidates and an exact count give what counting all keys gives, null keys included."""
    rows = spark.range(40_000).selectExpr(
        "CASE WHEN id < 5000 THEN 'hot' WHEN id < 10000 THEN NULL WHEN id < 10010 THEN 'ten' WHEN id < 10021 THEN 'eleven' "
        "ELSE CONCAT('k', id div 2) END AS k", "id % 2 AS j"
    ).repartition(6)
    for on in ("k", ["k", "j"]):
        found = joins.heavy_keys(rows, on, limit)
        expected = joins.hot_keys(rows, on, limit)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_heavy_keys_shuffle_candidates_alone(spark):
    """Of many keys that occur once none is shuffled: what the last exchange takes are rows of candidates."""
    rows = spark.range(200_000).selectExpr("IF(id < 3000, -1, id) AS k")
    found = joins.heavy_keys(rows, "k", 1_000)
    assert [tuple(r) for r in found.collect()] == [(-1, 3000, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "approx_top_k" in plan and "LeftSemi" in plan
    assert joins.heavy_keys(rows.limit(0), "k", 5).count() == 0
