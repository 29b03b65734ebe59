import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import fmt_bytes, fmt_pct_change, mixed_bucket
from plumbline.functions.formatting import fmt_fixed, round_fixed
from plumbline.functions.median import exact_median

whole = st.integers(min_value=0, max_value=2**45)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(whole, min_size=1, max_size=12), min_size=1, max_size=40))
def test_median_equals_the_plain_one(spark, groups):
    rows = [(g, v) for g, values in enumerate(groups) for v in values]
    got = exact_median(spark.createDataFrame(rows, "g int, v bigint"), ["g"], "v", "m")
    expected = {g: statistics.median(values) for g, values in enumerate(groups)}
    assert {r.g: r.m for r in got.collect()} == expected


def test_median_of_a_group_with_most_rows(spark):
    """One group with nearly all rows, many of them equal, over many value ranges."""
    rng = random.Random(3)
    hot = [rng.choice([7, 5_000_000, rng.randrange(2**42)]) for _ in range(20_001)]
    cold = [rng.randrange(2**30) for _ in range(50)]
    rows = [("hot", v) for v in hot] + [("cold", v) for v in cold] + [("hot", None), (None, 5)]
    got = exact_median(spark.createDataFrame(rows, "g string, v bigint"), ["g"], "v", "m")
    assert {r.g: r.m for r in got.collect()} == {
        "hot": statistics.median(hot),
        "cold": statistics.median(cold),
    }


def test_median_of_values_beyond_doubles(spark):
    """Neighbours above 2^53, where the sketch's doubles merge them, and both ends of the range."""
    groups = {
        "odd": [2**53 + 1] * 3,
        "near": [2**62 + k for k in range(700)],
        "low": [-(2**63)] * 5,
        "high": [2**63 - 1] * 4,
        "signs": [-(2**60) - 3, -7, 0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    got = exact_median(spark.createDataFrame(rows, "g string, v bigint"), ["g"], "v", "m", count="n", largest="most")
    expected = {
        g: ((float(sorted(v)[(len(v) - 1) // 2]) + float(sorted(v)[len(v) // 2])) / 2, len(v), max(v))
        for g, v in groups.items()
    }
    assert {r.g: (r.m, r.n, r.most) for r in got.collect()} == expected


@pytest.mark.parametrize("size", [255, 256, 257, 9_999, 40_000])
def test_median_where_the_sketch_starts_to_merge(spark, size):
    """Sizes around those from which the sketch is no longer exact, in sorted and mixed order."""
    rng = random.Random(size)
    mixed = [rng.randrange(size * 3) for _ in range(size)]
    rows = [("sorted", v) for v in range(size)] + [("mixed", v) for v in mixed] + [("same", 4)] * size
    got = exact_median(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", "m")
    assert {r.g: r.m for r in got.collect()} == {
        "sorted": (size - 1) / 2, "mixed": statistics.median(mixed), "same": 4.0,
    }


def test_median_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, h int, v bigint")
    assert exact_median(empty, ["g", "h"], "v", "m").collect() == []


def test_median_in_four_exchanges_and_no_job_before(spark):
    df = spark.range(1_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"), "id")
    # Such a small table would be broadcast, which is fewer exchanges still.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("median", "building a query runs nothing")
    try:
        got = exact_median(df, ["g", "h"], "id", "m", together=["g"]).groupBy("g").agg(F.max("m").alias("m"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("median")) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("Exchange") == 4
    assert got.count() == 3


def fixed(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [r.t for r in df.select(fmt_fixed(F.col("x"), digits).alias("t")).collect()]


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_rounding_is_that_of_the_binary_value(spark, digits):
    rng = random.Random(digits)
    ties = [n / 2 / 10**digits for n in range(-60, 60)] + [n / 8 for n in range(-80, 80)]
    odd = [0.05, 0.15, 0.35, 0.45, 8.35, 2.675, 0.2625, 1e-12, 5e-324, 1e15 + 0.5, 2.0**52 + 0.5, 2.0**60, 0.9995, 9.9996]
    mixed = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-6, 9) for _ in range(1500)]
    near = [(rng.randint(0, 9999) + 0.5) / 10**digits for _ in range(1000)]
    values = ties + odd + mixed + near
    expected = [f"{v:.{digits}f}" for v in values]
    assert [t for t in fixed(spark, values, digits)] == expected


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(min_value=-(2.0**62), max_value=2.0**62), min_size=1, max_size=200), st.integers(0, 3))
def test_rounding_of_any_double(spark, values, digits):
    expected = [f"{v:.{digits}f}" for v in values]
    # A negative zero loses its sign; a value that rounds to zero keeps it.
    got = fixed(spark, values, digits)
    assert got == [a if v != 0 else a.lstrip("-") for a, v in zip(expected, values)]


def test_rounded_evidence(spark):
    df = spark.createDataFrame([(0.2625,), (None,)], "x double").select(round_fixed(F.col("x"), 3).alias("r"))
    assert [r.r for r in df.collect()] == [round(0.2625, 3), None]


@pytest.mark.parametrize(
    "n, text",
    [
        (0, "0.0B"),
        (1023, "1023.0B"),
        (1024, "1.0KB"),
        (1280, "1.2KB"),
        (1536 * 1024, "1.5MB"),
        (1024**4, "1.0TB"),
        (1024**5, "1024.0TB"),
        (-2048, "-2.0KB"),
    ],
)
def test_fmt_bytes(spark, n, text):
    df = spark.createDataFrame([(n,)], "n bigint").select(fmt_bytes(F.col("n")).alias("t"))
    assert df.first().t == text


@pytest.mark.parametrize(
    "before, after, text",
    [(0, 0, "n/a"), (0, 5, "new"), (10, 10, "↑0%"), (10, 5, "↓50%"), (10, 15, "↑50%"), (8, 9, "↑12%")],
)
def test_fmt_pct_change(spark, before, after, text):
    df = spark.createDataFrame([(float(before), float(after))], "b double, a double")
    assert df.select(fmt_pct_change(F.col("b"), F.col("a")).alias("t")).first().t == text


def test_mixed_bucket_is_even(spark):
    counts = spark.range(50_000).groupBy(mixed_bucket(F.col("id"), 7, 10).alias("b")).count()
    sizes = {r.b: r["count"] for r in counts.collect()}
    assert sorted(sizes) == list(range(10))
    assert all(abs(n - 5_000) < 500 for n in sizes.values())
