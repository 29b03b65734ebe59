"""Exact median per group that never holds one group in one task.

``median()`` keeps all distinct values of a group in a single buffer, which a
stage with a third of all tasks would overflow.  Here a quantile sketch comes first: it combines
map-side to one bounded row per group and gives two values that enclose the median.  Rows are
read again, those below are counted, and only the few between the two values are ranked.

Nothing runs while the query is built, and four exchanges do it: sketches by group, rows and
their bounds by group and salt, and what is left to rank by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sketch is off by at most n / ACCURACY ranks; the bounds are MARGIN * n ranks to either
# side of the middle, so that they enclose it, and some two percent of a group lies between them.
ACCURACY = 256
MARGIN = 0.01
# Rows of a group go to as many tasks as there are salts; its bounds, one row, are copied to each.
SALTS = 16


def exact_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    together: list[str] | None = None,
    count: str | None = None,
    largest: str | None = None,
) -> DataFrame:
    """Median of the whole-number column ``value`` per ``keys``: one row per group.

    An even count averages its two middle values.  Null keys and values are left out.
    ``together`` names keys that the result is partitioned by (all of them if not given), for
    callers that go on by fewer keys.  ``count`` and ``largest`` add columns of these names.
    """
    present = F.lit(True)
    for name in (*keys, value):
        present = present & F.col(name).isNotNull()
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    rows = df.where(present).select(*keys, F.col(value).cast("bigint").alias("_value"), salt.alias("_salt"))

    cuts = F.percentile_approx("_value", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    sketched = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.max("_value").alias("_largest"), cuts.alias("_cuts")
    )
    bounds = sketched.select(
        *keys,
        "_total",
        "_largest",
        _widened(F.col("_cuts")[0], "try_subtract").alias("_low"),
        _widened(F.col("_cuts")[1], "try_add").alias("_high"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )

    # Below the bounds only the number counts; above them nothing does.  All values below are one
    # (null), and sums are made where the salted rows are before the group's tasks come together.
    near = rows.join(bounds, [*keys, "_salt"]).where("_value <= _high")
    between = F.when(F.col("_value") >= F.col("_low"), F.col("_value"))
    group = [*keys, "_total", "_largest"]
    salted = near.groupBy(*group, "_salt", between.alias("_between")).agg(F.count(F.lit(1)).alias("_n"))
    counted = (
        salted.repartition(*(together or keys))
        .groupBy(*group, F.col("_between"))
        .agg(F.sum("_n").alias("_n"))
    )
    up_to_value = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_between").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("_through", F.sum("_n").over(up_to_value))
    low = _at_rank(F.expr("(_total + 1) div 2"))
    high = _at_rank(F.expr("_total div 2 + 1"))
    # The sketch's bound is a guarantee; were it broken, an error goes before a wrong figure.
    missed = F.raise_error(F.lit("the middle of a group is not between its bounds")).cast("double")
    middle = F.coalesce((low.cast("double") + high.cast("double")) / 2, missed)
    more = [F.max(c).alias(name) for c, name in (("_total", count), ("_largest", largest)) if name]
    return ranked.groupBy(*keys).agg(middle.alias(out), *more)


def _widened(bound: Column, step: str) -> Column:
    """The sketch works in doubles, so a bound beyond 2^52 may be off by its last bits."""
    slack = F.abs(F.shiftright(bound, 52))
    return F.coalesce(F.call_function(step, bound, slack), bound)


def _at_rank(rank: Column) -> Column:
    """The value that holds this rank, among rows with running totals."""
    holds = (rank > F.col("_through") - F.col("_n")) & (rank <= F.col("_through"))
    return F.max(F.when(holds, F.col("_between")))
