"""Joins for skewed keys and for small dimensions, and profiles to choose by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.hashing import row_salt
from plumbline.settle import settled

BROADCAST_BYTES = 100 * 1024**2
SALTS = 20

# Replicating the right side is harmless only where unmatched right rows are not
# part of the result.
SALTABLE = ("inner", "left", "left_semi", "left_anti")


def _names(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


# --- plain and broadcast -------------------------------------------------------


def shuffle_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the sizes; adaptive skew handling still applies."""
    return left.join(right.hint("merge"), _names(on), how)


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows of ``df`` take in memory, by one aggregation over them."""
    width = F.lit(8 * (len(df.columns) + 1))
    for field in df.schema.fields:
        width = width + _variable_bytes(field)
    return df.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def _variable_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    if isinstance(field.dataType, T.DecimalType):
        return F.lit(16)
    return F.lit(0)


def broadcast_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    dim_bytes: int | None = None,
) -> DataFrame:
    """Broadcast ``dim`` if it is small enough, and join by shuffle if not.

    The size is measured unless the caller knows it, so a dimension that has
    outgrown memory costs a shuffle rather than the driver.
    """
    size = measured_bytes(dim) if dim_bytes is None else dim_bytes
    if size <= max_bytes:
        return fact.join(F.broadcast(dim), _names(on), how)
    return shuffle_join(fact, dim, on, how)


# --- salted ----------------------------------------------------------------------


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    salts: int = SALTS,
    how: str = "inner",
    salt_by: list[str] | None = None,
    right_salts: int = 1,
    right_salt_by: list[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on ``on`` with the work on each key spread over ``salts`` partitions.

    Each left row gets one salt, and each right row one copy per salt.  Salts are
    hashed from ``salt_by`` (all left columns by default), which should tell rows
    apart: name a unique column where there is one.

    A key that is hot on both sides also needs ``right_salts``: the two salts
    then form a grid, and each pair of rows meets in exactly one cell.

    ``hot`` (see ``hot_keys``) limits salting and copying to those keys; columns ``salts``
    and ``right_salts`` say how many each key gets, where it has them.
    """
    keys = _names(on)
    if how not in SALTABLE:
        raise ValueError(f"a salted join can be one of {SALTABLE}, not {how!r}")
    if salts < 1 or right_salts < 1:
        raise ValueError("salt counts start at 1")
    grid = right_salts > 1 or (hot is not None and "right_salts" in hot.columns)
    if grid and how != "inner":
        raise ValueError("salting both sides needs an inner join")

    by_left, by_right = salt_by or left.columns, right_salt_by or right.columns
    rows, columns, own_rows, own_columns = F.lit(salts), F.lit(right_salts), F.lit(salts), F.lit(right_salts)
    most = salts
    if hot is not None:
        count = F.col("salts") if "salts" in hot.columns else F.lit(salts)
        across = F.col("right_salts") if "right_salts" in hot.columns else F.lit(right_salts)
        marked = settled(
            hot.select(*keys, count.cast("int").alias("_salts"), across.cast("int").alias("_across"))
        )
        size, most = _bytes_and_most(marked)
        left = broadcast_join(left, marked, keys, "left", dim_bytes=size)
        right = broadcast_join(right, marked, keys, "left", dim_bytes=size)
        rows, columns = F.coalesce("_salts", F.lit(1)), F.coalesce("_across", F.lit(1))
        # Null keys match nothing, so they may go anywhere: spread them as well.
        without_key = F.lit(False)
        for key in keys:
            without_key = without_key | F.col(key).isNull()
        own_rows = F.when(without_key, salts).otherwise(rows)
        own_columns = F.when(without_key, right_salts).otherwise(columns)

    left = left.withColumn("_row", row_salt(by_left, own_rows))
    right = _copies(right, keys, "_row", rows, most)
    cells = [*keys, "_row"]
    if grid:
        left = _copies(left, [*keys, "_row"], "_column", columns, most)
        right = right.withColumn("_column", row_salt(by_right, own_columns))
        cells.append("_column")
    left, right = left.drop("_salts", "_across"), right.drop("_salts", "_across")
    return left.join(right, cells, how).drop("_row", "_column")


# A row is copied by one task up to so many times; beyond that copies are made in two steps.
_COPIES_AT_ONCE = 1024


def _copies(df: DataFrame, keys: list[str], name: str, count: Column, most: int) -> DataFrame:
    """Each row once per number from 0 up to ``count``, which is in ``name``."""
    if most <= _COPIES_AT_ONCE:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), count - 1)))
    parts = F.ceil(count / _COPIES_AT_ONCE).cast("int")
    dealt = df.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).repartition(*keys, "_part")
    first = F.col("_part") * _COPIES_AT_ONCE
    last = F.least(first + _COPIES_AT_ONCE, count) - 1
    return dealt.withColumn(name, F.explode(F.sequence(first, last))).drop("_part")


def _bytes_and_most(marked: DataFrame) -> tuple[int, int]:
    """Size in memory, and the largest number of copies, of marked keys."""
    width = F.lit(8 * (len(marked.columns) + 1))
    for field in marked.schema.fields:
        width = width + _variable_bytes(field)
    row = marked.agg(F.sum(width.cast("bigint")), F.max(F.greatest("_salts", "_across"))).first()
    return row[0] or 0, row[1] or 1


def hot_keys(df: DataFrame, on: str | list[str], rows_per_salt: int) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows: key, ``rows``, and the ``salts`` that bring
    each partition of the key down to that.

    There are at most as many as the rows of ``df`` over ``rows_per_salt``.
    """
    return (
        df.groupBy(*_names(on))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > rows_per_salt)
        .withColumn("salts", F.ceil(F.col("rows") / rows_per_salt).cast("int"))
    )


# Fixed values of Spark's sketch of frequent items: what it can track at most, and how many
# items have to be tracked so that one of every n-th row is sure to be found.
TRACKED_MOST = 1_000_000
TRACKED_PER_KEY = 8
TRACKED_LEAST = 1_024


def heavy_keys(df: DataFrame, on: str | list[str], rows_per_salt: int) -> DataFrame:
    """What ``hot_keys`` gives, without a shuffle of all keys.

    A mergeable sketch of frequent items, a row of bounded size per task, names the candidates: with
    n tracked items its counts are off by less than 2.7 rows in n, and it keeps all keys of more
    than twice that.  Then the rows of candidates alone are counted exactly, so a key is found if and only
    if it has more than ``rows_per_salt`` rows.  The rows of ``df`` are counted when this is called.
    Where the limit is so low that a sketch could not be sure, all keys are counted.
    """
    keys = _names(on)
    tracked = max(TRACKED_LEAST, TRACKED_PER_KEY * df.count() // max(rows_per_salt, 1))
    if tracked > TRACKED_MOST:
        return hot_keys(df, keys, rows_per_salt)
    key = F.xxhash64(*keys)
    frequent = df.select(key.alias("_key")).agg(F.expr(f"approx_top_k(_key, {tracked}, {tracked})").alias("found"))
    candidates = frequent.select(F.explode("found.item").alias("_key"))
    # At most as many numbers as are tracked.
    rows = df.withColumn("_key", key).join(F.broadcast(candidates), "_key", "left_semi")
    return hot_keys(rows.select(*keys), keys, rows_per_salt)


def skew_aware_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    salt_by: list[str] | None = None,
    rows_per_salt: int = 5_000_000,
    right_salt_by: list[str] | None = None,
) -> DataFrame:
    """Salt the keys with many rows on either side, and join plainly if there are none.

    Keys of both sides are looked for once, see ``heavy_keys``.  Rows of a key that is hot on the right are
    spread only in an inner join: elsewhere copying left rows would repeat unmatched ones.
    """
    keys = _names(on)
    hot = heavy_keys(left, keys, rows_per_salt).select(*keys, "salts")
    if how == "inner":
        across = heavy_keys(right, keys, rows_per_salt).select(*keys, F.col("salts").alias("right_salts"))
        hot = hot.join(across, keys, "full").fillna(1, ["salts", "right_salts"])
    hot = settled(hot)
    if hot.isEmpty():
        return left.join(right, keys, how)
    return salted_join(
        left, right, keys, how=how, salt_by=salt_by, right_salt_by=right_salt_by, hot=hot
    )


def key_skew_profile(df: DataFrame, on: str | list[str]) -> DataFrame:
    """How unevenly rows fall on keys: the measure to choose a join by.

    One row: ``n_keys, n_rows, max_rows, median_rows, skew_ratio``; the ratio is null for
    fewer than two keys.  All of it follows from how many keys have how many rows, a table of
    at most as many lines as there are different counts.
    """
    per_key = df.groupBy(*_names(on)).agg(F.count(F.lit(1)).alias("rows"))
    counts = per_key.groupBy("rows").agg(F.count(F.lit(1)).alias("keys"))
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("rows").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(
        "rows", "keys", F.sum("keys").over(upto).alias("through"), F.sum("keys").over(everything).alias("all")
    )
    before = F.col("through") - F.col("keys")

    def at(rank: Column) -> Column:
        return F.max(F.when((before < rank) & (rank <= F.col("through")), F.col("rows")))

    found = placed.agg(
        F.sum("keys").alias("n_keys"),
        F.sum(F.col("keys") * F.col("rows")).alias("n_rows"),
        F.max("rows").alias("max_rows"),
        ((at(F.expr("(all + 1) div 2")) + at(F.expr("all div 2 + 1"))) / 2).alias("median_rows"),
    )
    ratio = F.when(F.col("n_keys") >= 2, F.col("max_rows") / F.col("median_rows"))
    return found.where("n_keys > 0").withColumn("skew_ratio", ratio).select(
        "n_keys", "n_rows", "max_rows", F.when(F.col("n_keys") >= 2, F.col("median_rows")).alias("median_rows"), "skew_ratio"
    )


# --- aggregates over a join --------------------------------------------------------


def pair_totals(
    left: DataFrame, right: DataFrame, on: str | list[str], amount: str
) -> DataFrame:
    """Matched pairs per key and the sum of ``amount`` over them.

    Both sides are summed per key before they meet, so no pair is ever formed: a
    key with a million rows on either side costs one row, not a million million.
    """
    keys = _names(on)
    ours = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_amount"))
    theirs = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_matches"))
    return shuffle_join(ours, theirs, keys).select(
        *keys,
        (F.col("_rows") * F.col("_matches")).alias("matched_pairs"),
        (F.col("_amount") * F.col("_matches")).alias("total_amount"),
    )


def salted_pair_totals(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    amount: str,
    rows_per_salt: int = 5_000_000,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """``pair_totals`` with the left side kept as rows up to a salted join.

    The right side comes down to one row per key, so each left row meets at most
    one row; keys with more than ``rows_per_salt`` left rows, and they alone, are salted.
    """
    keys = _names(on)
    theirs = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_matches"))
    joined = salted_join(left, theirs, keys, salt_by=salt_by, hot=hot_keys(left, keys, rows_per_salt))
    return joined.groupBy(*keys).agg(
        F.sum("_matches").alias("matched_pairs"),
        F.sum(F.col(amount) * F.col("_matches")).alias("total_amount"),
    )
