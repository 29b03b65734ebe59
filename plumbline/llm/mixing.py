"""Mixing sources to target weights by repeating and sampling whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import WORD, fresh, join_small, kept, named

# Fixed values of the production mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20261


def words(text: Column) -> Column:
    """Number of words in ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """``source`` without nulls: a name of its own stands for the missing source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """From rows ``key, source, size`` one row per source: ``key, source_size, target, rate``.

    Sources in code-point order, the missing one last, take ``weights`` in turn and
    divide ``share`` times the whole size.  A target never exceeds ``most`` times its
    source; what it leaves is shared anew by weight.  That is water filling:
    each target is the smaller of its limit and ``level * weight``, and the level
    follows from running sums over the sources in order of limit per weight.  There is
    one row per source, so the windows below order a list of names and not documents.
    A source of size 0 has target and rate 0.
    """
    per_source = sizes.groupBy("key").agg(
        F.sum("size").alias("source_size"), F.first("source").alias("source")
    )
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    limited = per_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    by_limit = whole.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = (
        limited.withColumn("budget", F.sum("source_size").over(whole) * share)
        # If this source and those above it share what those below their limits leave:
        .withColumn("left", F.col("budget") - (F.sum("limit").over(so_far) - F.col("limit")))
        .withColumn("open", F.sum("weight").over(whole) - F.sum("weight").over(so_far) + F.col("weight"))
        .withColumn("try", F.col("left") / F.col("open"))
        .withColumn("fits", F.col("try") * F.col("weight") <= F.col("limit"))
        # The first source that stays below its limit sets the level for all after it.
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "try"))).over(whole)["try"])
    )
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return levels.select(
        "key",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def mix_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> tuple[DataFrame, list[str]]:
    """``docs`` with five more columns, whose names come second.

    They are the document's size in words, its source's size and target, its source's rate,
    and the number of copies the mix takes of it: the whole part of the rate, and
    one more with the probability of the fraction, drawn by a hash of id and seed.
    A null id draws like any other value; equal ids draw alike.  Null texts have
    size 0, the null source is a source.  Further columns are left as they are,
    whatever their names.
    """
    names = []
    for name in ("size", "source_size", "target", "rate", "copies"):
        names.append(fresh(docs, name))
    size, whole, target, rate, copies = names
    key = fresh(docs, "key")
    sized = docs.withColumn(size, words(named(text_col))).withColumn(key, source_key(named(source_col)))
    targets = kept(
        source_targets(
            sized.select(named(key).alias("key"), named(source_col).cast("string").alias("source"), named(size).alias("size")),
            weights, share, most,
        ),
        "mix-targets",
    ).toDF(key, whole, target, rate)
    # Thirteen hexadecimal digits are 52 bits: every draw is an exact double below one.
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit("-")))
    draw = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    counted = join_small(sized, targets, key).withColumn(
        copies,
        (F.floor(named(rate)) + F.when(draw < named(rate) - F.floor(named(rate)), 1).otherwise(0)).cast("int"),
    )
    return counted.drop(key), names


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, columns unchanged."""
    counted, names = mix_counts(docs, **options)
    copy = fresh(counted, "copy")
    repeated = counted.where(named(names[-1]) > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(1), named(names[-1])))
    )
    return repeated.select(*(named(c) for c in docs.columns))
