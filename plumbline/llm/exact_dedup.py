"""Exact duplicates: groups by a 128-bit content hash, proved by comparing bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import SPACES, kept, named


def without_spaces(text: Column) -> Column:
    """``text`` less its ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same bytes once white space is deleted; null
    and empty texts, and texts of white space alone, are one group.  Of a group the row
    with most code points in its original text stays, then the one with the smallest
    id.  Rows that repeat an id are each counted, and each kept if that id is.  An empty
    table gives no rows; columns other than those named are not looked at.

    With ``row_col``, a number that differs from row to row, exactly one row of a group
    is kept, whether ids repeat or are null: of equally long texts a null id comes last, and of equal
    ids the smallest number stays.  The number is then the last column, ``row``.

    The hash is MD5.  Counts and the row to stay combine before they are shuffled, so
    a group of any size is one row; only members of groups of two or more are compared
    byte by byte with the text that stays, in a join whose large keys adaptive
    execution splits.  Members that differ (a collision) are grouped anew by their bytes.
    """
    own, number = ("doc_id", []) if row_col is None else ("row", [named(row_col).cast("bigint").alias("row")])
    extra = ["row"] if number else []
    rows = docs.select(
        named(id_col).cast("bigint").alias("doc_id"),
        *number,
        without_spaces(named(text_col)).alias("norm"),
        F.coalesce(F.char_length(named(text_col)), F.lit(0)).alias("chars"),
    ).select(
        "doc_id", *extra, "chars", "norm", F.md5("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256")
    )
    # The order of preference: most code points, then the smallest id.  Flipped bits turn the order of all
    # bigints around; the smallest one has no negative.
    best = F.max(F.struct("chars", *(F.bitwise_not(c).alias(c) for c in ["doc_id", *extra]))).alias("best")
    firsts = kept(
        rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), best),
        "exact-firsts",
    )
    several = firsts.where("n > 1").select("hash", F.bitwise_not(F.col(f"best.{own}")).alias("first"))
    models = (
        rows.select(own, "hash", "norm")
        .join(several.hint("merge"), "hash")
        .where(f"{own} = first")
        .groupBy("hash")
        .agg(F.first("norm").alias("model"))
    )
    # ``odd`` holds the bytes of a member that shares the hash but not the text.
    compared = kept(
        rows.join(models.hint("merge"), "hash", "left").select(
            "doc_id",
            *extra,
            "chars",
            "hash",
            "text_sha256",
            F.when(F.col("model") != F.col("norm"), F.col("norm")).alias("odd"),
        ),
        "exact-compared",
    )
    groups = compared.groupBy("hash", "odd").agg(F.count(F.lit(1)).alias("group_size"), best)
    same = (F.col("m.hash") == F.col("g.hash")) & F.col("m.odd").eqNullSafe(F.col("g.odd"))
    return (
        compared.alias("m")
        .join(groups.alias("g").hint("merge"), same)
        .select(
            "m.doc_id",
            F.bitwise_not(F.col("g.best.doc_id")).alias("keep_id"),
            "g.group_size",
            (F.col(f"m.{own}") == F.bitwise_not(F.col(f"g.best.{own}"))).alias("kept"),
            "m.text_sha256",
            *(f"m.{c}" for c in extra),
        )
    )
