"""A corpus made ready for training: the stages, in order, and the run over all of them.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of the documents.  Stages that drop copies tell rows apart by a number
of their own: ids, which may repeat or be null, only say which row of a group stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, langid, mixing, ngram_join, pieces
from plumbline.llm.frames import fresh, join_small, kept, named, table

NEAR_WORDS = 5
NEAR_PERCENT = 80


def _with_rows(docs: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that it stays the same, and the column's name."""
    row = fresh(docs, "row_key")
    return kept(docs.withColumn(row, F.monotonically_increasing_id()), what), row


def _without(docs: DataFrame, row: str, rows: DataFrame, what: str) -> DataFrame:
    """``docs`` less the rows whose number is among ``rows``, and less the numbers."""
    left = join_small(docs, kept(rows.toDF(row), what), row, "left_anti")
    return left.select(*(named(c) for c in docs.columns if c != row))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; texts without a letter go."""
    told, (_, _, rejected) = langid.identify(docs, langid.fit_on(docs))
    return told.where(~named(rejected)).select(*(named(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    docs, row = _with_rows(docs, "exact-rows")
    groups = exact_dedup.exact_groups(docs, row_col=row)
    return _without(docs, row, groups.where("NOT kept").select("row"), "exact-dropped")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, a null id last."""
    docs, row = _with_rows(docs, "near-rows")
    found = ngram_join.similar_texts(docs, id_col=row, n=NEAR_WORDS, num=NEAR_PERCENT, den=100)
    groups = kept(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("grp")), "near-groups")
    # Texts like no other are groups of one row and stay.
    several = groups.where("row <> grp").select("grp").distinct()
    members = groups.join(several, "grp").join(docs.select(named(row).alias("row"), named("doc_id").alias("id")), "row")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stay = members.groupBy("grp").agg(F.min(order)["row"].alias("row"))
    dropped = members.select("row").join(stay.select("row"), "row", "left_anti")
    return _without(docs, row, dropped, "near-dropped")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their sampled pieces, and whether these decode to the text."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))[0]


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# Learned language models and sampled pieces have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
