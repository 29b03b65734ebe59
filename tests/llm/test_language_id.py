import numpy as np
import pytest
from conftest import MEDIUM
from odd_rows import by_id, documents
from pyspark.sql import functions as F

from plumbline.llm import langid
from plumbline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_on(spark.read.parquet(f"{MEDIUM}/documents.parquet"))


def test_held_out_accuracy(spark):
    told = QUERIES["op5_language_id"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = told.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert row[0] > 250 and row[1] > 0.96 and row[2] < 0.02 * row[0]


def test_odd_rows(spark, model):
    docs = documents(spark)
    told, (lang, score, rejected) = langid.identify(docs, model)
    rows = by_id(told)
    assert len(rows) == docs.count() and told.columns == [*docs.columns, lang, score, rejected]
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r[lang] == "und") == (not letters) and 0 <= r[score] <= 1
        assert r["lang_pred"] == "x7" and (letters or r[rejected])
        assert r[lang] in [*model.langs, "und"]


def test_only_the_text_counts(spark, model):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(50)
    plain, names = langid.identify(docs, model)
    blind, _ = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model)
    of = lambda df: [(r.text, *(r[n] for n in names)) for r in df.orderBy("doc_id").collect()]
    assert of(plain) == of(blind)


def test_long_texts_in_pieces(monkeypatch):
    text = np.frombuffer(("Straße und Weg " * 300).encode(), np.uint8)
    whole = langid.bucket_counts(text)
    monkeypatch.setattr(langid, "PIECE", 101)
    assert (langid.bucket_counts(text) == whole).all()


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    told, names = langid.identify(docs, langid.fit_on(docs))
    assert [told.first()[n] for n in names] == ["und", 0.0, True]
    assert langid.identify(docs.limit(0), langid.fit_on(docs.limit(0)))[0].count() == 0


def test_the_model_is_fitted_in_a_task(spark, model, monkeypatch):
    """The driver gets the folded model, not the sampled rows to fit on."""
    def refuse(rows):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(langid, "fit", refuse)
    again = langid.fit_on(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    assert again.langs == model.langs and np.array_equal(again.table, model.table) and np.array_equal(again.bias, model.bias)
    assert (again.temperature, again.threshold) == (model.temperature, model.threshold)


def test_without_labels_there_is_no_language(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "other text", None)], "doc_id bigint, text string, lang string")
    assert langid.fit_on(docs).langs == []
    assert langid.fit_on(docs.limit(0)).langs == []
