import re

import corpus_pipeline
from conftest import MEDIUM
from odd_rows import documents
from test_exact_and_mixing import BLANKS
from test_ngram_join import brute

from plumbline.llm import langid, pieces
from plumbline.llm.frames import kept


def test_stages_one_by_one(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]

    told, names = langid.identify(docs, langid.fit_on(docs))
    expected = {r.doc_id for r in told.collect() if not r[names[2]]}
    docs = kept(stages["language_id"](spark, docs, MEDIUM), "t")
    rows = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in rows} == expected and len(expected) > 950

    best = {}
    for r in rows:
        norm = r.text.translate(BLANKS)
        best[norm] = min(best.get(norm, (1, 0)), (-len(r.text), r.doc_id))
    docs = kept(stages["exact_dedup"](spark, docs, MEDIUM), "t")
    rows = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in rows} == {d for _, d in best.values()}

    near = brute([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    docs = kept(stages["ngram_join"](spark, docs, MEDIUM), "t")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {d for d, _, c in near if d == c}

    before = {r.doc_id: r for r in docs.collect()}
    docs = kept(stages["mixing"](spark, docs, MEDIUM), "t")
    rows = docs.collect()
    count = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert docs.columns == columns and all(before[r.doc_id] == r for r in rows)
    whole = sum(map(count, before.values()))
    assert abs(sum(map(count, rows)) - 1.5 * whole) < 0.1 * whole

    done = stages["sentencepiece"](spark, docs, MEDIUM)
    assert done.count() == len(rows) and done.where("NOT lossless").count() == 0


def test_odd_rows_pass_through(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, MEDIUM), f"odd-{name}")
    docs.count()
    empty = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, MEDIUM)
        assert empty.count() == 0
    assert pieces.SEED


def test_repeated_and_null_ids(spark):
    """Of each group of equal or near texts one row stays, whatever its id is shared with."""
    near = [f"n{i}" for i in range(60)]
    texts = [
        (9, "one two"), (9, "one two"), (None, "one two"),  # equal rows, and one more with a null id
        (1, "alpha beta"), (2, "alpha beta"), (2, "a text of its own"),  # an id shared with a copy
        (None, "gamma  delta"), (3, "gamma delta"), (4, "gamma delta"),  # the longest text has no id
        (None, "epsilon"), (None, "epsilon"), (None, None), (5, " "),
        (6, " ".join(near)), (7, " ".join([*near, "more"])), (7, "seven is a text of its own too"),
        (None, " ".join(["less", *near])), (8, "eight " * 9), (8, "ate " * 9),
    ]
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts]).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    best = {}
    for i, t in texts:
        norm = (t or "").translate(BLANKS)
        rank = (-len(t or ""), i is None, i or 0, t)
        best[norm] = min(best.get(norm, rank), rank)
    left = [(None if none else i, t) for _, none, i, t in best.values()]
    docs = kept(stages["exact_dedup"](spark, docs, MEDIUM), "t")
    assert sorted(map(str, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(str, left))

    groups = brute([(k, t) for k, (_, t) in enumerate(left)], 5, 80, 100)
    group = {k: c for k, _, c in groups}
    stay = {}
    for k, (i, t) in enumerate(left):
        rank = (i is None, i or 0, k)
        stay[group[k]] = min(stay.get(group[k], rank), rank)
    expected = [left[k] for *_, k in stay.values()]
    assert len(expected) == len(left) - 2
    for again in (docs, docs.unionAll(docs)):
        got = stages["ngram_join"](spark, again, MEDIUM).collect()
        found = [(r.doc_id, r.text) for r in got if r.text and r.text.strip()]
        assert sorted(map(str, found)) == sorted(str(x) for x in expected if x[1] and x[1].strip())
