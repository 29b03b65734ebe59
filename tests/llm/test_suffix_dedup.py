import hashlib
import random

import numpy as np
import pytest
from odd_rows import DOCS, documents

from plumbline.llm import substring_dedup as sd


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        out.append((d, len(b), int(gone[:-1].sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def ours(docs, **options):
    return sorted((tuple(r) for r in sd.without_repeats(docs, **options).collect()), key=str)


def test_odd_rows(spark):
    assert ours(documents(spark)) == brute(DOCS, 200)


def made(seed):
    """Texts with shared passages at chance places, copies with edits, and long repetitions."""
    rng = random.Random(seed)
    letters = "abcdefgh "
    passages = ["".join(rng.choices(letters, k=rng.randint(30, 300))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(0, 200))))
        rows.append((i, "".join(parts)))
    for i in range(20):
        text = list(rows[i][1])
        for _ in range(2):
            if text:
                text[rng.randrange(len(text))] = "Z"
        rows.append((100 + i, "".join(text)))
    return rows + [(200, "ab" * 400), (201, "ab" * 150 + "c" + "ab" * 160), (202, "y" * 199), (203, "y" * 200), (204, "q" * 201)]


@pytest.mark.parametrize("length, grams", [(200, sd.GRAMS), (64, (16,)), (50, (20, 40)), (40, (40,))])
def test_shared_passages(spark, length, grams):
    rows = made(length)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert ours(docs, length=length, grams=grams) == brute(rows, length)


def test_long_texts_are_worked_on_in_parts(spark, monkeypatch):
    rows = made(3)
    text = "".join(t for _, t in rows)
    rows = [(1, text), (2, text[3000:9000] + "x" + text[100:700])]
    monkeypatch.setattr(sd, "PIECE", 1500)
    monkeypatch.setattr(sd, "slices", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc": [1, 2], "sig": [1, 2], "text": [t for _, t in rows]})
    parts = list(sd._anchorer(100, 30)(iter([batch])))
    starts = set()
    for part in parts:
        for doc, lo, hi in zip(part["doc"].to_pylist(), part["lo"].to_pylist(), part["hi"].to_pylist()):
            starts |= {(doc, s) for s in range(lo, hi + 1)}
    assert starts == {(d, s) for d, t in rows for s in range(len(t.encode()) - 99)}


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 3, 500) for _ in range(4)]
    order = sd.multikey_order(keys)
    got = [tuple(int(k[i]) for k in keys) for i in order]
    assert got == sorted(got)


def test_nothing(spark):
    assert ours(documents(spark).limit(0)) == []
    with pytest.raises(ValueError):
        sd.without_repeats(documents(spark), length=100, grams=(120,))


def test_texts_are_dealt_once(spark):
    """However many runs there are, they come to the texts: no join shuffles or broadcasts beside whole texts."""
    docs = spark.createDataFrame(made(3), "doc_id bigint, text string")
    names = {t.name for t in spark.catalog.listTables()}
    result = sd.without_repeats(docs)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Broadcast" not in plan
    assert {t.name for t in spark.catalog.listTables()} == names
    assert sorted(map(tuple, result.collect()), key=str) == brute(made(3), 200)
