import random

import numpy as np
import pytest
from odd_rows import DOCS, documents

from plumbline.llm import ngram_join as nj

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
                leader[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), d if d is None or not sets[i] else least[find(i)]) for i, (d, *_) in enumerate(rows)), key=str)


def ours(docs, **options):
    return sorted((tuple(r) for r in nj.similar_texts(docs, **options).collect()), key=str)


def family(seed):
    """Copies with few and with many edits, chains of them, shared passages, and loners."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 30))
    passage = [word() for _ in range(12)]
    rows, doc = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 30)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text += passage
            if rng.random() < 0.2:
                base = text
            rows.append((doc := doc + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("n, num, den, block, common", [(4, 85, 100, 256, 64), (5, 80, 100, 3, 2), (2, 60, 100, 2, 64), (1, 50, 100, 4, 5)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, den, block, common):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "COMMON_SETS", common)
    rows = family(n)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert ours(docs, n=n, num=num, den=den) == brute(rows, n, num, den)


def test_odd_rows(spark):
    assert ours(documents(spark), n=4, num=85) == brute(DOCS, 4, 85, 100)
    assert ours(documents(spark).limit(0)) == []


def test_filters_keep_every_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = np.sort(rng.choice(10_000, 40, replace=False)).astype(np.uint64)
        x = np.sort(rng.choice(pool, rng.integers(1, 40), replace=False))
        y = np.sort(rng.choice(pool, rng.integers(1, 40), replace=False))
        both = len(np.intersect1d(x, y))
        assert nj.linked(x, y, 70, 100) == (100 * both >= 70 * (len(x) + len(y) - both))
        assert nj.may_link(nj.short_of(x), nj.short_of(y), 70, 100) or not nj.linked(x, y, 70, 100)
        crowded = [nj.short_of(s % np.uint64(7)) for s in (x, y)]
        assert nj.may_link(*crowded, 70, 100) or not nj.linked(x, y, 70, 100)
        assert (100 * both >= 70 * (len(x) + len(y) - both)) == (both >= nj.least_overlap(len(x), len(y), 70, 100))


def test_counts_across_batches(monkeypatch):
    """Counts of classes per shingle are the same however the batches are cut, copies and long runs included."""
    import pyarrow as pa

    monkeypatch.setattr(nj, "MOST_COUNTED", 6)
    rng = random.Random(4)
    counted = [(t, rng.randint(0, 15), 7, -1) for t in range(20) for _ in range(rng.choice([1, 1, 2, 5, 30]))]
    posted = [(t, rng.randint(0, 15), 7, 3) for t in range(20, 30)]
    rows = sorted(counted + posted)

    def run(size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([r[1] for r in p]), pa.array([r[2] for r in p]), pa.array([r[3] for r in p], pa.int32())], names=["token", "key", "meta", "place"]) for p in parts]
        return sorted(tuple(r.values()) for b in nj._counted(iter(batches)) for r in b.to_pylist())

    keys = {}
    for t, k, *_ in counted:
        keys.setdefault(t, set()).add(k)
    want = sorted((t, k, 7, -1, min(len(ks), 6)) for t, ks in keys.items() if len(ks) > 1 for k in ks)
    for size in (1, 2, 7, 100):
        found = run(size)
        assert [r for r in found if r[3] < 0] == want
        assert [r[:2] for r in found if r[3] >= 0] == [r[:2] for r in posted]


@pytest.mark.parametrize("common", [2, 64])
def test_prefixes_are_rarest_first(spark, monkeypatch, common):
    """Postings are the exact prefix of the documented order, whether shingles are common or not."""
    monkeypatch.setattr(nj, "COMMON_SETS", common)
    rows = family(11)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sets = {frozenset(nj.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 4)[0].tolist()) for _, t in rows}
    n_of, bucket = {}, np.zeros(1 << nj.SKETCH_BITS, np.int64)
    for s in sets:
        for x in s:
            n_of[x] = n_of.get(x, 0) + 1
    # Three tasks each count a class once, so a class may count up to three times in a bucket.
    found = docs.mapInArrow(nj._profiler(4), nj.PROFILE).where("bucket IS NOT NULL").collect()
    for r in found:
        bucket[r["bucket"]] += r["df"]
    for x, k in n_of.items():
        assert bucket[x >> (64 - nj.SKETCH_BITS)] >= k
    hot, below = nj.commons(bucket, len(sets)), int(2.0 * (1 - 85 / 100) * 2**64)

    def order(x):
        b = x >> (64 - nj.SKETCH_BITS)
        first = x < below and not hot[b]
        return (0, n_of[x], x - 2**64 if x >= 2**63 else x) if first else (1, int(bucket[b]), x)

    want = set()
    for s in sets:
        ranked = sorted(s, key=order)[: nj.prefix_length(len(s), 85, 100)]
        want |= {(x - 2**64 if x >= 2**63 else x, (i << 32) + len(s)) for i, x in enumerate(ranked) if n_of[x] > 1 or order(x)[0]}
    texts = docs.select("doc_id", "text")
    profile = texts.mapInArrow(nj._profiler(4), nj.PROFILE).where("bucket IS NULL")
    nodes = profile.select("cls", "n_shingles", "key").distinct()
    buckets = spark.sparkContext.broadcast((bucket, hot))
    got = {(r["token"], r["meta"]) for r in nj._postings(texts, nodes, 4, 85, 100, buckets).collect()}
    assert got == want


def _run_of_rows(sets, num, den):
    """Rows of one shingle that all sets post at their first place, each set a group of its own."""
    import pyarrow as pa

    n = len(sets)
    columns = {
        "token": [1] * n, "row": [0] * n, "column": [0] * n, "block": [0] * n, "meta": [len(x) for x in sets],
        "cls": [nj.set_class(x) for x in sets], "group": list(range(n)), "lead": [False] * n, "parity": [nj.parities(x) for x in sets],
    }
    kinds = {"row": pa.int32(), "column": pa.int32(), "block": pa.int32()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k)) for k, v in columns.items()], names=list(columns))
    found = [r for b in nj._crossing(num, den)(iter([batch])) for r in b.to_pylist()]
    return {frozenset((r["group_a"], r["group_b"])) for r in found if r["group_a"] != r["group_b"]}


@pytest.mark.parametrize("size", [1, 7, 60, 400, 3000])
def test_pairs_that_share_one_shingle_are_not_formed(size):
    """Of sets that meet in a shingle all similar pairs are formed; without the parities all 780 pairs were."""
    rng = np.random.default_rng(size)
    base = [np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(20)]
    near = [np.unique(np.append(x[: len(x) - len(x) // 20], rng.integers(0, 2**64, len(x) // 20, dtype=np.uint64))) for x in base]
    sets = base + near
    formed = _run_of_rows(sets, 85, 100)
    similar = {frozenset((i, j)) for i in range(40) for j in range(i) if nj.linked(sets[i], sets[j], 85, 100)}
    assert similar and similar <= formed
    if 60 <= size <= 400:
        assert len(formed) <= 2 * len(similar)


def test_shingles_are_handed_on_in_bounded_batches():
    """Before, a task gathered the shingles of a whole batch of texts, however many these were."""
    import types

    import pyarrow as pa

    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    none = np.zeros(1 << nj.SKETCH_BITS, np.int64)
    sent = list(nj._sender(4, 85, 100, types.SimpleNamespace(value=(none, none > 0)))(iter([batch])))
    assert len({k for b in sent for k in b.column("key").to_pylist()}) == len(texts)
    assert sum(b.num_rows for b in sent) > 2 * nj.SENT_ROWS and max(b.num_rows for b in sent) < nj.SENT_ROWS + 400
