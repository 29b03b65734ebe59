import hashlib
import math
import random
import re
from itertools import permutations

import public_tokenizers
import pytest
import tiktoken
from conftest import MEDIUM
from odd_rows import DOCS, documents
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, filter_audit, ranked_search
from plumbline.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def best(docs, items, k):
    """Every document scored for every item."""
    told = [(doc, terms(text)) for doc, text in docs]
    told = [(doc, found) for doc, found in told if found]
    n_docs, n_terms = len(told), sum(len(found) for _, found in told)
    df = {}
    for _, found in told:
        for t in set(found):
            df[t] = df.get(t, 0) + 1
    rows = []
    for item, text in items:
        ranked = []
        for doc, found in told:
            m = 10 + 90 * len(found) * n_docs // n_terms
            score = 0
            for t in set(terms(text)) & set(found):
                tf = found.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc))
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        rows += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(ranked[:k], 1)]
    return sorted(rows, key=str)


ITEMS = [(1, "the cat, the DOG!"), (2, None), (3, "..."), (4, "nothing-at-all words"), (5, "sehr viele Ääää worte"), (5, "one TWO 1234"), (None, "cat"), (6, "x" * 3000)]


@pytest.mark.parametrize("k", [1, 3])
def test_search_equals_brute_force(spark, k):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    found = [tuple(r) for r in ranked_search.search(documents(spark), items, k=k).collect()]
    assert sorted(found, key=str) == best([(d, t) for d, t, *_ in DOCS], ITEMS, k)


def test_search_in_small_blocks_and_slices(spark, monkeypatch):
    """Blocks of the index, slices of the scores and many partitions with equal scores change nothing."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "été", "x1"]
    docs = [(i // 2 if i % 50 else None, " ".join(rng.choices(words, weights=[9, 5, 3, 2, 1, 1], k=rng.randint(0, 6)))) for i in range(400)]
    items = [(i, " ".join(rng.sample(words, 3))) for i in range(12)]
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", 7)
    monkeypatch.setattr(ranked_search, "CELLS", 16)
    got = ranked_search.search(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(13),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(docs, items, 10)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranked_search.search(documents(spark).limit(0), items).count() == 0
    assert ranked_search.search(documents(spark), items.limit(0)).count() == 0
    assert ranked_search.search(documents(spark).where("doc_id in (3, 4, 5)"), items).count() == 0


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranked_search, "_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    index = ranked_search.Index.over([(1, {b"ab", b"cd", b"abc"}), (2, {b"cd"})])
    text = b"cd ab zz abc cd CD"
    n, doc, term, counts = index.matcher().counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert n.tolist() == [6]
    assert {index.words[t]: c for t, c in zip(term.tolist(), counts.tolist())} == {b"cd": 3, b"ab": 1, b"abc": 1}


# --- byte-level BPE ---------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_on_odd_rows(spark, encoding):
    rng = random.Random(5)
    texts = [t for _, t, *_ in DOCS] + [
        "   　 tabs\t\tand\r\n\r\n lines \u0085 x", "don't I'LL we're 12345 ½ ²³ ⅷ ٣٤", "漢字かな交じり文 한국어 ไทย हिन्दी",
        "".join(chr(rng.choice([*range(1, 0x300), *range(0x900, 0xA00), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F640)])) for _ in range(5000)),
        "".join(chr(c) for c in range(0xA7C0, 0xA800)) + "\U0003134a\U00031350\U000323b0՘a࢏", "a\x00b", "ab" * 4000, "aaaa " * 300,
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(6000)),
        " ".join("".join(rng.choice("etaoinsrh") for _ in range(rng.randint(1, 40))) for _ in range(400)),
    ]
    rows = [(i % 7, t, None, None) for i, t in enumerate(texts)]
    docs = documents(spark, rows).withColumn("token_ids", F.lit("clash")).withColumn("place", F.monotonically_increasing_id()).coalesce(3)
    told, ids = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, block_bytes=4000)
    told, raw = byte_bpe.decoded(told, RANKS, ids)
    assert told.columns[: len(docs.columns)] == docs.columns and ids == "_token_ids"
    got = told.collect()
    assert sorted(r.text or "" for r in got) == sorted(t or "" for t in texts)
    for r in got:
        assert list(r[ids]) == encoding.encode_ordinary(r.text or ""), r.text
        assert bytes(r[raw]) == (r.text or "").encode()


def test_every_code_point_is_split_as_in_the_library(encoding):
    """Letters and digits of late Unicode versions too, where tables of libraries differ."""
    import regex

    pattern = regex.compile(byte_bpe.as_in_tiktoken(public_tokenizers.PATTERN), regex.V1)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for lead in "a1":
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {w: 256 + i for i, w in enumerate((lead + c).encode() for c in points)}
        asked = tiktoken.Encoding("asked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        wrong = [c for c in points if (len(asked.encode_ordinary(lead + c)) == 1) != (pattern.match(lead + c).end() == 2)]
        assert wrong == []


def test_bytes_that_are_no_text_and_null_ids(spark, encoding):
    docs = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2, NULL")
    told, ids = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, keep_text=False)
    assert told.columns == ["doc_id", "token_ids"]
    assert {r.doc_id: list(r[ids]) for r in told.collect()} == {1: encoding.encode_ordinary("a�b"), 2: []}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 65])], "doc_id int, ids array<int>")
    back, raw = byte_bpe.decoded(odd, RANKS, "ids")
    assert [r[raw] and bytes(r[raw]) for r in back.orderBy("doc_id").collect()] == [None, b"", b"ab"]
    assert byte_bpe.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN)[0].count() == 0


def test_query_equals_the_library(spark, encoding):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, MEDIUM).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, sha = encoding.encode_ordinary(texts[r.doc_id]), lambda raw: hashlib.sha256(raw).hexdigest()
        expected = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected


# --- filter audit -----------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    """Each order replayed over all rows."""
    least = {}
    for doc, text, *_ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    rows = []
    for doc, text, _, source in docs:
        t = text or ""
        words = WORD.findall(t)
        checks = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": doc is not None and doc > least[t],
        }
        marks = [m for m in labels if doc is not None and m[0] == doc]
        good, toxic = (any(m[i] == 1 for m in marks) for i in (1, 2))
        rows.append((source or "", {f for f, bad in checks.items() if bad}, good, toxic))
    told = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                shapley[f] += len(gone)
                told[part, order, step] = [
                    len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for key, row in told.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {key: tuple(row) for key, row in told.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_replayed_orders(spark, monkeypatch):
    rng = random.Random(9)
    pool = ["word " * 60, " ".join(map(str, range(80))), "ABC " + "d " * 3, "a # b", "", None, "X$Y " * 70]
    rows = DOCS + [(rng.choice([None, *range(100, 160)]), rng.choice(pool), "en", rng.choice(["a", "b", "", None])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 160, 3), 102, 105, None]]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("clash"))
    monkeypatch.setattr(filter_audit, "RANGE_BITS", 3)
    got = filter_audit.audit(documents(spark, rows).repartition(3), marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_audit_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(documents(spark).limit(0), labels).count() == 0
    got = filter_audit.audit(documents(spark), labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == audited(DOCS, [])


def test_merges_and_differences_equal_sets():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(200), rng.choice([0, 1, 3, 30, 120]))) for _ in range(rng.randint(0, 5))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        found = {(f, before): n for f, before, n in filter_audit.differences(lists)}
        for f, ids in enumerate(lists):
            for before in range(1 << len(lists)):
                if not before >> f & 1:
                    others = set().union(*(lists[g] for g in range(len(lists)) if before >> g & 1))
                    assert found.get((f, before), 0) == len(set(ids) - others)
