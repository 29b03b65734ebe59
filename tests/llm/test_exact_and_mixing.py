import hashlib

from odd_rows import DOCS, by_id, documents

from plumbline.llm import exact_dedup, mixing

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def test_exact_groups_equal_brute_force(spark):
    groups = {}
    for doc, text, *_ in DOCS:
        groups.setdefault((text or "").translate(BLANKS), []).append((-len(text or ""), doc is None, doc))
    expected = []
    for norm, members in groups.items():
        known = [m for m in members if m[2] is not None] or members
        keep = min(known)[2]
        for _, _, doc in members:
            expected.append((doc, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    got = exact_dedup.exact_groups(documents(spark)).collect()
    key = lambda r: (str(r[0]), *map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expected, key=key)
    assert all(r.kept == (r.doc_id == r.keep_id) or r.doc_id is None for r in got)


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    """With a hash that is the same for all texts the groups are still right."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "aa"), (2, "a a"), (3, "b"), (4, "b "), (5, "c")], "doc_id bigint, text string")
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(documents(spark).limit(0)).count() == 0


def targets_by_rounds(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    fixed, budget = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_targets_and_copies(spark):
    sizes = {"a": 500, "b": 2000, None: 300, "B": 50, "z": 0, "ä": 900}
    rows = [(i, "w " * 10, None, s) for s, n in sizes.items() for i in range(n // 10)] + [(9999, None, None, "z")]
    counted, (size, whole, target, rate, copies) = mixing.mix_counts(documents(spark, rows))
    found = {r.source: r for r in counted.groupBy("source").agg({f"{target}": "max", f"{whole}": "max"}).collect()}
    expected = targets_by_rounds(sizes)
    for source, row in found.items():
        assert abs(row[1] - expected[source]) < 1e-6 * max(expected[source], 1) or abs(row[2] - expected[source]) < 1e-6 * max(expected[source], 1)
    taken = {r.source: r.t for r in counted.selectExpr("source", f"`{size}` * `{copies}` AS n").groupBy("source").agg({"n": "sum"}).toDF("source", "t").collect()}
    for source, n in sizes.items():
        assert abs(taken[source] - expected[source]) <= 0.25 * n + 60
    assert counted.where(f"`{copies}` > 2").count() == 0


def test_mix_emits_copies_and_repeats_itself(spark):
    docs = documents(spark)
    counted, names = mixing.mix_counts(docs)
    total = counted.agg({names[-1]: "sum"}).first()[0]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == total
    assert by_id(mixed) == by_id(mixing.mixed(docs.repartition(5)))


def test_mix_of_nothing_and_of_no_words(spark):
    assert mixing.mixed(documents(spark).limit(0)).count() == 0
    counted, names = mixing.mix_counts(documents(spark, [(1, None, None, None), (2, " ", None, "a")]))
    assert [r[names[2]] for r in counted.collect()] == [0.0, 0.0]


def test_smallest_and_largest_ids(spark):
    """No id is too small to be ordered."""
    low, high = -(2**63), 2**63 - 1
    docs = spark.createDataFrame([(low, "a b"), (high, "ab "), (5, "c"), (low, "c "), (high, "d")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(low, low, 2, True), (low, low, 2, True), (5, low, 2, False), (high, low, 2, False), (high, high, 1, True)]
