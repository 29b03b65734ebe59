import random

import numpy as np
import pytest

from plumbline.llm import embedding_dedup as ed
from plumbline.llm.components import components


def brute(rows, cosine=ed.COSINE):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (a, v, k), (b, w, m) = rows[i], rows[j]
            if None in (a, b, k, m) or k != m or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = rows[i][0] if rows[i][0] is None else min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and least == rows[i][0]))
    return sorted(out, key=str)


def made():
    rng = np.random.default_rng(3)
    rows, vec = [], 0
    for _ in range(12):
        base = rng.normal(size=16)
        for _ in range(12):
            rows.append((vec := vec + 1, (base + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.2])).tolist(), int(rng.integers(0, 2))))
    return rows + [
        (500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] + [1.0] * 15, 1), (504, [None] + [1.0] * 15, 1),
        (505, [float("inf")] + [1.0] * 15, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (508, [1.0, 2.0], None), (None, [1.0, 2.0], 1),
        (509, [1e-200, 2e-200], 1), (510, [0.0, -0.0, 1.0], 1), (511, [0.0, 0.0, 1.0], 1), (512, [5.0], 0), (513, [7.0], 0), (514, [-7.0], 0),
    ]


def ours(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS cls", "2 AS table", "3 AS block", "4 AS kept")
    return sorted((tuple(r) for r in ed.near_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize("block", [512, 5])
def test_links_equal_brute_force(spark, block):
    rows = made()
    assert ours(spark, rows, block=block) == brute(rows)


def test_recall_on_hard_pairs():
    """Pairs just at the threshold meet in some table nearly always."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    met = np.zeros(len(x), bool)
    for table in range(ed.TABLES):
        a, b = ed.buckets(x, table), ed.buckets(y, table)
        met |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.97


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(ed.rotated(x, 1, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ed.hadamard(ed.hadamard(x)), x)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert ed.near_vectors(df).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 60)] + [(200, 100 + i) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    links += [(7, 7), (5, 4), (None, 3)]
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        expected[node] = min(seen)
    got = components(spark.createDataFrame(links, "x bigint, y bigint")).collect()
    assert len(got) == len(expected) and {r.node: r.component_id for r in got} == expected
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0
