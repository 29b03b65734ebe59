"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

Equal vectors of a label are one class, and classes are hashed.  Each table rotates the
unit vectors pseudo-randomly (three rounds of signs and a Hadamard transform) and takes
the nearest axis, with its sign, of several blocks as bucket.  Every class stands in its own
bucket and probes the next likely ones.  What meets in a bucket is verified in double
precision.  A bucket of any size is cut into blocks, and each pair of blocks is a task's
work of bounded size, so that no bucket has to be capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytestream import mix
from plumbline.llm.components import components
from plumbline.llm.frames import kept, named

COSINE = 0.98
TABLES = 10
AXES = 2  # cross-polytopes per table
PROBES = 2  # further buckets looked into per table
BLOCK = 512
SEED = 20269


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, axis: int, seed: int = SEED) -> np.ndarray:
    """Rows padded to a power of two and turned by the rotation of this table and axis."""
    d = 1 << max(int(x.shape[1] - 1).bit_length(), 0)
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for turn in range(3):
        key = np.uint64(seed * 1_000_003 + table * 10_007 + axis * 101 + turn)
        signs = mix(np.arange(d, dtype=np.uint64) + mix(np.array([key])))
        x = hadamard(x * np.where(signs >> np.uint64(63), 1.0, -1.0))
    return x


def buckets(x: np.ndarray, table: int, axes: int = AXES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of each row in one table: its own first, then the probed ones.

    A probe takes the second-best axis in one of the cross-polytopes, in the order of how
    little the value falls short of the best.
    """
    n = len(x)
    width = 2 * (1 << max(int(x.shape[1] - 1).bit_length(), 0))
    best, second, gap = [], [], []
    for axis in range(axes):
        r = rotated(x, table, axis)
        both = np.concatenate([r, -r], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :2]
        at = np.take_along_axis(both, top, axis=1)
        best.append(top[:, 0])
        second.append(top[:, 1])
        gap.append(at[:, 0] - at[:, 1])
    own = np.zeros(n, np.int64)
    for b in best:
        own = own * width + b
    found = [own]
    order = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")
    for k in range(min(probes, axes)):
        key = np.zeros(n, np.int64)
        for axis in range(axes):
            key = key * width + np.where(order[:, k] == axis, second[axis], best[axis])
        found.append(key)
    return np.stack(found, axis=1)


def unit(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """The vectors of a batch of one dimension, scaled to length one in double precision."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    x = values.reshape(batch.num_rows, -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hasher(tables: int, axes: int, probes: int):
    def hash_rows(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = unit(own)
                for table in range(tables):
                    keys = buckets(x, table, axes, probes)
                    for probe in range(keys.shape[1]):
                        yield pa.RecordBatch.from_arrays(
                            [
                                own.column("cls"),
                                own.column("label"),
                                own.column("dim"),
                                pa.array(np.full(len(x), table, np.int32)),
                                pa.array(keys[:, probe]),
                            ],
                            names=["cls", "label", "dim", "table", "bucket"],
                        )

    return hash_rows


RUN = ["label", "dim", "table", "bucket", "row", "column"]


def _block_verifier(cosine: float):
    """Links within each run of rows that share a bucket and a pair of blocks.

    Rows come sorted by run; only the run at hand is carried over, at most two blocks.
    """

    def links_of(run: pa.RecordBatch):
        x = unit(run)
        block, cls = run.column("block").to_numpy(), run.column("cls").to_numpy()
        row, column = run.column("row")[0].as_py(), run.column("column")[0].as_py()
        one = np.flatnonzero(block == row)
        other = np.flatnonzero(block == column)
        close = np.argwhere(x[one] @ x[other].T >= cosine - 1e-12)
        a, b = one[close[:, 0]], other[close[:, 1]]
        a, b = a[cls[a] != cls[b]], b[cls[a] != cls[b]]
        exact = (x[a] * x[b]).sum(axis=1) >= cosine
        a, b = cls[a[exact]], cls[b[exact]]
        return np.minimum(a, b), np.maximum(a, b)

    def verify(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carried is not None:
                batch = pa.concat_batches([carried, batch])
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for name in RUN:
                values = batch.column(name).to_numpy(zero_copy_only=False)
                change[1:] |= values[1:] != values[:-1]
            starts = np.append(np.flatnonzero(change), batch.num_rows)
            found = [links_of(batch.slice(s, e - s)) for s, e in zip(starts[:-2].tolist(), starts[1:-1].tolist()) if e - s > 1]
            carried = batch.slice(int(starts[-2]))
            if found:
                yield _pairs(found)
        if carried is not None and carried.num_rows > 1:
            yield _pairs([links_of(carried)])

    return verify


def _pairs(found) -> pa.RecordBatch:
    a, b = (np.concatenate(side) for side in zip(*found))
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    axes: int = AXES,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal label and dimension link when their cosine is at least ``cosine``.
    A null label, and a vector that is null, empty, zero or holds a null or non-finite
    component, link with nothing.  ``n_links`` counts other rows linked directly, equal
    vectors included; ``component_id`` is the smallest id reachable.  Rows with a null id
    link with nothing and are not kept; other columns are not looked at; an empty table
    gives no rows.  Every pair given out is verified; a true pair is missed only
    if it meets in no table, see the recall in the tests.
    """
    rows = vectors.select(
        named(id_col).cast("bigint").alias("vec_id"),
        named(label_col).alias("label"),
        named(vector_col).cast("array<double>").alias("vector"),
    )
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(
            (F.size("vector") > 0)
            & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("vector", lambda v: v != 0),
            F.lit(False),
        )
    )
    # 0.0 and -0.0 are the same component, in the class as in the cosine.
    same = F.transform("vector", lambda v: v + F.lit(0.0))
    good = rows.where(usable).withColumn("vector", same)
    classes = kept(
        good.groupBy("label", "vector").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vector")),
        "vector-classes",
    )
    members = kept(
        good.join(classes, ["label", "vector"]).select("vec_id", "cls", "copies"), "vector-members"
    )
    label = classes.schema["label"].dataType.simpleString()
    hashed = classes.select("cls", "label", "dim", "vector").mapInArrow(
        _hasher(tables, axes, probes), f"cls bigint, label {label}, dim int, table int, bucket bigint"
    )
    hashed = kept(hashed, "vector-buckets")
    key = ["label", "dim", "table", "bucket"]
    shared = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = (
        hashed.join(shared, key)
        .withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*key, "cls", "block", F.least("block", "with").alias("row"), F.greatest("block", "with").alias("column"))
    )
    met = placed.join(classes.select("cls", "vector"), "cls").repartition(*RUN).sortWithinPartitions(*RUN)
    links = kept(met.mapInArrow(_block_verifier(cosine), "a bigint, b bigint").distinct(), "vector-links")

    copies = classes.select("cls", "copies")
    both = links.union(links.select("b", "a")).toDF("cls", "other")
    linked = (
        both.join(copies.toDF("other", "others"), "other").groupBy("cls").agg(F.sum("others").alias("others"))
    )
    groups = components(links).toDF("cls", "component")
    told = (
        members.join(linked.join(groups, "cls"), "cls", "left")
        .select(
            "vec_id",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
