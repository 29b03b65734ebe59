"""How filters interact: who removes what in every order, from sorted posting lists.

Every filter has a posting list of the rows it fails, per part and per range of row numbers.
A task takes the ranges that fall to it, merges lists into unions and counts differences, both
by galloping: of the list whose next id is smallest, all ids below the next one of the others
are taken at once.  What a filter fails and those before it do not are the only numbers
needed, 80 per part for five filters; they add up over ranges, and all orders are read off them.
A range holds a bounded number of rows, so a part of any size is many small lists.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import join_small, kept, named

RANGE_BITS = 16
WORDS = r"[^\x20\x09-\x0D]+"


def gallop(ids: list[int], target: int, at: int) -> int:
    """The first place from ``at`` on with an id of at least ``target``, in steps that double."""
    step, low = 1, at
    while low + step < len(ids) and ids[low + step] < target:
        low += step
        step *= 2
    return bisect_left(ids, target, low, min(low + step, len(ids)))


def union(lists: list[list[int]]) -> list[int]:
    """All ids of sorted lists, each once, in order."""
    live = [(ids, 0) for ids in lists if ids]
    merged: list[int] = []
    while len(live) > 1:
        live.sort(key=lambda run: run[0][run[1]])
        (ids, at), rest = live[0], live[1:]
        other, place = rest[0]
        end = gallop(ids, other[place], at)
        merged += ids[at:end]
        # An id of both is left to the other list.
        if end < len(ids) and ids[end] == other[place]:
            end += 1
        live = rest if end == len(ids) else [(ids, end), *rest]
    for ids, at in live:
        merged += ids[at:]
    return merged


def difference_size(ids: list[int], other: list[int]) -> int:
    """How many of the sorted ``ids`` the sorted ``other`` does not hold."""
    at = place = both = 0
    while at < len(ids) and place < len(other):
        if ids[at] == other[place]:
            both, at, place = both + 1, at + 1, place + 1
        elif ids[at] < other[place]:
            at = gallop(ids, other[place], at)
        else:
            place = gallop(other, ids[at], place)
    return len(ids) - both


def differences(lists: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Filter, set of filters before it as bits, and how many ids only the filter fails of these."""
    filled = sum(1 << f for f, ids in enumerate(lists) if ids)
    unions = {0: []}
    for before in range(1, 1 << len(lists)):
        # Empty lists change nothing: each union is made once.
        if before & ~filled == 0:
            unions[before] = union([ids for f, ids in enumerate(lists) if before >> f & 1])
    for f, ids in enumerate(lists):
        sizes: dict[int, int] = {}
        for before in range(1 << len(lists)) if ids else ():
            if not before >> f & 1:
                own = before & filled
                if own not in sizes:
                    sizes[own] = difference_size(ids, unions[own])
                if sizes[own]:
                    yield f, before, sizes[own]


SIZES = "part string, filter int, before int, n bigint, good bigint, toxic bigint"
_SIZES = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), ("n", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])


def _auditor(n_filters: int):
    """Sums of differences per part, of rows sorted by range, part and row number.

    A row of filter -1 counts the rows of its part.  Only the range at hand is held.
    """

    def of_part(part, rows, fails, good, toxic):
        yield part, -1, 0, len(rows), 0, 0
        sums: dict[tuple[int, int], list[int]] = {}
        for tag, chosen in enumerate((np.ones(len(rows), bool), good, toxic)):
            lists = [rows[chosen & (fails >> f & 1 == 1)].tolist() for f in range(n_filters)]
            for f, before, n in differences(lists):
                sums.setdefault((f, before), [0, 0, 0])[tag] = n
        for key, found in sums.items():
            yield part, *key, *found

    def of_range(held):
        table = pa.Table.from_batches(held)
        parts = table.column("part").combine_chunks().dictionary_encode()
        code = parts.indices.to_numpy()
        rows, fails, good, toxic = (table.column(c).to_numpy() for c in ("row", "fails", "good", "toxic"))
        starts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)).tolist()
        told = [
            row
            for a, b in zip(starts[:-1], starts[1:])
            for row in of_part(parts.dictionary[int(code[a])].as_py(), rows[a:b], fails[a:b], good[a:b], toxic[a:b])
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), _SIZES)], schema=_SIZES)

    def audit(batches):
        held, current = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges = batch.column("range").to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])), len(ranges)).tolist()
            for a, b in zip(starts[:-1], starts[1:]):
                if held and ranges[a] != current:
                    yield of_range(held)
                    held = []
                held.append(batch.slice(a, b - a))
                current = ranges[a]
        if held:
            yield of_range(held)

    return audit


def text_failures(text: Column) -> list[Column]:
    """The four filters that look at one text: few words, repeated words, capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words)
    return [
        n < 50,
        100 * F.size(F.array_distinct(words)) < 65 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row ``row, part, fails, good, toxic``: a number, its source, its failed filters as bits
    from A up, and its labels.

    Filter E fails rows whose text a row with a smaller id has, told by 256 bits of hash; the
    smallest id of a text combines before it is shuffled, and only texts with several ids are joined.
    """
    text = F.coalesce("text", F.lit(""))
    fails = reduce(Column.bitwiseOR, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))))
    rows = kept(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.coalesce("source", F.lit("")).alias("part"),
            fails.alias("own"),
            F.unhex(F.sha2(text, 256)).alias("hash"),
        ),
        "audit-rows",
    )
    same = rows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = kept(same.where("least < most").select("hash", "least"), "audit-copies")
    told = kept(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        ),
        "audit-labels",
    )
    joined = join_small(join_small(rows, several, "hash", "left"), told, "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return joined.select("row", "part", F.col("own").bitwiseOR(copy).alias("fails"), flag("good"), flag("toxic"))


def interactions(rows: DataFrame, letters: str) -> DataFrame:
    """What each filter does at each step of every order, from ``row, part, fails, good, toxic``.

    Bit i of ``fails`` stands for letter i; ``row`` differs from row to row.  Per part, order and step:
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``,
    zeros included, where ``shapley`` sums what the step's filter removes over all orders.  Parts
    without rows do not occur; an empty table gives no rows.
    """
    spark, count = rows.sparkSession, len(letters)
    ranged = rows.withColumn("range", F.shiftright("row", RANGE_BITS))
    sizes = (
        ranged.repartition("range")
        .sortWithinPartitions("range", "part", "row")
        .mapInArrow(_auditor(count), SIZES)
        .groupBy("part", "filter", "before")
        .agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    )
    sizes = kept(sizes, "audit-sizes")
    steps = [
        (number, "".join(letters[f] for f in order), at + 1, order[at], sum(1 << g for g in order[:at]))
        for number, (order, at) in enumerate((o, i) for o in permutations(range(count)) for i in range(count))
    ]
    # A fixed table: as many rows as there are orders times filters.
    steps = F.broadcast(spark.createDataFrame(steps, "number int, filter_order string, step int, filter int, before int"))
    parts = sizes.where("filter = -1").select("part", F.col("n").alias("rows"))
    all_steps = parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(_factorial(count) * count - 1)))).join(steps, "number")
    found = all_steps.join(sizes.where("filter >= 0"), ["part", "filter", "before"], "left").select(
        *all_steps.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good", "toxic"))
    )
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("part", "filter")
    alone = F.max(F.when(F.col("before") == 0, F.col("n"))).over(same)
    last = F.max(F.when(F.col("step") == count, F.col("n"))).over(same)
    return found.select(
        "part", "filter_order", "step",
        (F.col("rows") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (alone - F.col("n")).alias("redundant"),
        last.alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(same).alias("shapley"),
    )


def _factorial(n: int) -> int:
    return n * _factorial(n - 1) if n > 1 else 1


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """Five text filters in all 120 orders, per part; see ``interactions`` for the columns.

    A fails texts of fewer than 50 words, B with fewer than 65 distinct words in 100, C with more
    than 5 capitals A-Z in 100 code points, D with one of ``#$%&*|``, and E texts that a row
    with a smaller id has.  Words are runs without ASCII white space.  Null texts are empty: they
    fail A, and E if they are not the first.  A null part is the empty string.  Every row counts, rows that
    repeat an id too; of these none is smaller than the other.  A null id is neither smaller nor
    larger than others and has no label.  ``labels`` with several rows of an id count if one of them
    does; null labels do not.  Other columns are not looked at, and no documents give no rows.
    """
    plain = docs.select(
        named(id_col).cast("bigint").alias("doc_id"),
        named(text_col).alias("text"),
        named(part_col).cast("string").alias("source"),
    )
    marks = labels.select(named("doc_id").cast("bigint").alias("doc_id"), named("quality"), named("toxic"))
    return interactions(failures(plain, marks), "ABCDE")
