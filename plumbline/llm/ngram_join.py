"""Similarity join of texts by Jaccard on word n-grams, with rare-first prefix filtering.

Texts become sets of hashed shingles.  Texts with the same set are one class, and
classes are compared.  A class posts only a prefix of its set, rarest shingles first: two
sets as similar as asked share a shingle of their prefixes.  Rarity is the exact number of
classes that hold a shingle, counted over all documents for a share of the hashes that is
twice as large as prefixes are; the order of these goes before that of all other shingles.
A shingle of one class fills a place of the prefix and is not posted, as nobody meets there.
Classes that meet in a shingle
are candidates if their sizes allow it (length filter), and if what follows the
shared place can still hold enough (positional filter).  Each candidate pair is then
verified once: by sixteen bits of each hash, which can only overrate what two sets share and
travel at a quarter of the size, and what passes by halves (suffix filter) and exactly.

Links only have to connect, so not all pairs that meet in a shingle are formed.  First each
class meets the one that posts the shingle earliest, which of near copies is the one with the
fewest words of its own.  Then only classes that are still apart are paired, in blocks of
bounded size, until no candidate is left untested.  There each posting brings the parities of
its set (bitmap filter): a shingle that only one of two sets holds flips one bit, so where more
bits differ than shingles may, the pair cannot be similar and is not formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytestream import flat, release_unused, released, shingles, signed, slices
from plumbline.llm.components import components
from plumbline.llm.frames import join_small, kept, named

# Counts of shingles by hash bucket.  They tell only which shingles are in more than about one
# of 64 sets, for which a table of fixed size is enough however large the corpus is: these come
# last in every prefix, and no task has to count them.
SKETCH_BITS = 17
COMMON_SHARE = 64
COMMON_SETS = 64
# Shingles of so many sets or more are equally rare; a task holds the rows of one up to there.
MOST_COUNTED = 4096
# Classes a task remembers in order not to send copies twice.
REMEMBERED = 1 << 17
# Rows of a common shingle are spread over so many partitions.
SALTS = 64
# Classes that a task holds at once come in blocks of about so many.
BLOCK = 256
# Rows of shingles that a task gathers before it hands them on; a batch of texts has many times as many.
SENT_ROWS = 1 << 16
# Bits of the parities of a set; sets of up to several times as many shingles are told apart.
PARITY_BITS = 512


def set_class(found: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sets_of(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    data, offsets = flat(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        yield from zip(ids[first:last], shingles(data[part[0] : part[-1]], part - part[0], n))


PROFILE = "doc_id bigint, n_shingles bigint, cls binary, key bigint, parity binary, bucket int, df bigint"
_PROFILE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("key", pa.int64()), ("parity", pa.binary()), ("bucket", pa.int32()), ("df", pa.int64())])


def class_key(cls: bytes) -> int:
    """The first 64 bits of a class as a signed number.

    Should two classes share them, both get the shingles of both, at earlier places than their own:
    more is compared then, and no link lost.
    """
    return int.from_bytes(cls[:8], "little", signed=True)


def parities(found: np.ndarray) -> bytes:
    """Whether an odd number of a set's shingles fall on each bit.  Two sets differ in as many
    shingles as their parities do in bits, or in more."""
    counts = np.bincount((found & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits(counts & 1).tobytes()


def _buckets(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _first_time(cls: bytes, seen: set) -> bool:
    """Whether the task does not remember the class; copies it has forgotten do no harm."""
    if cls in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(cls)
    return True


def _profiler(n: int):
    """Size and class of each text, and per task the counts of its shingles by bucket."""

    def profile(batches):
        release_unused()
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        for batch in batches:
            ids, sizes, classes, bits = [], [], [], []
            for doc, found in sets_of(batch, n):
                cls = set_class(found)
                bits.append(parities(found))
                ids.append(doc)
                sizes.append(len(found))
                classes.append(cls)
                if len(found) and _first_time(cls, seen):
                    np.add.at(sketch, _buckets(found), 1)
            none = pa.nulls(len(ids))
            keys = [class_key(c) for c in classes]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], schema=_PROFILE)
        used = np.flatnonzero(sketch)
        none = pa.nulls(len(used))
        no_number = none.cast(pa.int64())
        yield pa.RecordBatch.from_arrays([no_number, no_number, none.cast(pa.binary()), no_number, none.cast(pa.binary()), pa.array(used.astype(np.int32)), pa.array(sketch[used])], schema=_PROFILE)

    return profile


def least_overlap(x, y, num: int, den: int):
    """Fewest common elements of sets of sizes x and y with Jaccard >= num / den."""
    return -((-num * (x + y)) // (num + den))


def prefix_length(size, num: int, den: int):
    """Shingles of a set of which a similar set must share one."""
    return size - -(-num * size // den) + 1


def commons(counts: np.ndarray, sets: int) -> np.ndarray:
    """Buckets with a shingle that too many of the sets hold to be counted by one task."""
    return counts > 2 * counts.mean() + sets / COMMON_SHARE + COMMON_SETS


SENT = "token bigint, key bigint, meta bigint, place int"


def _sender(n: int, num: int, den: int, buckets):
    """The shingles of a class that are to be counted, and those posted as they are.

    Order of all shingles: first those to be counted, which are the lower hashes unless their bucket is
    common, then the others by the count of their bucket.  Rows to be counted have no place yet; ``meta``
    is how many a class has of them and the size of its set.  A class with fewer than its prefix is
    long posts the rest from the others, whose places are known.
    """
    below = np.uint64(min(int(2.0 * (1 - num / den) * 2**64), 2**64 - 1))

    def rows_of(tokens, keys, metas, places):
        columns = [signed(np.concatenate(tokens)), np.concatenate(keys), np.concatenate(metas), np.concatenate(places)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "meta", "place"])

    def send(batches):
        release_unused()
        (df, common), seen = buckets.value, set()
        for batch in batches:
            tokens, keys, metas, places, held = [], [], [], [], 0
            for _, found in sets_of(batch, n):
                size = len(found)
                cls = set_class(found)
                if not size or not _first_time(cls, seen):
                    continue
                length = prefix_length(size, num, den)
                lower = int(np.searchsorted(found, below))
                counted = found[:lower][~common[_buckets(found[:lower])]]
                mine = [counted]
                if len(counted) < length:
                    rest = np.setdiff1d(found, counted, assume_unique=True)
                    # Stable on sorted hashes: ties go by hash, the same way in every text.
                    order = np.argsort(df[_buckets(rest)], kind="stable")[: length - len(counted)]
                    mine.append(rest[order])
                    places.append(np.full(len(counted), -1, np.int32))
                    places.append(np.arange(len(counted), length, dtype=np.int32))
                else:
                    places.append(np.full(len(counted), -1, np.int32))
                sent = sum(map(len, mine))
                tokens += mine
                keys.append(np.full(sent, class_key(cls)))
                metas.append(np.full(sent, (len(counted) << 32) + size))
                held += sent
                if held >= SENT_ROWS:
                    yield rows_of(tokens, keys, metas, places)
                    tokens, keys, metas, places, held = [], [], [], [], 0
            if tokens:
                yield rows_of(tokens, keys, metas, places)

    return send


COUNTED = "token bigint, key bigint, meta bigint, place int, df int"


def _counted(batches):
    """Of rows sorted by token and key, those whose token two classes have, with how many have it.

    Rows with a place go through.  Copies sent by several tasks stand side by side and count once.
    Only the rows of the token at hand are carried on, ``MOST_COUNTED`` of them at most.
    """

    def told(rows: pa.RecordBatch, df: np.ndarray):
        wanted = np.flatnonzero((df > 1) | (rows.column("place").to_numpy() >= 0))
        if len(wanted):
            at = pa.array(wanted)
            columns = [rows.column(c).take(at) for c in ("token", "key", "meta", "place")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(df[wanted].astype(np.int32))], names=["token", "key", "meta", "place", "df"])

    carried, many = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if carried is None else pa.concat_batches([carried, batch])
        token, key = rows.column("token").to_numpy(), rows.column("key").to_numpy()
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1])
        if again.any():
            rows = rows.filter(pa.array(~again))
            token = token[~again]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        sizes[sizes >= MOST_COUNTED] = MOST_COUNTED
        if many is not None and token[0] == many:
            sizes[0] = MOST_COUNTED
        last = int(starts[-1])
        if sizes[-1] == MOST_COUNTED:
            many = int(token[last])
            # The last row stays at hand, so that its copy in the next batch is known as one.
            last = len(token) - 1
        df = np.repeat(sizes, np.diff(np.append(starts, len(token))))
        yield from told(rows.slice(0, last), df[:last])
        carried = rows.slice(last)
    if carried is not None:
        size = MOST_COUNTED if many is not None and carried.column("token")[0].as_py() == many else carried.num_rows
        yield from told(carried, np.full(carried.num_rows, size))


def _postings(texts: DataFrame, nodes: DataFrame, n: int, num: int, den: int, buckets) -> DataFrame:
    """``token, meta, cls``: prefixes less the shingles of one class.  ``meta`` is the place in the set
    and the set's size."""
    sent = texts.where("doc_id IS NOT NULL").mapInArrow(released(_sender(n, num, den, buckets)), SENT)
    # Common shingles have a place already; their rows need not come together.
    salt = F.when(F.col("place") >= 0, F.pmod("key", F.lit(SALTS))).otherwise(F.lit(0))
    counted = kept(
        sent.repartition("token", salt).sortWithinPartitions("token", "key").mapInArrow(released(_counted), COUNTED), "ngram-counted"
    )
    size, own = F.col("meta").bitwiseAND(0xFFFFFFFF), F.shiftright("meta", 32)
    by_class = Window.partitionBy("key", "meta")
    # Shingles of this class alone come first, then the others by how many classes have them.
    ranked = counted.where("place < 0").withColumn(
        "place",
        (
            F.greatest(own - F.count(F.lit(1)).over(by_class), F.lit(0))
            + F.row_number().over(by_class.orderBy("df", "token")) - 1
        ).cast("int"),
    )
    length = F.col("size") - F.expr(f"({num} * size + {den} - 1) div {den}") + 1
    placed = (
        ranked.unionByName(counted.where("place >= 0"))
        .select("token", "key", size.alias("size"), F.col("place").cast("bigint").alias("place"))
        .where(F.col("place") < length)
    )
    # Which classes post is little beside the texts; a key shared by two classes goes to both.
    found = placed.join(nodes.select("cls", "key", F.col("n_shingles").alias("size")).hint("merge"), ["key", "size"])
    return found.select("token", (F.shiftleft("place", 32) + F.col("size")).alias("meta"), "cls").distinct()


def _meetings(postings: DataFrame) -> DataFrame:
    """Postings whose shingle another class posts too, each with its shingle's first posting.

    The first is a minimum, which combines before it is shuffled; joined back it is the side with one
    row per shingle, so the rows of a common one can be split over tasks.
    """
    lead = (
        postings.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("meta", "cls")).alias("lead"))
        .where("n > 1")
        .select("token", F.col("lead.meta").alias("first_meta"), F.col("lead.cls").alias("first"))
    )
    return postings.join(lead.hint("merge"), "token").select("token", "meta", "cls", "first_meta", "first")


def _may_link(meta_a: str, meta_b: str, num: int, den: int):
    """Length and positional filter on the two ``meta`` columns.

    Similar sets pass at the first shingle their prefixes share: nothing before it is shared,
    and what is left after later ones is only less.
    """
    i, j = F.shiftright(meta_a, 32), F.shiftright(meta_b, 32)
    x, y = F.col(meta_a).bitwiseAND(0xFFFFFFFF), F.col(meta_b).bitwiseAND(0xFFFFFFFF)
    most = F.least(x - i, y - j)
    return (
        (F.least(x, y) * den >= F.greatest(x, y) * num)
        & (most * (num + den) >= (x + y) * num)
    )


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least num / den."""
    need = int(least_overlap(len(x), len(y), num, den))
    if min(len(x), len(y)) < need:
        return False
    # Suffix filter: what lies on either side of a value meets only on that side.
    pivot = y[len(y) // 2]
    a, b = int(np.searchsorted(x, pivot)), len(y) // 2
    if min(a, b) + min(len(x) - a, len(y) - b) < need:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def short_of(found: np.ndarray) -> np.ndarray:
    """Sixteen bits of each hash of a set, sorted."""
    return np.sort(found.astype(np.uint16))


def may_link(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sets with these short hashes can be similar: equal hashes have equal short ones,
    each of which counts as often as both sides have it."""
    shared = np.intersect1d(_numbered(x), _numbered(y), assume_unique=True)
    return len(shared) >= least_overlap(len(x), len(y), num, den)


def _numbered(short: np.ndarray) -> np.ndarray:
    """Sorted values made distinct: the second of equal ones is another value than the first."""
    first = np.searchsorted(short, short)
    return short.astype(np.uint64) | ((np.arange(len(short)) - first).astype(np.uint64) << np.uint64(16))


PAIR = "a binary, b binary, group_a bigint, group_b bigint, rank bigint"
_PAIR_COLUMNS = ["a", "b", "group_a", "group_b", "rank"]


def _verifier(num: int, den: int, exact: bool):
    """Pairs that pass, among the pairs of each pair of blocks.

    Rows are sorted so that the sets of a pair of blocks come before its pairs; the sets of one
    pair of blocks are held at a time.  In the exact test a pair whose ends earlier links of
    the task connect is not looked at again.
    """
    test, dtype = (linked, np.uint64) if exact else (may_link, np.uint16)

    def verify(batches):
        key, sets, leader = None, {}, {}

        def find(x):
            while (up := leader.get(x, x)) != x:
                leader[x] = leader.get(up, up)
                x = up
            return x

        for batch in batches:
            keys = zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())
            passed = []
            columns = [batch.column(n).to_pylist() for n in ("a", "b", "group_a", "group_b")]
            contents = batch.column("set")
            for i, (own, a, b, group_a, group_b) in enumerate(zip(keys, *columns)):
                if own != key:
                    key, sets, leader = own, {}, {}
                if b is None:
                    sets[a] = np.frombuffer(contents[i].as_py(), dtype)
                    continue
                if exact:
                    group_a, group_b = find(group_a), find(group_b)
                    if group_a == group_b:
                        continue
                if test(sets[a], sets[b], num, den):
                    leader[group_b] = group_a
                    passed.append(i)
            yield batch.select(_PAIR_COLUMNS).take(pa.array(passed, pa.int64()))

    return verify


def _set_maker(n: int, short: bool):
    def make(batches):
        for batch in batches:
            classes, sets, size = [], [], 0
            for _, found in sets_of(batch, n):
                classes.append(set_class(found))
                sets.append((short_of(found) if short else found).tobytes())
                size += len(sets[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "set"])
                    classes, sets, size = [], [], 0
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "set"])

    return make


def _sets(texts: DataFrame, ids: DataFrame, n: int, short: bool) -> DataFrame:
    """``cls, set`` of the texts with the given ids, one row per class."""
    some = join_small(texts, kept(ids, "ngram-wanted"), "doc_id")
    return some.mapInArrow(released(_set_maker(n, short)), "cls binary, set binary").dropDuplicates(["cls"])


def _passing(pairs: DataFrame, sets: DataFrame, homes: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """Of pairs of classes, those that pass.

    A class has a home: the least of the shingles it meets others in, which near copies have in
    common.  Homes are cut into blocks, and a set travels once to each pair of blocks that has
    pairs with it, however many these are.
    """
    blocks = homes.select("cls", "block")
    placed = (
        pairs.join(blocks.toDF("a", "block_a").hint("merge"), "a")
        .join(blocks.toDF("b", "block_b").hint("merge"), "b")
        .select(F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high"), *_PAIR_COLUMNS)
    )
    placed = kept(placed, "ngram-pairs")
    needed = placed.select("low", "high", F.col("a").alias("cls")).union(placed.select("low", "high", "b")).distinct()
    no_class, no_group = F.lit(None).cast("binary"), F.lit(None).cast("bigint")
    content = needed.join(sets.hint("merge"), "cls").select(
        "low", "high", F.col("cls").alias("a"), no_class.alias("b"), no_group.alias("group_a"),
        no_group.alias("group_b"), F.lit(-1).cast("bigint").alias("rank"), "set",
    )
    rows = content.unionByName(placed.withColumn("set", no_class))
    return (
        rows.repartition("low", "high")
        .sortWithinPartitions("low", "high", "rank", "a", "b")
        .mapInArrow(released(_verifier(num, den, exact)), PAIR)
    )


def _linked(pairs: DataFrame, texts: DataFrame, shorts: DataFrame, homes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` among pairs: enough of those that pass to connect all they connect."""
    likely = kept(_passing(pairs, shorts, homes, num, den, False), "ngram-likely")
    classes = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    ids = classes.join(homes, "cls").select(F.col("node").alias("doc_id"))
    sets = kept(_sets(texts, ids, n, False), "ngram-sets")
    return kept(_passing(likely, sets, homes, num, den, True).select("a", "b"), "ngram-links")


def _crossing(num: int, den: int):
    """Pairs of classes of different groups within each run of rows of a shingle's pair of blocks.

    Rows come sorted by run; only the run at hand is carried over, at most two blocks.
    """
    run_of = ["token", "row", "column"]

    def pairs_of(run: pa.RecordBatch):
        block, group = run.column("block").to_numpy(), run.column("group").to_numpy()
        parity = flat(run.column("parity"))[0].view(np.uint64).reshape(run.num_rows, -1)
        meta, lead = run.column("meta").to_numpy(), run.column("lead").to_numpy(zero_copy_only=False)
        place, size = meta >> 32, meta & 0xFFFFFFFF
        one = np.flatnonzero(block == run.column("row")[0].as_py())
        other = np.flatnonzero(block == run.column("column")[0].as_py())
        i, j = (x.ravel() for x in np.meshgrid(one, other, indexing="ij"))
        # What the shingle's first class meets is tested already.
        good = (group[i] != group[j]) & ~lead[i] & ~lead[j]
        i, j = i[good], j[good]
        most = np.minimum(size[i] - place[i], size[j] - place[j])
        good = (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num) & (
            most * (num + den) >= (size[i] + size[j]) * num
        )
        i, j = i[good], j[good]
        # Of sets that share enough no more shingles than these are in one of them alone.
        alone = size[i] + size[j] - 2 * least_overlap(size[i], size[j], num, den)
        good = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) <= alone
        i, j = i[good], j[good]
        return i, j, place[i] + place[j]

    def cross(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carried is not None:
                batch = pa.concat_batches([carried, batch])
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for name in run_of:
                values = batch.column(name).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.append(np.flatnonzero(change), batch.num_rows).tolist()
            for a, b in zip(starts[:-2], starts[1:-1]):
                yield from told(batch.slice(a, b - a))
            carried = batch.slice(starts[-2])
        if carried is not None:
            yield from told(carried)

    def told(run: pa.RecordBatch):
        if run.num_rows < 2:
            return
        i, j, rank = pairs_of(run)
        if len(i):
            cls, group = run.column("cls"), run.column("group")
            a, b = pa.array(i), pa.array(j)
            yield pa.RecordBatch.from_arrays(
                [cls.take(a), cls.take(b), group.take(a), group.take(b), pa.array(rank)],
                names=["a", "b", "group_a", "group_b", "rank"],
            )

    return cross


def _each_once(pairs: DataFrame) -> DataFrame:
    """Every pair once, with its best rank."""
    swap = F.col("a") > F.col("b")
    ordered = pairs.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(swap, F.col("group_b")).otherwise(F.col("group_a")).alias("group_a"),
        F.when(swap, F.col("group_a")).otherwise(F.col("group_b")).alias("group_b"),
        "rank",
    )
    return ordered.groupBy("a", "b", "group_a", "group_b").agg(F.min("rank").alias("rank"))


def similar_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Rows link when ``den * intersection >= num * union`` of their sets of n-word shingles.
    With fewer than ``n`` words the whole sequence is the only shingle; null texts and
    texts without words have no shingle and link with nothing.  ``component_id`` is the
    smallest id reachable.  Rows that repeat an id give a row each, and share a
    component.  Rows with a null id stay apart from all others, with a null component.
    Other columns are not looked at, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"))
    found = kept(texts.mapInArrow(released(_profiler(n)), PROFILE), "ngram-profile")
    profile = found.where("bucket IS NULL").select("doc_id", "n_shingles", "cls", "key", "parity")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for bucket, df in found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("df")).toLocalIterator():
        counts[bucket] = df

    # A class is known by its smallest id.
    nodes = kept(
        profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("cls")
        .agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.min("key").alias("key"), F.min("parity").alias("parity")),
        "ngram-nodes",
    )
    buckets = spark.sparkContext.broadcast((counts, commons(counts, nodes.count())))
    postings = kept(_postings(texts, nodes, n, num, den, buckets), "ngram-postings")
    told, nodes = nodes.select("cls", "node", "parity"), nodes.select("cls", "node")
    meetings = kept(_meetings(postings), "ngram-meetings")
    # Classes that meet another one, each with its home block.
    met = meetings.where("cls <> first")
    homes = met.select("cls", "token").union(met.select("first", "token")).groupBy("cls").agg(F.min("token").alias("home"))
    homes = kept(homes.join(nodes, "cls"), "ngram-homes")
    per_home = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    number = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    homes = kept(
        homes.join(per_home, "home").select("cls", F.xxhash64("home", number).alias("block"), "node"), "ngram-homes"
    )
    shorts = kept(_sets(texts, homes.select(F.col("node").alias("doc_id")), n, True), "ngram-shorts")

    first_pairs = met.where(_may_link("first_meta", "meta", num, den)).select(
        F.col("first").alias("a"), F.col("cls").alias("b"),
        # Classes start out as groups of their own, told apart within a block by a hash of each.
        F.xxhash64("first").alias("group_a"), F.xxhash64("cls").alias("group_b"),
        F.shiftright("meta", 32).alias("rank"),
    )
    links = _linked(_each_once(first_pairs), texts, shorts, homes, n, num, den)
    groups = kept(_class_groups(links, nodes), "ngram-groups")

    grouped = told.join(groups, "node", "left").select("cls", F.coalesce("component_id", "node").alias("group"), "parity")
    placed = kept(
        meetings.select("token", "meta", "cls", (F.col("cls") == F.col("first")).alias("lead")).join(
            grouped.hint("merge"), "cls"
        ),
        "ngram-placed",
    )
    apart = (
        placed.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("least"), F.max("group").alias("most"))
        .where("least <> most")
        .select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    blocked = (
        placed.join(apart.hint("merge"), "token")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("block", "with").alias("row"), F.greatest("block", "with").alias("column"), "block", "meta", "cls", "group", "lead", "parity")
    )
    crossing = (
        blocked.repartition("token", "row", "column")
        .sortWithinPartitions("token", "row", "column")
        .mapInArrow(released(_crossing(num, den)), PAIR)
    )
    more = _linked(_each_once(crossing), texts, shorts, homes, n, num, den)
    groups = kept(_class_groups(links.union(more), nodes), "ngram-groups")

    of_class = nodes.join(groups, "node", "left").select("cls", F.coalesce("component_id", "node").alias("component_id"))
    own = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").join(of_class.hint("merge"), "cls")
    alone = profile.where("n_shingles = 0 OR doc_id IS NULL")
    return own.select("doc_id", "n_shingles", "component_id").union(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def _class_groups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component_id`` of linked classes."""
    by_id = links.join(nodes.toDF("a", "x"), "a").join(nodes.toDF("b", "y"), "b")
    return components(by_id.select("x", "y"))
