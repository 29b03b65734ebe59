"""Removal of repeated byte strings by a distributed suffix array.

Sorting a suffix for every byte would shuffle the corpus many times over.  Only suffixes that
can belong to a repeat are sorted.  In each window of ``length`` bytes the k-gram with the least
hash is its anchor; equal windows have equal anchors at equal places.  A run of windows with
one anchor is a context.  Contexts whose anchor occurs nowhere else hold no repeat, and contexts
that occur twice as a whole are repeats as a whole: both follow from counts that combine before
the shuffle.  What remains, contexts that share an anchor and differ, is looked at again with longer
k-grams, and what remains then goes into the suffix array: sampled splitters range-partition the
suffixes by their leading bytes, with ties broken by place so that a string of any frequency
spreads over buckets; each bucket sorts locally by a multikey quicksort and compares neighbours;
first and last suffixes compare across buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytestream import PLAIN_2, Hashed, flat, mix, signed, slices
from plumbline.llm.chunks import spread
from plumbline.llm.frames import bucketed, kept, named

LENGTH = 200
GRAMS = (64, 172)
PIECE = 1 << 19
_PLACE = np.uint64((1 << 22) - 1)

ANCHOR = "gram bigint, context bigint, doc bigint, sig bigint, lo int, hi int, open boolean"


def anchors(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int):
    """Contexts among the window starts ``lo .. hi`` of each of several ranges.

    Ranges do not overlap.  Returns the range each context lies in, its anchor's hash, its own
    hash, and its first and last start.
    """
    hashed = Hashed(data)
    grams = hashed.windows(gram)
    # Hash and place in one number: the least is the leftmost of the least hashes.
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    start = spread(lo, hi - lo + 1)
    range_of = np.repeat(np.arange(len(lo)), hi - lo + 1)
    at = (least[start] & _PLACE).astype(np.int64)
    change = np.flatnonzero((at[1:] != at[:-1]) | (range_of[1:] != range_of[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [len(at) - 1]])
    begin, end, anchor = start[first], start[last], at[first]
    shape = ((anchor - begin) * (2 * length) + (end - begin)).astype(np.uint64)
    context = mix(hashed.of(begin, end + length) + mix(shape))
    return range_of[first], grams[anchor], context, begin, end


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Parts of a batch to work on at once: ``first row, last row, data, offsets, shift``.

    Small texts go together; a long one is cut where windows of the next part begin.
    """
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        if last - first > 1 or part[-1] - part[0] <= PIECE:
            yield first, last, data[part[0] : part[-1]], part - part[0], 0
            continue
        size = int(part[1] - part[0])
        for shift in range(0, size, PIECE):
            own = data[part[0] + shift : part[0] + min(size, shift + PIECE + length - 1)]
            yield first, last, own, np.array([0, len(own)]), shift


def _anchorer(length: int, gram: int):
    """Contexts of the ranges ``wanted`` of each text, or of whole texts without that column."""

    def find(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            docs, sigs = batch.column("doc"), batch.column("sig")
            lists = batch.column("wanted") if "wanted" in batch.schema.names else None
            for first, last, own, bounds, shift in pieces(data, offsets, length):
                most = PIECE - 1 if last - first == 1 else len(own)
                if lists is None:
                    row = np.arange(last - first)
                    lo, hi = np.zeros(len(row), np.int64), np.diff(bounds) - length
                    is_open = np.ones(len(row), bool)
                else:
                    some = lists.slice(first, last - first)
                    inner = some.flatten()
                    row = np.repeat(np.arange(last - first), np.asarray(pc.list_value_length(some)))
                    lo = inner.field("lo").to_numpy().astype(np.int64) - shift
                    hi = inner.field("hi").to_numpy().astype(np.int64) - shift
                    is_open = inner.field("open").to_numpy(zero_copy_only=False)
                # A part of a long text has the starts below PIECE; the bytes after are the next one's.
                lo, hi = np.maximum(lo, 0), np.minimum(hi, np.minimum(np.diff(bounds)[row] - length, most))
                good = lo <= hi
                if not good.any():
                    continue
                row, lo, hi, is_open = row[good], lo[good], hi[good], is_open[good]
                base = bounds[row]
                which, gram_hash, context, begin, end = anchors(own, lo + base, hi + base, length, gram)
                at = pa.array(row[which] + first)
                shifted = shift - base[which]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(gram_hash)), pa.array(signed(context)), docs.take(at), sigs.take(at),
                        pa.array((begin + shifted).astype(np.int32)), pa.array((end + shifted).astype(np.int32)),
                        pa.array(is_open[which]),
                    ],
                    names=["gram", "context", "doc", "sig", "lo", "hi", "open"],
                )

    return find


SUFFIX = "lead bigint, next bigint, rest bigint, doc bigint, sig bigint, at int, open boolean"


def _suffixer(length: int):
    """The suffixes at the window starts asked for: sixteen leading bytes, and a hash of all
    ``length`` bytes that stands for the rest."""

    def lead(data, at):
        word = np.zeros(len(at), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | data[at + k]
        return word

    def make(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                wanted = batch.column("wanted")[i].values
                lo = wanted.field("lo").to_numpy().astype(np.int64)
                size = wanted.field("hi").to_numpy() - lo + 1
                begin = np.cumsum(size) - size
                at = np.arange(size.sum()) - np.repeat(begin - lo, size)
                is_open = np.repeat(wanted.field("open").to_numpy(zero_copy_only=False), size)
                hashed = Hashed(text, PLAIN_2)
                for a in range(0, len(at), 1 << 18):
                    own = at[a : a + (1 << 18)]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(lead(text, own))), pa.array(signed(lead(text, own + 8))),
                            pa.array(signed(hashed.of(own, own + length))),
                            pa.array(np.full(n, batch.column("doc")[i].as_py())), pa.array(np.full(n, batch.column("sig")[i].as_py())),
                            pa.array(own.astype(np.int32)), pa.array(is_open[a : a + n]),
                        ],
                        names=["lead", "next", "rest", "doc", "sig", "at", "open"],
                    )

    return make


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Sorting order by several keys in turn: each key looks only at ties of those before."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), bool)
    tied[1:] = keys[0][order][1:] == keys[0][order][:-1]
    for key in keys[1:]:
        group = np.cumsum(~tied)
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        by = np.lexsort((key[order[at]], group[at]))
        order[at] = order[at][by]
        now = key[order]
        tied[1:] &= now[1:] == now[:-1]
    return order


BUCKET = "lead bigint, next bigint, rest bigint, doc bigint, sig bigint, at int, open boolean, edge boolean"


def _bucket(batches):
    """One bucket of the suffix array: repeats among neighbours, then its first and last suffix."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    keys = [rows.column(k).to_numpy() for k in ("lead", "next", "rest")]
    order = multikey_order(keys)
    equal = np.ones(len(order) - 1, bool)
    for key in keys:
        equal &= key[order][1:] == key[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= equal
    again[:-1] |= equal
    is_open = rows.column("open").to_numpy(zero_copy_only=False)
    hit = order[again]
    hit = hit[is_open[hit]]
    for which, edge in ((hit, False), (order[[0, -1]], True)):
        some = rows.take(pa.array(which))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(which), edge))], names=[*rows.schema.names, "edge"])


def _remover(length: int):
    def remove(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            out = {"doc_id": batch.column("doc_id").to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                spans = batch.column("spans")[i]
                gone, n_spans, left = 0, 0, text
                if spans.is_valid and len(spans.values):
                    lo = spans.values.field("lo").to_numpy()
                    hi = spans.values.field("hi").to_numpy().astype(np.int64) + length
                    step = np.bincount(lo, minlength=len(text) + 1) - np.bincount(hi, minlength=len(text) + 1)
                    covered = np.cumsum(step)[:-1] > 0
                    gone = int(covered.sum())
                    n_spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    left = text[~covered]
                out["n_bytes"].append(len(text))
                out["n_removed"].append(gone)
                out["n_spans"].append(n_spans)
                out["kept_sha256"].append(hashlib.sha256(left.tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=_RESULT)

    return remove


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def repeated_starts(texts: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """``doc, sig, lo, hi``: runs of window starts in ``texts`` (``doc, sig, text``) that repeat.

    ``texts`` are joined by ``doc`` and ``sig`` with runs to look at, so they should be bucketed by these.
    """
    wanted, runs = None, []
    for gram in grams:
        looked_at = texts if wanted is None else texts.join(wanted.hint("merge"), ["doc", "sig"])
        found = looked_at.mapInArrow(_anchorer(length, gram), ANCHOR)
        # Contexts that are not open stand for repeats found before; they are there to be met.
        several = kept(
            found.groupBy("gram")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("context").alias("least"),
                F.max("context").alias("most"),
                F.max("open").alias("any_open"),
            )
            .where("n > 1 AND any_open")
            .select("gram", (F.col("least") != F.col("most")).alias("mixed")),
            "suffix-several",
        )
        shared = kept(found.join(several, "gram"), "suffix-shared")
        contexts = kept(
            shared.where("mixed")
            .groupBy("gram", "context")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sig", "lo", "hi", "open")).alias("one")),
            "suffix-contexts",
        )
        again = shared.where("mixed AND open").join(
            contexts.where("n > 1").select("gram", "context").hint("merge"), ["gram", "context"]
        )
        runs += [shared.where("NOT mixed AND open"), again]
        # One occurrence of each context is looked at further; those that stand alone stay open.
        wanted = kept(
            contexts.groupBy("one.doc", "one.sig").agg(
                F.collect_list(
                    F.struct("one.lo", "one.hi", (F.col("one.open") & (F.col("n") == 1)).alias("open"))
                ).alias("wanted")
            ),
            "suffix-wanted",
        )
    suffixes = texts.join(wanted.hint("merge"), ["doc", "sig"]).mapInArrow(_suffixer(length), SUFFIX)
    sorted_out = kept(
        suffixes.repartitionByRange("lead", "next", "rest", "doc", "at").mapInArrow(_bucket, BUCKET),
        "suffix-buckets",
    )
    edges = sorted_out.where("edge").drop("edge").distinct()
    equal = ["lead", "next", "rest"]
    across = edges.join(
        edges.groupBy(*equal).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), equal
    ).where("open")
    one = [s.select("doc", "sig", F.col("at").alias("lo"), F.col("at").alias("hi")) for s in (sorted_out.where("NOT edge"), across)]
    found = one[0].union(one[1])
    for run in runs:
        found = found.union(run.select("doc", "sig", "lo", "hi"))
    return found


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grams: tuple[int, ...] = GRAMS
) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is each byte covered by a ``length``-byte string that starts at two places or
    more of the input, in one text or in two; matches end with their text, overlaps
    count.  Null is the empty text.  Rows that repeat an id, null ids among them, are
    texts of their own, so equal rows repeat each other.  Other columns are not looked
    at; an empty table gives no rows.
    """
    if not grams or max(grams) > length or length < 16:
        raise ValueError("strings have 16 bytes or more, and k-grams are no longer than they are")
    texts = docs.select(
        named(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(named(text_col), F.lit("")).alias("text"),
    ).select(
        "doc_id",
        "text",
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"),
        F.xxhash64("text").alias("sig"),
    )
    # Whole texts are shuffled this once, whatever their size; runs come to them from here on.
    texts = bucketed(texts, ["doc", "sig"], "suffix-texts")
    starts = kept(
        repeated_starts(texts.select("doc", "sig", "text"), length, grams)
        .groupBy("doc", "sig")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")),
        "suffix-spans",
    )
    return texts.join(starts.hint("merge"), ["doc", "sig"], "left").select("doc_id", "text", "spans").mapInArrow(_remover(length), RESULT)
