"""Ranked lexical search, reversed: the items are indexed and the documents pass through the index.

Items come in blocks of bounded size.  The inverted index of a block (terms, and which items
have them) is broadcast.  A first pass turns each document into the counts of those of its
terms that the index has, and writes them; numbers of documents, document frequencies and weights
come from that table.  A second pass streams the counts through the index and keeps the best
documents of each item in a heap of ``k`` rows per task.  The heaps are written, and merged.
Documents are never shuffled, and a common term costs no more in one task than in another.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytestream import LOWER, Hashed, flat, mix, slices
from plumbline.llm.chunks import spread
from plumbline.llm.frames import kept, named

# Terms of items that one block, and so one broadcast, holds; one item alone may have more.
BLOCK_POSTINGS = 1 << 20
BLOCK_BYTES = 16 << 20
# Cells of scores, and terms of items added to them, that a task works on at a time.
CELLS = 1 << 21

# Letters and digits of ASCII and every byte of a longer character are inside a term.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_INSIDE[0x80:] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of flat texts; no term crosses from one text to the next."""
    inside, edge = _INSIDE[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.roll(inside, 1), np.roll(inside, -1)
    return np.flatnonzero(inside & (edge[:-1] | ~before)), np.flatnonzero(inside & (edge[1:] | ~after)) + 1


def terms_of(text: str | None) -> set[bytes]:
    """The distinct terms of one text, A-Z lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    raw = _LOWERED[data].tobytes()
    starts, ends = term_bounds(data, np.array([0, len(data)]))
    return {raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())}


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hashed(data, LOWER).of(starts, ends) ^ mix((ends - starts).astype(np.uint64))


@dataclass
class Index:
    """Inverted index of a block of items.  Terms are numbered by their hash."""

    item_ids: list[int | None]
    words: list[bytes]
    hashes: np.ndarray  # of the terms, ascending
    begin: np.ndarray  # of each term among the postings
    items: np.ndarray  # postings: numbers of items, term by term

    @classmethod
    def over(cls, block: list[tuple[int | None, set[bytes]]]) -> Index:
        postings: dict[bytes, list[int]] = {}
        for number, (_, words) in enumerate(block):
            for word in words:
                postings.setdefault(word, []).append(number)
        words = list(postings)
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        hashes = _hashes(data, ends - [len(w) for w in words], ends)
        order = np.argsort(hashes, kind="stable")
        words = [words[i] for i in order.tolist()]
        sizes = [len(postings[w]) for w in words]
        items = np.array([i for w in words for i in postings[w]], np.int64)
        return cls([i for i, _ in block], words, hashes[order], np.concatenate([[0], np.cumsum(sizes)]), items)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Finds the terms of texts in an index: by hash, and then by their bytes."""

    def __init__(self, index: Index):
        self.hashes = index.hashes
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.size = np.array([len(w) for w in index.words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(index.words), np.uint8)
        # Terms of one hash would be looked for from the first of them on.
        self.twins = bool(len(self.hashes) and (self.hashes[1:] == self.hashes[:-1]).any())

    def counts(self, data: np.ndarray, offsets: np.ndarray):
        """Terms of each text with repeats; and document, term and count of each term the index has."""
        starts, ends = term_bounds(data, offsets)
        n = np.diff(np.searchsorted(starts, offsets))
        hashed = _hashes(data, starts, ends)
        at = np.flatnonzero(self.maybe[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
        starts, ends, hashed = starts[at], ends[at], hashed[at]
        term = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        found = self._same(data, starts, ends, term)
        while self.twins and len(again := np.flatnonzero(~found & (np.append(self.hashes, np.uint64(0))[term + 1] == hashed) & (term + 1 < len(self.hashes)))):
            term[again] += 1
            found[again] = self._same(data, starts[again], ends[again], term[again])
        doc = np.searchsorted(offsets, starts[found], "right") - 1
        keys, counts = np.unique(doc * len(self.hashes) + term[found], return_counts=True)
        return n, keys // len(self.hashes), keys % len(self.hashes), counts

    def _same(self, data, starts, ends, term) -> np.ndarray:
        """Whether the stretches of bytes are these terms."""
        sizes = ends - starts
        same = sizes == self.size[term]
        at = np.flatnonzero(same)
        mine = _LOWERED[data[spread(starts[at], sizes[at])]]
        theirs = self.bytes[spread(self.begin[term[at]], sizes[at])]
        wrong = np.repeat(at, sizes[at])[mine != theirs]
        same[wrong] = False
        return same


def blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes over ``item_id, text``, each of bounded size; the driver holds one block at a time."""
    block, postings, size = [], 0, 0
    for item, text in items.toLocalIterator(prefetchPartitions=False):
        words = terms_of(text)
        if not words:
            continue
        more = sum(map(len, words))
        if block and (postings + len(words) > BLOCK_POSTINGS or size + more > BLOCK_BYTES):
            yield Index.over(block)
            block, postings, size = [], 0, 0
        block.append((item, words))
        postings, size = postings + len(words), size + more
    if block:
        yield Index.over(block)


COUNTS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def _counter(index):
    """Each text with a term, as its size and the counts of what the index has."""

    def count(batches):
        matcher = index.value.matcher()
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = flat(batch.column("text"))
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                n, doc, term, counts = matcher.counts(data[part[0] : part[-1]], part - part[0])
                bounds = pa.array(np.searchsorted(doc, np.arange(last - first + 1)).astype(np.int32))
                told = pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )
                yield told.filter(pa.array(n > 0))

    return count


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The best ``k`` documents of each item: by score, then by the smallest id, a null id last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # what a document has to reach

    def offer(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """``scores`` has a row for each document and a column for each item."""
        doc, item = np.nonzero(scores >= self.least)
        score = scores[doc, item]
        order = np.lexsort((ids[doc], ~known[doc], -score, item))
        doc, item, score = doc[order], item[order], score[order]
        # No more than ``k`` of these rows can enter a heap.
        place = np.arange(len(item)) - np.searchsorted(item, item)
        first = place < self.k
        for i, s, d, has in zip(item[first].tolist(), score[first].tolist(), ids[doc[first]].tolist(), known[doc[first]].tolist()):
            heap, row = self.rows[i], (s, has, -d)
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def batch(self, item_ids: list[int | None]) -> pa.RecordBatch:
        rows = [(i, item_ids[i], -d if has else None, s) for i, heap in enumerate(self.rows) for s, has, d in heap]
        columns = list(zip(*rows)) or [[], [], [], []]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item", "item_id", "doc_id", "score"])


HEAPS = "item int, item_id bigint, doc_id bigint, score bigint"


def _searcher(index, weights, n_docs: int, n_terms: int, k: int):
    """Streams counts through the index into one heap per item."""

    def search(batches):
        own, w = index.value, weights.value
        posted = np.diff(own.begin)
        heaps = Heaps(len(own.item_ids), k)
        for batch in batches:
            lists = batch.column("terms")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            base, bounds = bounds[0], bounds - bounds[0]
            term = lists.values.to_numpy()[base : base + bounds[-1]].astype(np.int64)
            counts = batch.column("counts")
            at = counts.offsets[0].as_py()
            tf = counts.values.to_numpy()[at : at + bounds[-1]].astype(np.int64)
            m = 10 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            score = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            known = np.array(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            work = np.concatenate([[0], np.cumsum(posted[term])])[bounds]
            rows = max(1, CELLS // len(own.item_ids))
            first = 0
            while first < batch.num_rows:
                last = min(first + rows, int(np.searchsorted(work, work[first] + CELLS, "right")) - 1)
                last = min(max(last, first + 1), batch.num_rows)
                here = slice(bounds[first], bounds[last])
                sizes = posted[term[here]]
                item = own.items[spread(own.begin[term[here]], sizes)]
                scores = np.zeros((last - first, len(own.item_ids)), np.int64)
                np.add.at(scores, (np.repeat(doc[here] - first, sizes), item), np.repeat(score[here], sizes))
                heaps.offer(scores, ids[first:last], known[first:last])
                first = last
        yield heaps.batch(own.item_ids)

    return search


def _best_of_block(docs: DataFrame, index: Index, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    counted = kept(docs.mapInArrow(_counter(shared), COUNTS), "search-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(index.words), np.int64)
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for term, df in frequencies.toLocalIterator():
        weights[term] = weight(n_docs, df)
    search = _searcher(shared, spark.sparkContext.broadcast(weights), n_docs, n_terms, k)
    heaps = kept(counted.where(F.size("terms") > 0).mapInArrow(search, HEAPS), "search-heaps")
    # A scan packs the heaps of many tasks together and cuts them to k rows an item before it shuffles.
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z
    lower-cased.  With N documents that have a term, L terms in all with repeats, n terms in a
    document, df documents with a term and tf of it in the document, a term weighs
    ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, ``m = 10 + 90 * n * N div L``, and the score
    sums ``w * (10^9 * tf div (1000 * tf + 8 * m))`` over the item's distinct terms, in 64-bit integers.
    Only scores above 0 are ranked.  Equal scores go by ascending id, a null id last.

    Null and empty texts have no term: such documents count nowhere, such items give no rows,
    and neither do empty tables.  Each row of ``items`` is searched by itself, repeated
    and null ids included; rows of ``docs`` that repeat an id are each ranked.  Ids are bigints;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"))
    asked = items.select(named(item_col).cast("bigint").alias("item_id"), named(item_text_col).alias("text"))
    found = [best for index in blocks(asked) if (best := _best_of_block(texts, index, k)) is not None]
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)
