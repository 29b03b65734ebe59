"""Token ids in files, packed by a Re-Pair grammar per shard.

File format, little endian: the magic ``RPR1``; five 64-bit counts (documents, rules, symbols,
tokens, first nonterminal); the rules as pairs of 32-bit symbols; per rule the 32-bit number of
tokens it expands to; per document its id, whether the id is null, and its first token and symbol
as 64-bit numbers; then the symbols, 16 bits each if none needs more, else 32.
A rule refers only to symbols numbered below its own.  No rule crosses the end of a document.
"""

from __future__ import annotations

import os
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytestream import flat, slices
from plumbline.llm.chunks import ChunkCache, spread
from plumbline.llm.frames import kept, named, shared_folder
from plumbline.llm.warc import store_of

MAGIC = b"RPR1"
END = 0
SHARD_TOKENS = 2_000_000  # a shard is closed at the document that reaches this many
ROUNDS = 5
MARK_BITS = 18
# Between a letter and one of these every word ends, and none of them is part of a contraction.
MARKS = ".,;:!?"
LEAST = 12  # a pair rarer than this is not worth a rule
_COUNTS = struct.Struct("<4s5Q")


# --- grammar --------------------------------------------------------------------------


def _mark(pairs: np.ndarray) -> np.ndarray:
    """The leading bits of a hash of pairs, of 32 or 64 bits each."""
    bits = pairs.dtype.itemsize * 8
    return (pairs * pairs.dtype.type(0x9E3779B97F4A7C15 >> (64 - bits) | 1)) >> pairs.dtype.type(bits - MARK_BITS)


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int = ROUNDS, least: int = LEAST):
    """Replace frequent pairs by nonterminals, the most frequent ones of each round together.

    ``ends`` marks last ids of documents; no pair begins there.  Returns symbols, their ends, and
    rules.  All symbols stay below 2^16 where terminals do, which bounds the rules per shard.
    """
    symbols, ends = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    top = terminals
    room = max((1 << 16) - terminals, 1 << 12)
    for turn in range(rounds):
        if len(symbols) < 2:
            break
        narrow = top <= 1 << 16
        if narrow:
            pairs = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        else:
            pairs = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        free = ~ends[:-1]
        ordered = np.sort(pairs[free])
        if not len(ordered):
            break
        edge = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        count = np.diff(edge)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        most = max((room - (top - terminals)) // (rounds - turn), 0)
        if not most:
            break
        if len(often) > most:
            often = often[np.argsort(-count[often], kind="stable")[:most]]
        chosen = np.sort(ordered[edge[often]])
        shift = chosen.dtype.type(16 if narrow else 32)
        low = chosen.dtype.type((1 << int(shift)) - 1)
        left, right = (chosen >> shift).astype(np.uint32), (chosen & low).astype(np.uint32)
        begins, follows = np.zeros(top, bool), np.zeros(top, bool)
        begins[left], follows[right] = True, True
        at = np.flatnonzero(begins[symbols[:-1]] & follows[symbols[1:]] & free)
        # A table of hashed pairs spares most of the others the search.
        likely = np.zeros(1 << MARK_BITS, bool)
        likely[_mark(chosen)] = True
        at = at[likely[_mark(pairs[at])]]
        sought = pairs[at]
        place = np.minimum(np.searchsorted(chosen, sought), len(chosen) - 1)
        hit = chosen[place] == sought
        at, place = at[hit], place[hit]
        # Of hits that overlap in a row, every other one is replaced.
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run_start = np.flatnonzero(fresh)
        index = np.arange(len(at)) - run_start[np.cumsum(fresh) - 1]
        at, place = at[index % 2 == 0], place[index % 2 == 0]
        symbols[at] = top + place
        ends[at] = ends[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, ends = symbols[stay], ends[stay]
        rules.append(np.stack([left, right], axis=1))
        top += len(chosen)
    rules_found = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return symbols, ends, rules_found


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Tokens each symbol stands for: 1 for a terminal."""
    sizes = np.ones(terminals + len(rules), np.int64)
    done = terminals
    while done < len(sizes):
        # All rules whose parts are known already are worked out at once.
        deep = np.flatnonzero(rules[done - terminals :].max(axis=1) >= done)
        until = done + (int(deep[0]) if len(deep) else len(sizes) - done)
        part = rules[done - terminals : until - terminals]
        sizes[done:until] = sizes[part[:, 0]] + sizes[part[:, 1]]
        done = until
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    while (deep := symbols >= terminals).any():
        size = 1 + deep
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[at] = symbols
        pair = rules[symbols[deep] - terminals]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def expand_by_table(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The same for many symbols, when what every rule stands for fits into memory.

    ``lengths`` are the tokens of each rule.
    """
    sizes = np.concatenate([np.ones(terminals, np.int64), lengths])
    begin = np.cumsum(sizes) - sizes
    known, done = np.arange(terminals, dtype=np.uint32), terminals
    while done < len(sizes):
        # All rules whose parts are known already are worked out at once.
        deep = np.flatnonzero(rules[done - terminals :].max(axis=1) >= done)
        until = done + (int(deep[0]) if len(deep) else len(sizes) - done)
        parts = rules[done - terminals : until - terminals].ravel()
        known = np.concatenate([known, known[spread(begin[parts], sizes[parts])]])
        done = until
    return known[spread(begin[symbols], sizes[symbols])]


# --- files ----------------------------------------------------------------------------


def shard_bytes(docs: list[int | None], ids: list[np.ndarray], terminals: int) -> bytes:
    sizes = np.array([len(x) for x in ids], np.int64)
    flat_ids = np.concatenate(ids)
    ends = np.zeros(len(flat_ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, last, rules = compress(flat_ids, ends, terminals)
    lengths = expansion_lengths(rules, terminals)[terminals:]
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    index = np.zeros(len(docs), np.dtype([("doc", "<i8"), ("null", "<i8"), ("token", "<u8"), ("symbol", "<u8")]))
    index["doc"] = [0 if d is None else d for d in docs]
    index["null"] = [d is None for d in docs]
    index["token"], index["symbol"] = np.cumsum(sizes) - sizes, starts
    wide = terminals + len(rules) > 1 << 16
    return b"".join([
        _COUNTS.pack(MAGIC, len(docs), len(rules), len(symbols), len(flat_ids), terminals),
        rules.astype("<u4").tobytes(),
        lengths.astype("<u4").tobytes(),
        index.tobytes(),
        symbols.astype("<u4" if wide else "<u2").tobytes(),
    ])


class Shard:
    """One file, read for whole documents or for any stretch of its tokens."""

    def __init__(self, raw: bytes):
        magic, n_docs, n_rules, n_symbols, self.n_tokens, self.terminals = _COUNTS.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        at = _COUNTS.size
        self.rules = np.frombuffer(raw, "<u4", n_rules * 2, at).reshape(-1, 2)
        at += n_rules * 8
        self.lengths = np.frombuffer(raw, "<u4", n_rules, at)
        at += n_rules * 4
        self.index = np.frombuffer(raw, np.dtype([("doc", "<i8"), ("null", "<i8"), ("token", "<u8"), ("symbol", "<u8")]), n_docs, at)
        at += n_docs * 32
        wide = self.terminals + n_rules > 1 << 16
        self.symbols = np.frombuffer(raw, "<u4" if wide else "<u2", n_symbols, at)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Tokens ``start .. start + n``, unpacking no more symbols than hold them."""
        doc = int(np.searchsorted(self.index["token"], start, "right")) - 1
        first = int(self.index["symbol"][doc])
        skip = start - int(self.index["token"][doc])
        end_doc = int(np.searchsorted(self.index["token"], start + n, "left"))
        last = int(self.index["symbol"][end_doc]) if end_doc < len(self.index) else len(self.symbols)
        some = self.symbols[first:last]
        sizes = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])[some]
        upto = np.cumsum(sizes)
        a = int(np.searchsorted(upto, skip, "right"))
        b = int(np.searchsorted(upto, skip + n, "left")) + 1
        inside = skip - int(upto[a - 1] if a else 0)
        return expand(some[a:b], self.rules, self.terminals)[inside : inside + n]

    def documents(self):
        """``(doc_id, first token, ids)`` of each document in order."""
        if int(self.lengths.sum()) <= self.n_tokens:
            ids = expand_by_table(self.symbols, self.rules, self.lengths, self.terminals)
        else:
            ids = expand(self.symbols, self.rules, self.terminals)
        starts = np.append(self.index["token"], self.n_tokens).astype(np.int64)
        for row, a, b in zip(self.index, starts[:-1], starts[1:]):
            yield (None if row["null"] else int(row["doc"])), int(a), ids[a:b]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> tuple[ChunkCache, int]:
    """A cache of encoded chunks, kept from task to task, and the size of the vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    size = own.get_vocab_size(with_added_tokens=True)
    lone = set(own.get_added_tokens_decoder())
    # Bytes each id stands for: a byte-level piece has a character for every byte.
    widths = np.zeros(size, np.int64)
    for piece, i in own.get_vocab(with_added_tokens=True).items():
        widths[i] = len(piece.encode()) if i in lone else len(piece)

    # Special tokens are found before words are, so no chunk may begin inside one; and a vocabulary
    # whose words are others, or that treats the begin of a text in its own way, has no marks.
    alone = lambda text: own.encode(text, add_special_tokens=False).ids
    inside = "".join(token.content for token in own.get_added_tokens_decoder().values())
    marks = "".join(m for m in MARKS if m not in inside and alone("a" + m) == alone("a") + alone(m)).encode()
    before_mark = b" a"

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A chunk that begins with a blank is a word of its own in any text: all of them are
        # encoded as one text, and cut apart by how many bytes each id covers.  A chunk that begins
        # with a mark is so after a letter, which is put before it and left out of its ids.
        joins = np.array([(c[:1] == b" " and len(c) > 1) or c[0] in marks if c else False for c in chunks], bool)
        sizes, begin = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        runs, n = [np.zeros(0, np.int32)], 0
        for i, e in zip(np.flatnonzero(~joins).tolist(), own.encode_batch_fast([chunks[i].decode("utf-8", "replace") for i in np.flatnonzero(~joins).tolist()], add_special_tokens=False)):
            runs.append(np.array(e.ids, np.int32))
            begin[i], sizes[i] = n, len(runs[-1])
            n += len(runs[-1])
        together = np.flatnonzero(joins)
        for part in np.array_split(together, max(len(together) // 20_000, 1)):
            some = [chunks[i] if chunks[i][0] == 0x20 else before_mark + chunks[i] for i in part.tolist()]
            if not some:
                continue
            text = b"".join(some).decode("utf-8", "replace")
            ids = np.array(own.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            upto = np.concatenate([[0], np.cumsum(widths[ids])])
            ends = np.cumsum([len(c) for c in some])
            starts = ends - [len(chunks[i]) for i in part.tolist()]
            cut = np.searchsorted(upto, starts)
            begin[part], sizes[part] = n + cut, np.searchsorted(upto, ends) - cut
            runs.append(ids)
            n += len(ids)
        # Runs of ids stand in the order they were made in; chunks are given in theirs.
        return np.concatenate(runs)[spread(begin, sizes)], sizes

    return ChunkCache(encode, marks), size


FILES = "part int, number int, file string, n_docs bigint, n_tokens bigint"


def _writer(path: str, folder: str, end: int, shard_tokens: int):
    def write(batches):
        cache, terminals = tokenizer(path)
        part, number = TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def close():
            store, name = store_of(f"{folder}/{uuid.uuid4().hex}.rpr")
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(name, compression=None) as sink:
                sink.write(shard_bytes(docs, ids, terminals))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "number": [number], "file": [name.rsplit("/", 1)[1]], "n_docs": [len(docs)], "n_tokens": [size]},
                schema=_FILES,
            )

        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            for first, last in slices(offsets):
                bounds = offsets[first : last + 1]
                values, begin = cache.lookup(data[bounds[0] : bounds[-1]], bounds - bounds[0])
                for i in range(last - first):
                    own = np.append(values[begin[i] : begin[i + 1]], np.int32(end))
                    docs.append(keys[first + i])
                    ids.append(own)
                    size += len(own)
                    if size >= shard_tokens:
                        yield close()
                        docs, ids, size, number = [], [], 0, number + 1
        if docs:
            yield close()

    return write


_FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_ids(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
    end: int = END, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode whole texts and write them as shards in ascending id order; returns the files.

    Null texts are empty; ``end`` closes each document.  Null ids come first, rows that
    repeat an id stand together in the order of their texts.
    """
    ordered = (
        docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return kept(ordered.mapInArrow(_writer(path, folder, end, shard_tokens), FILES), "ids-files")


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                store, place = store_of(f"{folder}/{name}")
                with store.open_input_stream(place, compression=None) as source:
                    shard = Shard(source.read())
                rows, size = [], 0
                for doc, at, ids in shard.documents():
                    rows.append((doc, before + at, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ``ids`` are little-endian uint32.

    ``start`` counts the ids of all documents before it.  The running sum is over one row per
    file.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread_out = placed.select("file", "before").repartition(max(files.count(), 1), "file")
    return spread_out.mapInArrow(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def packed_ids(docs: DataFrame, path: str, **columns) -> DataFrame:
    """Write ``docs`` as shards of packed ids and read every document back from them."""
    folder = shared_folder(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, path, **columns), folder)
