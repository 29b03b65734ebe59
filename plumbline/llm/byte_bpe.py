"""Byte-level BPE: ranked merges folded by higher-order functions, and lossless decoding.

Texts are cut into words by the vocabulary's pattern, in blocks of some megabytes: a block is one
row with its documents, each as numbers of words, and its distinct words as arrays of the pieces of
their bytes.  Spark folds the ranked merges over each distinct word: a step looks for the pair of
least rank, joins it, and asks a literal map for the ranks of the two pairs that come to be.
Documents then gather the ids of their words.  Nothing is shuffled, and a frequent word is merged
once a block.  Decoding concatenates the bytes of the pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from array import array
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytestream import flat, slices
from plumbline.llm.chunks import spread
from plumbline.llm.frames import fresh, named, number_of, numbered

BLOCK_BYTES = 16 << 20
# Steps of a fold copy the word, so longer words are merged with a heap instead.
LONG_WORD = 128

# A link of a word under merge is one number: the rank of a piece and the next one together, the
# place where the piece begins, and its id.  The least link is the pair to merge next.
ID_BITS, PLACE_BITS = 17, 16
ID = (1 << ID_BITS) - 1
PLACE = ((1 << PLACE_BITS) - 1) << ID_BITS
RANK_SHIFT = ID_BITS + PLACE_BITS
NO_RANK = ID << RANK_SHIFT


@dataclass
class Ranks:
    """A vocabulary: pieces by rank, and the rank that each pair of pieces merges into."""

    pieces: list[bytes]
    rank: dict[bytes, int]
    byte: list[int]
    pairs: dict[tuple[int, int], int]
    byte_pairs: np.ndarray  # rank of each pair of bytes, as it stands in a link
    words: str  # pattern of words
    exact_words: str  # the same where letters and digits of late Unicode versions occur

    def heap_merged(self, raw: bytes) -> list[int]:
        """The ids of one word in time that does not grow with the square of its length."""
        ids = [self.byte[b] for b in raw]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs = self.pairs
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two is merged already
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := pairs.get((merged, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, merged, ids[after[i]]))
            if before[i] >= 0 and (r := pairs.get((ids[before[i]], merged))) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], merged))
        return [x for x in ids if x >= 0]

    @property
    def id_bits(self) -> int:
        """Bits of all ids and of one more, which no piece has."""
        return len(self.pieces).bit_length()

    def first_links(self, words: list[str]) -> pa.Array:
        """Words as arrays of links: of their bytes, or of their ids if there is nothing left to merge.

        A word that is a piece is that piece, and a long one is merged here.
        """
        raw = [w.encode() for w in words]
        ready = {
            i: self.heap_merged(w) if whole is None else [whole]
            for i, w in enumerate(raw)
            if (whole := self.rank.get(w)) is not None or len(w) > LONG_WORD
        }
        sizes = np.array([len(ready[i]) if i in ready else len(w) for i, w in enumerate(raw)], np.int64)
        begin = np.cumsum(sizes) - sizes
        links = np.full(int(sizes.sum()), NO_RANK, np.int64)
        of_bytes = np.array([i not in ready for i in range(len(raw))], bool)
        done, open_ = np.flatnonzero(~of_bytes), np.flatnonzero(of_bytes)
        links[spread(begin[done], sizes[done])] |= np.array([x for i in done.tolist() for x in ready[i]], np.int64)
        data = np.frombuffer(b"".join(raw[i] for i in open_.tolist()), np.uint8)
        ends = np.cumsum(sizes[open_])
        place = np.arange(len(data)) - np.repeat(ends - sizes[open_], sizes[open_])
        rank = np.full(len(data), NO_RANK, np.int64)
        rank[:-1] = self.byte_pairs[data[:-1], data[1:]]
        rank[ends - 1] = NO_RANK
        links[spread(begin[open_], sizes[open_])] = rank | place << ID_BITS | np.array(self.byte, np.int64)[data]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(links))


def load(path: str, pattern: str) -> Ranks:
    """The vocabulary of a rank file: a line has a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        rank = {base64.b64decode(piece): int(number) for piece, number in (line.split() for line in lines if line.strip())}
    pieces = [b""] * (max(rank.values()) + 1)
    pairs = {}
    for raw, number in rank.items():
        pieces[number] = raw
        for cut in range(1, len(raw)):
            a, b = rank.get(raw[:cut]), rank.get(raw[cut:])
            if a is not None and b is not None:
                pairs[a, b] = number
    byte = [rank[bytes([b])] for b in range(256)]
    links = [[pairs.get((a, b), ID) << RANK_SHIFT for b in byte] for a in byte]
    return Ranks(pieces, rank, byte, pairs, np.array(links, np.int64), pattern, as_in_tiktoken(pattern))


def as_in_tiktoken(pattern: str) -> str:
    """``pattern`` with letters and digits as the installed tiktoken knows them.

    Libraries differ in their version of Unicode.  Where an older and a newer table agree on a
    code point, so does tiktoken; about the others it is asked.
    """
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(points)
    for name, lead in (("L", "a"), ("N", "1")):
        newer = set(regex.findall(rf"\p{{{name}}}", text))
        unsure = [c for c in points if (unicodedata.category(c)[0] == name) != (c in newer)]
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {(lead + c).encode(): 256 + i for i, c in enumerate(unsure)}
        # A word that is a piece is one id; only of a word's own kind does a second character belong to it.
        asked = tiktoken.Encoding("asked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        known = {c for c in unsure if len(asked.encode_ordinary(lead + c)) == 1}
        less, more = _set_of(newer.intersection(unsure) - known), _set_of(known - newer)
        own = rf"[\p{{{name}}}--{less}]" if less else rf"\p{{{name}}}"
        pattern = pattern.replace(rf"\p{{{name}}}", f"[{own}||{more}]" if more else own)
    return pattern


def _set_of(characters) -> str:
    codes = np.array(sorted(map(ord, characters)), np.int64)
    if not len(codes):
        return ""
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "[" + "".join(rf"\U{run[0]:08x}-\U{run[-1]:08x}" for run in runs) + "]"


# Bytes from here on lead characters whose class differs between versions of Unicode.
_LATE = 0xD5


def _block_maker(ranks, text: str, names: list[str], block_bytes: int):
    """Blocks of documents: their rows, the numbers of their words, and the distinct words."""

    def make(batches):
        own = ranks.value
        plain, exact = regex.compile(own.words), regex.compile(own.exact_words, regex.V1)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            rows = pa.StructArray.from_arrays([batch.column(n) for n in names], names=names)
            for first, last in slices(offsets, block_bytes):
                words = exact if (data[offsets[first] : offsets[last]] >= _LATE).any() else plain
                numbers: dict[str, int] = defaultdict(count().__next__)
                codes, ends = array("i"), [0]
                for i in range(first, last):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    codes.extend(map(numbers.__getitem__, words.findall(raw)))
                    ends.append(len(codes))
                of_docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(codes, np.int32)))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one(rows.slice(first, last - first)), one(of_docs), one(own.first_links(list(numbers)))], names=["rows", "codes", "words"])

    return make


def _literal(value, dtype: str) -> Column:
    """A constant that the optimizer works out once."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), dtype)


def rank_map(ranks: Ranks) -> Column:
    """The literal map of pairs of ids to the rank they merge into, as it stands in a link.

    Spark searches a map from end to end, so it is cut into many: of pairs whose ids combine (by
    exclusive or) to the same number, told apart by their first id.
    """
    maps: list[dict[int, int]] = [{} for _ in range(1 << ranks.id_bits)]
    for (a, b), merged in ranks.pairs.items():
        maps[a ^ b][a] = merged << RANK_SHIFT
    return _literal(maps, "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def folded(links: Column, pairs: Column, edge: int) -> Column:
    """The ids of a word, an array of links, by merging the pair of least rank, the first of several,
    until no pair has a rank.  ``edge`` is an id that no piece has."""

    def link(own: Column, following: Column) -> Column:
        a = own.bitwiseAND(ID)
        return F.coalesce(pairs[a.bitwiseXOR(following)][a], F.lit(NO_RANK)).bitwiseOR(own)

    def merge(links: Column, _: Column) -> Column:
        def at_place(at: Column) -> Column:
            def into(merged: Column) -> Column:
                before, first = links[at - 2].bitwiseAND(PLACE | ID), links[at - 1].bitwiseAND(PLACE).bitwiseOR(merged)
                new = F.zip_with(F.array(before, first), F.array(merged, F.get(links, at + 1).bitwiseAND(ID)), link)
                # Flattening is cheaper than ``concat``, which goes through lazy lists.
                return F.flatten(F.array(F.slice(links, 1, at - 2), new, F.slice(links, at + 2, F.size(links))))

            return _let(F.shiftright(links[at - 1], RANK_SHIFT), into)

        least = F.array_min(links)
        return F.when(least >= NO_RANK, links).otherwise(_let(F.array_position(links, least).cast("int"), at_place))

    def ids(links: Column) -> Column:
        return F.transform(links, lambda x: x.bitwiseAND(ID).cast("int"))

    edged = F.flatten(F.array(F.array(F.lit(NO_RANK | edge)), links))
    done = F.aggregate(links, edged, merge, lambda last: ids(F.slice(last, 2, F.size(last))))
    return F.when(F.array_min(links) >= NO_RANK, ids(links)).otherwise(done)


def encoded(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep_text: bool = True, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` with the ids of each whole text as one more column, whose name comes second.

    Ids are those tiktoken's ``encode_ordinary`` gives with this rank file and pattern: each
    match of the pattern is merged by itself, and strings of special tokens are ordinary text.
    Null and empty texts have no ids (an empty array); bytes that are no UTF-8 count as U+FFFD.  Repeated
    rows and ids do not matter, an empty table gives no rows, and other columns stay as they are, whatever
    their names.  ``keep_text=False`` leaves the text column out of the result.

    Words of more than ``LONG_WORD`` bytes are merged by a heap where they are found, with the same
    result: the fold takes time in the square of a word's length.
    """
    name = fresh(docs, "token_ids")
    ranks = load(path, pattern)
    plain, text = numbered(docs), number_of(docs, text_col)
    left = [(f, old) for f, old in zip(plain.schema.fields, docs.columns) if keep_text or f.name != text]
    row = T.StructType([f for f, _ in left])
    schema = T.StructType().add("rows", T.ArrayType(row))
    schema = schema.add("codes", T.ArrayType(T.ArrayType(T.IntegerType()))).add("words", T.ArrayType(T.ArrayType(T.LongType())))
    if not left:
        raise ValueError("a column besides the text has to stay")
    maker = _block_maker(docs.sparkSession.sparkContext.broadcast(ranks), text, [f.name for f, _ in left], block_bytes)
    pairs, edge = rank_map(ranks), (1 << ranks.id_bits) - 1
    # The map goes with the plan once.  An exploded array stays a step of its own: merged into the next
    # one, each word of a text would be folded anew.
    merged = F.transform(F.array(pairs), lambda p: F.transform("words", lambda w: folded(w, p, edge)))
    blocks = plain.mapInArrow(maker, schema).select("rows", "codes", F.explode(merged).alias("ids"))

    def gathered(numbers: Column) -> Column:
        return F.flatten(F.transform(numbers, lambda i: F.col("ids")[i]))

    told = blocks.select(F.explode(F.zip_with("rows", "codes", lambda r, c: F.struct(r.alias("row"), gathered(c).alias("ids")))).alias("doc"))
    return told.select(*(F.col(f"doc.row.{f.name}").alias(old) for f, old in left), F.col("doc.ids").alias(name)), name


def decoded(ids: DataFrame, path: str, ids_col: str, out_col: str = "decoded") -> tuple[DataFrame, str]:
    """``ids`` with the bytes its token ids stand for as one more column, whose name comes second.

    Null ids give null, an empty array no bytes, and null elements are left out.  An id that the
    rank file does not have is an error.
    """
    out = fresh(ids, out_col)
    with open(path, "rb") as lines:
        raw = dict((int(number), piece.decode()) for piece, number in (line.split() for line in lines if line.strip()))
    # Strings of the bytes as they are, valid text or not: joining these takes linear time.
    pieces = _literal([raw.get(i) for i in range(max(raw) + 1)], "array<binary>").cast("array<string>")
    joined = F.array_join(F.transform(named(ids_col), lambda i: pieces[i]), "")
    return ids.withColumn(out, joined.cast("binary")), out
