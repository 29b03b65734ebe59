"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

Every chunk of a text is a lattice: an edge for each piece that matches, and one of byte pieces
for each character that is no piece.  Forward filtering sums the probability of all paths to
each node; backward sampling draws a path from the end.  Draws are hashes of seed, row key,
place and step, so reruns and lost executors repeat them.  Distinct chunks are filtered once
and cached; all chunks of a slice are sampled together, one array step per piece.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytestream import Hashed, flat, mix, release_unused, released, slices
from plumbline.llm.chunks import chunk_starts, distinct_chunks, spread
from plumbline.llm.frames import fresh, number_of, numbered

BLANK = "▁"
ALPHA = 1.0
SEED = 20264
CACHE_NODES = 400_000
LATTICE_SLICE = 1 << 17
ADDED_CHARS = 1 << 16
MARK_BITS = 18


@dataclass
class Vocabulary:
    """Pieces as bytes, their log-probabilities, and lookups by hash for each length."""

    raw: list[bytes]
    weight: np.ndarray
    byte_piece: np.ndarray  # id of the piece of each byte
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    marks: dict[int, np.ndarray]  # per length, which leading bits the hashes of its pieces have

    @property
    def widest(self) -> int:
        return max(self.by_length, default=0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(codes: np.ndarray):
    """Prefix hash over code points."""
    return Hashed.over(mix(codes.astype(np.uint64) + np.uint64(7)))


def load(path: str) -> Vocabulary:
    """The pieces of a model file with a log-probability each.

    A unigram model's scores are log-probabilities.  A BPE model's are ranks, and are read as
    Zipf's law: the piece of rank r has a probability in proportion to 1 / (r + 10).  Pieces that
    are bytes carry the least weight, so that they serve only where nothing else fits.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    score = np.array([model.get_score(i) for i in range(n)])
    is_byte = np.array([model.is_byte(i) for i in range(n)])
    usable = np.array([not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    if usable.any() and (score[usable] == np.round(score[usable])).all():
        weight = -np.log(10.0 - score)
    else:
        weight = score.astype(np.float64)
    least = weight[usable].min() if usable.any() else 0.0
    weight = np.where(is_byte, least - 5.0, weight)
    byte_piece = np.full(256, -1, np.int64)
    raw: list[bytes] = []
    lengths: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if is_byte[i]:
            byte_piece[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif usable[i]:
            raw.append(piece.replace(BLANK, " ").encode())
            lengths.setdefault(len(piece), []).append(i)
        else:
            raw.append(b"")
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary has no piece for some bytes")
    by_length, marks = {}, {}
    for length, ids in lengths.items():
        hashed = _prefix(_codes("".join(pieces[i].replace(BLANK, " ") for i in ids))).of(
            np.arange(len(ids)) * length, (np.arange(len(ids)) + 1) * length
        )
        order = np.argsort(hashed)
        by_length[length] = (hashed[order], np.array(ids)[order])
        marks[length] = np.zeros(1 << MARK_BITS, bool)
        marks[length][hashed >> np.uint64(64 - MARK_BITS)] = True
    size = np.array([len(r) for r in raw], np.int64)
    return Vocabulary(raw, weight, byte_piece, by_length, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, marks)


class Lattices:
    """Filtered lattices of distinct chunks, in flat arrays that are emptied when they are full.

    Nodes are numbered one after the other; node k's incoming edges have their running
    probabilities between k and k + 1 in ``upto``, so that one search finds a drawn edge.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.vocabulary, self.alpha = vocabulary, alpha
        # Arrays grow by doubling in buffers that stay; what is in use are their first parts.
        self.room = {"upto": np.zeros(0), "edge_from": np.zeros(0, np.int32), "edge_piece": np.zeros(0, np.int32), "is_first": np.zeros(0, bool)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.n_nodes = 0
        self.upto, self.edge_from, self.edge_piece, self.is_first = (room[:0] for room in self.room.values())
        self.chars: list[bytes] = []  # characters without a piece; edge_piece is -1 - place

    def _append(self, name: str, values: np.ndarray) -> None:
        used, room = len(getattr(self, name)), self.room[name]
        if len(room) < used + len(values):
            room = np.empty(max(2 * len(room), used + len(values)), room.dtype)
            room[:used] = getattr(self, name)
            self.room[name] = room
        room[used : used + len(values)] = values
        setattr(self, name, room[: used + len(values)])

    def add(self, chunks: list[bytes]) -> np.ndarray:
        """End nodes of the lattices of new chunks, one each.  Chunks are not empty.

        About ``ADDED_CHARS`` bytes are filtered at once: that takes many times the memory of the bytes.  Chunks
        of like lengths go together, as each place in a chunk is a step over all of them.
        """
        size = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(size, kind="stable")
        ends = np.zeros(len(chunks), np.int64)
        for first, last in slices(np.append(0, np.cumsum(size[order])), ADDED_CHARS):
            some = order[first:last]
            ends[some] = self._add([chunks[i] for i in some.tolist()])
        return ends

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        voc = self.vocabulary
        # Texts of a Spark string are UTF-8; should bytes be broken, they are pieces one by one.
        texts = [c.decode("utf-8", "surrogateescape") for c in chunks]
        size = np.array([len(t) for t in texts], np.int64)
        codes = _codes("".join(texts))
        owner_end = np.repeat(np.cumsum(size), size)
        base = np.cumsum(size) - size
        hashed = _prefix(codes)
        at = np.arange(len(codes))
        starts, widths, pieces = [], [], []
        single = np.zeros(len(codes), bool)
        # A literal U+2581 is text, not a blank: it has no piece but its bytes.
        for length, (keys, ids) in voc.by_length.items():
            start = at[at + length <= owner_end]
            h = hashed.of(start, start + length)
            # Most stretches are no piece: a table of leading bits spares them the search.
            likely = np.flatnonzero(voc.marks[length][h >> np.uint64(64 - MARK_BITS)])
            start, h = start[likely], h[likely]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            start, found = start[hit], ids[place[hit]]
            if length == 1:
                single[start] = True
            starts.append(start)
            widths.append(np.full(len(start), length))
            pieces.append(found)
        alone = np.flatnonzero(~single)
        starts.append(alone)
        widths.append(np.ones(len(alone), np.int64))
        spelled = np.arange(len(self.chars), len(self.chars) + len(alone))
        pieces.append(-1 - spelled)
        flat_text = "".join(texts)
        self.chars.extend(flat_text[i].encode("utf-8", "surrogateescape") for i in alone.tolist())
        start, width, piece = np.concatenate(starts), np.concatenate(widths), np.concatenate(pieces)
        by_char = piece < 0
        weight = voc.weight[np.where(by_char, 0, piece)]
        if by_char.any():
            least = voc.weight[voc.byte_piece].min()
            weight[by_char] = [least * len(self.chars[-1 - p]) for p in piece[by_char].tolist()]
        weight = weight * self.alpha

        # Node of a start: chunk's base + place + its number (each chunk has a node more than characters).
        chunk = np.repeat(np.arange(len(size)), size)
        begin = start + chunk[start]
        end = begin + width
        # By end, then begin; no two pieces have both in common.
        order = np.argsort(end * (voc.widest + 2) - width)
        begin, end, piece, weight = begin[order], end[order], piece[order], weight[order]
        node_base = base + np.arange(len(size))
        local_end = end - node_base[chunk[start[order]]]
        total = np.full(len(codes) + len(size), -np.inf)
        total[node_base] = 0.0
        # Numbers of 16 bits are sorted by their digits.
        small = local_end.max() < 1 << 16
        by_step = np.argsort(local_end.astype(np.uint16) if small else local_end, kind="stable")
        steps = np.concatenate([[0], np.flatnonzero(np.diff(local_end[by_step])) + 1, [len(by_step)]])
        reach = np.empty(len(begin))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            some = by_step[a:b]
            reach[some] = total[begin[some]] + weight[some]
            own = end[some]
            head = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            total[own[head]] = np.logaddexp.reduceat(reach[some], head)
        p = np.exp(reach - total[end])
        head = np.concatenate([[True], end[1:] != end[:-1]])
        run = np.cumsum(p)
        before = (run - p)[head][np.cumsum(head) - 1]
        shift = self.n_nodes
        # The last edge of a node takes what rounding leaves.
        within = np.minimum(run - before, 1.0)
        within[np.append(head[1:], True)] = 1.0
        self._append("upto", end + shift + within)
        self._append("edge_from", begin + shift)
        self._append("edge_piece", piece)
        is_first = np.zeros(len(total), bool)
        is_first[node_base] = True
        self._append("is_first", is_first)
        self.n_nodes += len(codes) + len(size)
        return node_base + size + shift

    def ends(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End and first node of each chunk of ``data``."""
        codes, distinct, first = distinct_chunks(data, starts, stops)
        if self.n_nodes > CACHE_NODES:
            self.clear()
        known = self.known
        node = np.array([known.get(k, -1) for k in distinct.tolist()], np.int64)
        new = np.flatnonzero(node < 0)
        if len(new):
            raw, at = data.tobytes(), first[new]
            node[new] = self.add([raw[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
            known.update(zip(distinct[new].tolist(), node[new].tolist()))
        return node[codes]

    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int):
        """Sampled ids of flat texts in order, and where each text begins among them.

        ``keys`` are the 64-bit row keys of the texts.
        """
        starts = chunk_starts(data, offsets)
        stops = np.append(starts[1:], len(data))
        whole = stops > starts
        starts, stops = starts[whole], stops[whole]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        text = np.searchsorted(offsets, starts, "right") - 1
        node = self.ends(data, starts, stops)
        place = mix(mix(keys[text] + np.uint64(seed)) + (starts - offsets[text]).astype(np.uint64))
        live = np.arange(len(node))
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(node), np.int64)
        step = 0
        while len(live):
            u = (mix(place[live] + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> np.uint64(11)) / 2.0**53
            # A draw lies strictly between the node's number and the next.
            edge = np.searchsorted(self.upto, node[live] + u, "right")
            drawn.append((live, edge))
            count[live] += 1
            node[live] = self.edge_from[edge]
            live = live[~self.is_first[node[live]]]
            step += 1
        begin = np.cumsum(count) - count
        edges = np.zeros(int(count.sum()), np.int64)
        for s, (at, edge) in enumerate(drawn):
            edges[begin[at] + count[at] - 1 - s] = edge
        ids, sizes = self.spell(self.edge_piece[edges])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([begin, [len(edges)]])
        return ids, upto[first[np.searchsorted(starts, offsets)]]

    def spell(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, characters without one as their bytes, and how many ids each takes."""
        sizes = np.ones(len(piece), np.int64)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece.astype(np.int32), sizes
        spelled = [self.chars[-1 - p] for p in piece[odd].tolist()]
        sizes[odd] = [len(s) for s in spelled]
        ids = np.repeat(piece, sizes)
        ids[spread((np.cumsum(sizes) - sizes)[odd], sizes[odd])] = self.vocabulary.byte_piece[
            np.frombuffer(b"".join(spelled), np.uint8)
        ]
        return ids.astype(np.int32), sizes


@lru_cache(maxsize=1)
def lattices_of(path: str, alpha: float) -> Lattices:
    """Lattices that a worker keeps from task to task."""
    return Lattices(load(path), alpha)


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text that ids stand for, as bytes."""
    return vocabulary.flat[spread(vocabulary.begin[ids], vocabulary.size[ids])].tobytes()


def _encoder(path: str, alpha: float, seed: int, text_col: str, key_col: str, names: list[str], dropped: list[str]):
    ids_name, n_name, ok_name = names

    def encode(batches):
        release_unused()
        lattices = lattices_of(path, alpha)
        vocabulary = lattices.vocabulary
        for batch in batches:
            data, offsets = flat(batch.column(text_col))
            keys = batch.column(key_col).to_numpy().view(np.uint64)
            for first, last in slices(offsets, LATTICE_SLICE):
                bounds = offsets[first : last + 1]
                own = data[bounds[0] : bounds[-1]]
                bounds = bounds - bounds[0]
                ids, begin = lattices.sample(own, bounds, keys[first:last], seed)
                back = decode(ids, vocabulary)
                size = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[begin]
                whole = own.tobytes()
                same = [
                    back[a:b] == whole[c:d]
                    for a, b, c, d in zip(size[:-1].tolist(), size[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                runs = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                rows = batch.slice(first, last - first)
                left = [n for n in rows.schema.names if n not in dropped]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(n) for n in left), runs, pa.array(np.diff(begin)), pa.array(same)],
                    names=[*left, ids_name, n_name, ok_name],
                )

    return encode


def encoded(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    alpha: float = ALPHA, seed: int = SEED, keep_text: bool = True,
) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, whose names come second: piece ids, their number,
    and whether decoding them gave the text's bytes.

    Null texts have no pieces, as empty ones, and decode to the empty text.  Draws depend on seed,
    id and place in the text: rows that repeat an id and a text repeat its segmentation, and a null
    id draws like any other.  A larger ``alpha`` prefers likely pieces.  ``keep_text=False`` leaves the text
    column out of the result.  Other columns stay as they are, whatever their names.
    """
    names = [fresh(docs, n) for n in ("piece_ids", "n_pieces", "lossless")]
    plain, text = numbered(docs), number_of(docs, text_col)
    dropped = ["row_key"] if keep_text else ["row_key", text]
    left = [(f, name) for f, name in zip(plain.schema.fields, docs.columns) if f.name not in dropped]
    schema = T.StructType([f for f, _ in left]).add("ids", T.ArrayType(T.IntegerType())).add("n", "long").add("same", "boolean")
    keyed = plain.withColumn("row_key", F.xxhash64(F.lit(seed), F.col(number_of(docs, id_col))))
    encoder = _encoder(path, alpha, seed, text, "row_key", ["ids", "n", "same"], dropped)
    told = keyed.mapInArrow(released(encoder), schema)
    return told.toDF(*(name for _, name in left), *names), names


def decoded(ids: DataFrame, path: str, ids_col: str, out_col: str = "text") -> DataFrame:
    """``ids`` with the texts its piece ids stand for; null ids give null."""
    out, column = fresh(ids, out_col), number_of(ids, ids_col)

    def run(batches):
        vocabulary = load(path)
        for batch in batches:
            texts = [
                None if not x.is_valid else decode(x.values.to_numpy().astype(np.int64), vocabulary).decode("utf-8", "replace")
                for x in batch.column(column)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    plain = numbered(ids)
    schema = T.StructType(list(plain.schema.fields)).add("text", "string")
    return plain.mapInArrow(run, schema).toDF(*ids.columns, out)
