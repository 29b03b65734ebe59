"""Texts cut into chunks at blanks, and a cache of what each distinct chunk becomes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from plumbline.llm.bytestream import Hashed, mix

CACHE_ENTRIES = 1_200_000
RECENT = 60_000

# A blank begins a chunk if a visible ASCII character or a two-byte letter follows: no
# white space outside ASCII starts with these bytes.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE0] = True


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray, marks: bytes = b"") -> np.ndarray:
    """Where chunks begin in flat texts: at each text, at each blank before a word, and at
    each of ``marks`` after an ASCII letter."""
    first = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        first[: len(data) - 1] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        if marks:
            is_mark = np.zeros(256, bool)
            is_mark[list(marks)] = True
            first[1 : len(data)] |= _LETTER[data[:-1]] & is_mark[data[1:]]
    # What follows a text's last byte is another text's.
    first[offsets[1:][offsets[1:] > 0] - 1] = False
    first[offsets[:-1]] = True
    return np.flatnonzero(first[: len(data)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + sizes[i]`` for each i, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class ChunkCache:
    """Runs of values per distinct chunk, worked out once by ``make``.

    ``make`` takes a list of new chunks and gives all their values in a row and how many each
    chunk has.  The cache is emptied when it has ``CACHE_ENTRIES``, so its size does not follow
    the input.  ``marks`` begin chunks as well (see ``chunk_starts``).
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], marks: bytes = b""):
        self.make, self.marks = make, marks
        self.clear()

    def clear(self) -> None:
        # Sorted hashes and their places for most entries, and a dictionary of the latest.
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.entries = self.used = 0
        self.values = np.zeros(1 << 20, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)

    def _add(self, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first = self.entries
        self.entries += len(keys)
        places = np.arange(first, first + len(keys))
        while len(self.begin) < first + len(keys):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while len(self.values) < self.used + len(values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.used : self.used + len(values)] = values
        self.begin[places] = self.used + np.cumsum(sizes) - sizes
        self.size[places] = sizes
        self.used += len(values)
        self.recent.update(zip(keys.tolist(), places.tolist()))
        if len(self.recent) > RECENT:
            self.hashes = np.concatenate([self.hashes, np.fromiter(self.recent.keys(), np.uint64)])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes = self.hashes[order]
            self.places = np.concatenate([self.places, np.fromiter(self.recent.values(), np.int32)])[order]
            self.recent = {}
        return places

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for new ones."""
        places = np.full(len(keys), -1, np.int64)
        # Keys are sought in their order: neighbours lie close together then.
        order = np.argsort(keys)
        sought = keys[order]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, sought), len(self.hashes) - 1)
            places[order] = np.where(self.hashes[at] == sought, self.places[at], -1)
        recent, rest = self.recent, np.flatnonzero(places < 0)
        places[rest] = [recent.get(k, -1) for k in keys[rest].tolist()]
        return places

    def lookup(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all chunks in order, and where each text begins among them."""
        starts = chunk_starts(data, offsets, self.marks)
        ends = np.append(starts[1:], len(data))
        codes, distinct, first = distinct_chunks(data, starts, ends)
        if self.entries + len(distinct) > CACHE_ENTRIES:
            self.clear()
        places = self._known(distinct)
        new = np.flatnonzero(places < 0)
        if len(new):
            raw, at = data.tobytes(), first[new]
            texts = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            places[new] = self._add(distinct[new], *self.make(texts))
        own = places[codes]
        sizes = self.size[own]
        values = self.values[spread(self.begin[own], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return values, before[np.searchsorted(starts, offsets)]


def distinct_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Number of the distinct chunk each chunk is, the hashes of these, and where each comes first."""
    hashed = Hashed(data).of(starts, ends) ^ mix((ends - starts).astype(np.uint64))
    codes, distinct = pd.factorize(hashed)
    # Numbers are given in the order of first places.
    seen = np.maximum.accumulate(codes) if len(codes) else codes
    first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])) if len(codes) else codes
    return codes, distinct, first
