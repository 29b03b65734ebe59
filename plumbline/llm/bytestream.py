"""Text columns as flat byte arrays, and hashes of words and windows over them.

Everything here works inside a task on one slice of a batch, in numpy, and in memory
proportional to the slice.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(salt: int, lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        upper = (code >= 65) & (code <= 90)
        code = np.where(upper, code + np.uint64(32), code)
    return mix(code + np.uint64(1 + salt * 0x1000))


PLAIN, PLAIN_2, LOWER = _byte_values(1, False), _byte_values(2, False), _byte_values(1, True)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("_powers", BASE), ("_inverses", BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; one longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Hashed:
    """Polynomial prefix hash of a byte array: the hash of any stretch takes three steps."""

    def __init__(self, data: np.ndarray, values: np.ndarray = PLAIN):
        self._sum(values[data])

    @classmethod
    def over(cls, values: np.ndarray) -> Hashed:
        """The same over 64-bit values of any kind instead of bytes."""
        own = cls.__new__(cls)
        own._sum(values)
        return own

    def _sum(self, values: np.ndarray) -> None:
        powers, self.inverses = _power_tables(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverses[starts])

    def windows(self, width: int) -> np.ndarray:
        """Hash of every stretch of ``width`` bytes, by its start."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverses[:n])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word ends with its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted set of hashes of its shingles of ``n`` words, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    words = Hashed(data, LOWER).of(starts, ends) ^ mix((ends - starts).astype(np.uint64))
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(n):
        total += padded[k : k + len(words)] * factors[k]
    total = mix(total)
    bounds = np.searchsorted(starts, offsets)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            found.append(np.unique(total[a : b - n + 1]))
        elif b > a:
            short = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            found.append(mix(np.array([short])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed bigint."""
    return x.view(np.int64)


def released(run: Callable) -> Callable:
    """``run``, a function over batches, such that a worker that waits for its next task holds no freed memory."""

    def wrapped(batches):
        yield from run(batches)
        _trim()

    return wrapped


def release_unused() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system, where it can be."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
