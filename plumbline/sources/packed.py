"""Lines of zstd-packed files, read as streams and split at frames.

No file is ever whole in memory.  A task walks the block headers of a large file to find its frames
and groups them into stretches; other tasks then unpack stretches as streams.  As in plain text, a line
belongs to the stretch it begins in: each but the first leaves out what comes before its first line
break, and reads on past its end up to the next one.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.files import PARTITION_BYTES

# Schemes of paths that tasks can open, and the form of frames.
OPENABLE = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
_FRAME = 0xFD2FB528
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_RLE = 1

READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
STRETCHES = "path string, length bigint, begin bigint, stop bigint, cut boolean"


def openable(path: str) -> bool:
    return path.split(":", 1)[0] in OPENABLE


def opened(path: str) -> pa.NativeFile:
    """The file at ``path`` for reading from any place; ``file:/x`` counts as ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def frame_end(source, begin: int, size: int) -> int | None:
    """Where the frame that starts at ``begin`` ends, by its block headers; None if the file is cut off in it."""

    def read(place: int, n: int) -> bytes:
        source.seek(place)
        return source.read(n)

    head = read(begin, 18)
    magic = int.from_bytes(head[:4], "little")
    if magic in _SKIPPABLE:
        end = begin + 8 + int.from_bytes(head[4:8], "little")
        return end if len(head) >= 8 and end <= size else None
    if magic != _FRAME and len(head) >= 4:
        raise ValueError(f"no zstd frame at byte {begin}")
    try:
        place = begin + zstandard.frame_header_size(head)
        checksum = 4 if zstandard.get_frame_parameters(head).has_checksum else 0
    except zstandard.ZstdError:
        return None
    while True:
        header = int.from_bytes(block := read(place, 3), "little")
        if len(block) < 3:
            return None
        # Last block of the frame, kind, and size: of a run of one byte only that byte is there.
        place += 3 + (1 if header >> 1 & 3 == _RLE else header >> 3)
        if header & 1:
            return place + checksum if place + checksum <= size else None


def stretches(path: str, size: int, bytes_per_task: int) -> Iterator[tuple[str, int, int, int, bool]]:
    """Runs of frames of about ``bytes_per_task`` packed bytes; the last says whether the file is cut off."""
    with io.BufferedReader(opened(path), READ_BYTES) as source:
        begin = at = 0
        while at < size:
            end = frame_end(source, at, size)
            at = size if end is None else end
            if at == size or at - begin >= bytes_per_task:
                yield path, size, begin, at, end is None
                begin = at


class _Packed:
    """The bytes of a file from ``begin`` to ``stop``."""

    def __init__(self, source: pa.NativeFile, begin: int, stop: int):
        self.source, self.left = source, stop - begin
        source.seek(begin)

    def read(self, n: int = -1) -> bytes:
        found = self.source.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(found)
        return found


def _text(source: pa.NativeFile, begin: int, stop: int) -> io.BufferedReader:
    packed = zstandard.ZstdDecompressor().stream_reader(
        _Packed(source, begin, stop), read_size=READ_BYTES, read_across_frames=True
    )
    return io.BufferedReader(packed, READ_BYTES)


def owned_lines(path: str, begin: int, stop: int, size: int) -> Iterator[bytes]:
    """The lines that begin in the frames from ``begin`` to ``stop``; one that runs on is read to its end."""
    with opened(path) as source:
        text = _text(source, begin, stop)
        if begin and not text.readline().endswith(b"\n"):
            return  # all of it is the middle of a line of an earlier stretch
        line = b""
        while line := text.readline():
            if not line.endswith(b"\n"):
                break
            yield line
        if stop < size:
            line += _text(source, stop, size).readline()
        if line:
            yield line


def packed_lines(files: DataFrame, bytes_per_task: int = PARTITION_BYTES, tolerate_cut_off: bool = False) -> DataFrame:
    """``path, value``: the lines of the zstd files listed as ``path, length``.

    Memory is bounded by the longest line, not by the size of a file.  Empty files have no lines;
    a file without a zstd frame at its start is an error, and so is one that is cut off, unless it is to be
    read up to the cut.
    """

    def walk(batches):
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                found = list(zip(*stretches(path, size, bytes_per_task)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["path", "length", "begin", "stop", "cut"])

    def unpack(batches):
        for batch in batches:
            for path, begin, stop, cut, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "stop", "cut", "length"))):
                if cut and not tolerate_cut_off:
                    raise ValueError(f"{path} is cut off")
                values, held = [], 0
                try:
                    for line in owned_lines(path, begin, stop, size):
                        values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                        held += len(line)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pydict({"path": [path] * len(values), "value": values})
                            values, held = [], 0
                except zstandard.ZstdError as broken:
                    if not tolerate_cut_off:
                        raise ValueError(f"{path} cannot be unpacked") from broken
                if values:
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(values), "value": values})

    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(math.ceil(total / bytes_per_task), files.sparkSession.sparkContext.defaultParallelism)
    # A listing is one small partition or few: it is dealt out before files are opened, and again before they are read.
    found = files.select("path", "length").repartition(tasks).mapInArrow(walk, STRETCHES)
    return found.repartition(tasks, "path", "begin").mapInArrow(unpack, "path string, value string")
