"""WARC archives: writing, normalising whole-file gzip into one member per record, reading.

Files are reached through ``pyarrow.fs`` by URI, so a folder may be in any store that
it knows.  Tasks give each file a new name and report it in a row; only the files
in a written table of rows count, and what a lost attempt left behind is never read.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import join_small, kept, named, shared_folder

LEAST_BYTES = 100
DATE = "2026-01-01T00:00:00Z"
CHUNK = 1 << 18
ROWS = 256


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it; ``file:/x`` counts as ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Per page ``page_id, url, body, payload_bytes, payload_digest, refers_to``.

    Of equal payloads of at least ``least`` bytes the smallest page id is the original
    and the others refer to it.  Counting them combines before the shuffle, and only
    digests that occur twice are joined back, so that one page in every host costs no more.
    """
    rows = pages.select(
        named(id_col).cast("bigint").alias("page_id"),
        F.coalesce(named(url_col), F.lit("")).alias("url"),
        F.encode(F.coalesce(named(body_col), F.lit("")), "UTF-8").alias("body"),
    ).withColumns({"payload_bytes": F.octet_length("body").cast("bigint"), "payload_digest": F.sha2("body", 256)})
    again = kept(
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-again",
    )
    return join_small(rows, again, "payload_digest", "left").withColumn(
        "refers_to", F.when(F.col("original") != F.col("page_id"), F.col("original"))
    ).drop("original")


def record_bytes(page_id, url, body, payload_bytes, digest, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers and no block."""
    revisit = refers_to is not None
    block = b"" if revisit else body
    # A header is one line: line ends in a URL would begin another.
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {payload_bytes}",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines.append("Content-Type: text/html; charset=utf-8")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _whole_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(f"{folder}/{uuid.uuid4().hex}.warc.gz")
        sink, packer, n = None, zlib.compressobj(1, zlib.DEFLATED, 31), 0
        for batch in batches:
            columns = [batch.column(name) for name in ("page_id", "url", "body", "payload_bytes", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                if sink is None:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(path, compression=None)
                sink.write(packer.compress(record_bytes(*(c[i].as_py() for c in columns))))
                n += 1
        if sink is not None:
            sink.write(packer.flush())
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": path.rsplit("/", 1)[1], "records": n}])

    return write


def write_whole(records: DataFrame, folder: str) -> DataFrame:
    """Each partition as one gzip stream; returns the files written, ``file, records``."""
    return kept(records.mapInArrow(_whole_writer(folder), "file string, records bigint"), "warc-files")


class _Unpacked(io.RawIOBase):
    """The inflated bytes of a gzip file of one or many members, read once, front to back."""

    def __init__(self, source):
        self.source, self.raw, self.out = source, b"", b""
        self.inflate = zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, target):
        while not self.out:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                if not self.raw:
                    self.raw = self.source.read(CHUNK)
                if not self.raw:
                    return 0
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise EOFError("a gzip stream ends before its trailer")
            # max_length keeps a well packed stretch from unfolding at once.
            self.out = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unconsumed_tail
        n = min(len(target), len(self.out))
        target[:n], self.out = self.out[:n], self.out[n:]
        return n


def read_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers by lower-case name, block, and the record's own bytes, one after the other."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        raw, headers = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
            raw.append(line)
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise EOFError("a record ends before its stated length")
        yield headers, block, b"".join(raw) + b"\r\n" + block + b"\r\n\r\n"


def _normaliser(source: str, folder: str):
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, path = store_of(f"{source}/{name}")
                out_store, stem = store_of(f"{folder}/{uuid.uuid4().hex}")
                out_store.create_dir(stem.rsplit("/", 1)[0], recursive=True)
                at = n = 0
                with store.open_input_stream(path, compression=None) as packed, out_store.open_output_stream(stem + ".warc.gz", compression=None) as sink, out_store.open_output_stream(stem + ".idx") as index:
                    for headers, _, raw in read_records(io.BufferedReader(_Unpacked(packed), CHUNK)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        sink.write(member)
                        entry = {"offset": at, "length": len(member), "id": headers["warc-record-id"], "type": headers["warc-type"], "uri": headers.get("warc-target-uri", "")}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_pylist([{"file": stem.rsplit("/", 1)[1], "records": n}])

    return normalise


def normalise(files: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite whole-file gzip archives so that every record is a gzip member of its own.

    Each archive is inflated once, as a stream; memory holds one record.  Next to each new
    archive ``<file>.warc.gz`` lies ``<file>.idx``: a JSON line per record with offset,
    length, id, type and URI.  Returns ``file`` (without suffix) and ``records``.
    """
    n = files.count()
    spread = files.repartition(max(n, 1), "file")
    return kept(spread.mapInArrow(_normaliser(source, folder), "file string, records bigint"), "warc-members")


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, body binary"


def _id(text: str | None) -> int | None:
    found = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found not in ("", "null") else None


def _reader(folder: str, bodies: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, stem = store_of(f"{folder}/{name}")
                rows, size = [], 0
                with store.open_input_stream(stem + ".idx") as index, store.open_input_file(stem + ".warc.gz") as archive:
                    for line in io.BufferedReader(index):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        member = zlib.decompress(archive.read(entry["length"]), 31)
                        headers, block, _ = next(read_records(io.BufferedReader(io.BytesIO(member))))
                        revisit = headers["warc-type"] == "revisit"
                        stated = headers["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(block).hexdigest() != stated:
                            raise ValueError(f"{name}: the payload of {entry['id']} does not have its digest")
                        rows.append({
                            "page_id": _id(headers["warc-record-id"]),
                            "url": headers.get("warc-target-uri"),
                            "payload_bytes": int(headers["x-payload-length"]) if revisit else len(block),
                            "payload_digest": stated,
                            "record_type": headers["warc-type"],
                            "refers_to": _id(headers.get("warc-refers-to")),
                            "body": block if bodies and not revisit else None,
                        })
                        size += len(block)
                        if len(rows) >= ROWS or size > SLICE:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


SLICE = 4 << 20


def read_archives(files: DataFrame, folder: str, bodies: bool = True) -> DataFrame:
    """The records of normalised archives, each fetched by the offset in the index."""
    return files.repartition(max(files.count(), 1), "file").mapInArrow(_reader(folder, bodies), RECORD)


def archived(pages: DataFrame, bodies: bool = False, **columns) -> DataFrame:
    """Write ``pages`` as whole-file archives, normalise them, and read the members back.

    Null bodies are empty payloads, null ids come back null, repeated ids are records of
    their own.  An empty table gives no files and no rows.  Other columns are not looked at.
    """
    spark = pages.sparkSession
    whole, members = shared_folder(spark, "warc-whole"), shared_folder(spark, "warc")
    files = write_whole(plan_records(pages, **columns), whole)
    return read_archives(normalise(files, whole, members), members, bodies)
