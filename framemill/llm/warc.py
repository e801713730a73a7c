"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; each archive ends in a seek table (a skippable frame, as in the published seekable format), and an index maps each record to its archive, frame and offset in that frame, so one record costs one frame to read. Of equal payloads the record of the smallest page is a response, the others revisit it.

Equal payloads are found by digest: (digest, smallest page, count) for repeated digests only. Digests with over 1/SHARE of all rows, fewer than SHARE of them whatever the input, are broadcast, and their pages are dealt evenly; the rest are joined, and stream through the tasks that write them. Archives are written under names of their own to a temporary name and renamed, and the index of those that a committed task wrote is a table in the shared folder, so lost or repeated tasks can't leave half an archive in it.

Null html is an empty payload, null urls are empty, white space in urls becomes a blank. Page ids are percent-encoded in the archives, so they may hold any text; empty ones stay empty. A null page_id stays null: such a record is a response if no page with an id has its payload, and it is never referred to. Repeated rows each get a record; all rows with the smallest page_id of a payload are responses.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

FRAME_BYTES = 256 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads of fewer bytes are never revisited.
LEAST = 100
SHARE = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveWriter:
    """Writes records to one archive; add() gives the record's frame and its offset in that frame."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.out = self.fs.open_output_stream(self.path + ".tmp")
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        at = len(self.frames), self.size
        self.buffer.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.buffer:
            frame = self.zstd.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join([struct.pack("<II", *x) for x in self.frames]) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)


class ArchiveReader:
    """Random access to an archive's frames by its seek table."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.file = self.fs.open_input_file(self.path)
        total = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, total - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.table = list(struct.iter_unpack("<II", self.file.read_at(8 * n, total - 9 - 8 * n)))
        self.starts = [0]
        for packed, _ in self.table:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        packed, plain = self.table[i]
        return self.zstd.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=plain)


NO_PAGE = "<urn:no-page>"


def urn(page: object) -> str:
    return NO_PAGE if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def record(page: object, url: str, payload: bytes, digest: str, refers: object, revisit: bool) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers)}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, frame[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def page_of(said: str) -> str | None:
    return None if said == NO_PAGE else unquote(said[len("<urn:page:") : -1])


def write_archives(pages: DataFrame, top: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages below `top`; returns the index: page_id, archive, frame, frame_offset, record_bytes, a table there."""
    df = pages.select(F.col(page_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    df = df.withColumn("digest", F.sha2("payload", 256))
    kind = df.schema["page_id"].dataType.simpleString()
    long = df.where(F.octet_length("payload") >= LEAST)
    repeated = written(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), f"{top}/repeated")
    hot = heavy_digests(repeated, pages.count())
    df = df.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot_first").isNotNull(), F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("digest")))
    df = df.join(repeated.select(F.col("digest").alias("key"), "first"), "key", "left").select("page_id", "url", "payload", "digest", F.coalesce("hot_first", "first").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path = None, ""
        for batch in batches:
            made = []
            for page, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{top}/archives/{uuid.uuid4().hex}.warc.zst"
                    out = ArchiveWriter(path)
                revisit = first is not None and page != first and len(payload) >= LEAST
                r = record(page, url, payload, digest, first, revisit)
                made.append((page, path, *out.add(r), len(r)))
                if out.written >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            cols = list(zip(*made)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["page_id", "archive", "frame", "frame_offset", "record_bytes"])
        if out is not None:
            out.close()

    where, path = fs.FileSystem.from_uri(f"{top}/archives")
    where.create_dir(path, recursive=True)
    return written(df.mapInArrow(run, f"page_id {kind}, archive string, frame long, frame_offset long, record_bytes long"), f"{top}/index")


def heavy_digests(repeated: DataFrame, rows: int, share: int = SHARE) -> DataFrame:
    """Digests with more than 1/share of all rows: fewer than `share`."""
    return repeated.where(F.col("n") > max(1, rows // share)).select("digest", F.col("first").alias("hot_first"))


def read_archives(index: DataFrame, parallel: int) -> DataFrame:
    """Every record of the archives that the index names: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's payload is hashed anew and must give the digest that its record states."""
    kind = index.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = ArchiveReader(path)
                for i in range(len(reader.table)):
                    rows = []
                    for head, payload in records(reader.frame(i)):
                        digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "revisit"
                        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["WARC-Payload-Length"])):
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} doesn't have the payload that it states")
                        rows.append((page_of(head["WARC-Record-ID"]), int(head["WARC-Payload-Length"]), digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None))
                    cols = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = index.select("archive").distinct().repartition(parallel, "archive")
    out = files.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def read_record(archive: str, frame: int, frame_offset: int, record_bytes: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and that frame alone."""
    return next(records(ArchiveReader(archive).frame(frame)[frame_offset : frame_offset + record_bytes]))


def archived(pages: DataFrame, top: str | None = None) -> DataFrame:
    """Write the pages and read them back: one row for each."""
    spark = pages.sparkSession
    index = write_archives(pages, top or shared_dir(spark))
    return read_archives(index, max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))))
