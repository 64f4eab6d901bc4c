"""WARC archives as seekable Zstandard bundles.

A bundle is a run of WARC records in independent Zstandard frames, followed by a skippable frame with the
seek table (compressed and decompressed size of every frame). The index maps a record's id to its bundle,
its frame and its offset inside the frame's content, so that one record is read by decompressing one
frame. Bundles are rows with binary content in tables of the shared folder, written and read by Spark,
so that any file system will do; ``export`` writes them as files where a shared path is mounted.

Of records with equal payloads of at least ``min_bytes``, the one with the smallest page_id is a response
and the others revisit it. The smallest id of each digest is found with map-side minimums.

Defined results: null html is an empty payload; rows of the smallest page_id itself (repeated rows) are
all responses; a null page_id comes after every other; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 22
#: Digests of repeated payloads up to this count (some 80 bytes each) are sent to every executor.
BROADCAST_DIGESTS = 100_000
_BUNDLES = "bundle_id string, content binary, index array<struct<record_id:string, frame:int, offset:long, length:long>>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, kind: str) -> tuple[str, bytes]:
    """Record id and bytes of one WARC record."""
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join(url.splitlines())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return record_id, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record that does not end where its length says")
    return fields, rest[:n]


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed bytes, decompressed size) with the seek table behind them."""
    entries = b"".join(struct.pack("<II", len(data), size) for data, size in frames)
    table = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries, at = content[len(content) - 9 - 8 * n : -9], 0
    out = []
    for i in range(n):
        size, whole = struct.unpack_from("<II", entries, 8 * i)
        out.append((at, size, whole))
        at += size
    return out


def read_frame(content: bytes, entry: tuple[int, int, int]) -> bytes:
    at, size, whole = entry
    return zstandard.ZstdDecompressor().decompress(content[at : at + size], max_output_size=max(whole, 1))


def read_record(content: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    return parse_record(read_frame(content, seek_table(content)[frame])[offset : offset + length])


class _Bundle:
    def __init__(self) -> None:
        self.pack = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.open, self.size, self.index, self.names = [], 0, [], hashlib.sha256()

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.size, "length": len(data)})
        self.names.update(record_id.encode())
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            self.frames.append((self.pack.compress(b"".join(self.open)), self.size))
            self.open, self.size = [], 0

    def full(self) -> bool:
        return sum(len(x) for x, _ in self.frames) >= BUNDLE_BYTES

    def batch(self) -> pa.RecordBatch:
        self.flush()
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        out = pa.RecordBatch.from_arrays([pa.array([self.names.hexdigest()]), pa.array([seal(self.frames)], pa.binary()), pa.array([self.index], kind)], ["bundle_id", "content", "index"])
        self.clear()
        return out


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = _Bundle()
    for batch in batches:
        for page_id, url, html, digest, size, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bundle.add(*record(page_id, url or "", (html or "").encode(), digest, size, refers_to, kind))
            if bundle.full():
                yield bundle.batch()
    if bundle.index:
        yield bundle.batch()


def bundles(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """bundle_id, content and index of the archives of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    same = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("digest", "original")
    few = same.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    if few:
        rows = rows.join(F.broadcast(same), "digest", "left")
    else:  # by page: the copies of one payload would meet in one task, with all their content
        slim = rows.select("page_id", "digest").join(same, "digest").where("page_id is not null").distinct()
        nulls = rows.where("page_id is null").join(same, "digest", "left")
        rows = rows.where("page_id is not null").join(slim, ["page_id", "digest"], "left").unionByName(nulls)
    revisit = F.col("original").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("original").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size", F.when(revisit, F.col("original")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("kind"))
    return rows.mapInArrow(_write, _BUNDLES)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for content, index in zip(batch.column(0), batch.column(1), strict=True):
            data, rows = content.as_py(), []
            table, frame_no, frame = seek_table(data), -1, b""
            for at in index.as_py():
                if at["frame"] != frame_no:
                    frame_no, frame = at["frame"], read_frame(data, table[at["frame"]])
                fields, payload = parse_record(frame[at["offset"] : at["offset"] + at["length"]])
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                if fields["WARC-Record-ID"] != at["record_id"]:
                    raise ValueError("the index points at another record")
                if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                    raise ValueError("a payload that its digest does not match")
                number = lambda key: int(fields[key]) if key in fields else None  # noqa: B023, E731
                rows.append((number("X-Page-ID"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number("WARC-Refers-To-Page")))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record, parsed from the archives; every payload is held against its digest."""
    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return archives.select("content", "index").mapInArrow(_read, _READ)


def write(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """The archives, written to the shared folder and read again."""
    return Scratch(pages.sparkSession, "warc").keep(bundles(pages, min_bytes), "bundles")


def export(archives: DataFrame, folder: str) -> None:
    """Write each bundle as a file into a folder that every executor has mounted."""

    def put(rows) -> None:
        import pathlib

        for row in rows:
            path = pathlib.Path(folder, f"{row.bundle_id}.warc.zst")
            path.with_suffix(".part").write_bytes(row.content)
            path.with_suffix(".part").rename(path)

    archives.select("bundle_id", "content").foreachPartition(put)
