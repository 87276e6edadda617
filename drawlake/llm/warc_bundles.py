"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, with a seek table in a
skippable frame at its end; any Zstandard reader can decompress it from start to end.  Writing returns an
index that maps every record id to its bundle, frame and offset in the decompressed frame.

* Roles.  Records of equal payload (SHA-1 and length) form a class; the one with the smallest id is its
  ``response``, others are ``revisit`` records without payload.  The smallest id is found in two steps, per
  slice of a class and per class, and is joined back by slice, so a class of a third of all rows is dealt over
  ``SLICES`` keys and no join meets it in one place.
* Writing.  Every task writes bundles of its own rows under names that no other attempt uses.  The index
  is the commit: a bundle that a lost or repeated task left behind is named nowhere in it.
* Reading.  Bundles' seek tables become one row per frame; the frames are dealt over the cluster and
  each is read by its range of bytes.  A task holds one frame at a time, which is ``FRAME_BYTES`` or one record.

Files are opened by URI (``file``, ``hdfs``, ``viewfs``, ``s3``, ``gs`` or a mounted path) in the tasks.

Defined results: null html is an empty payload; a null url becomes ``urn:page:ID``; control characters and
blanks of a url are percent-encoded; a null id is smallest only where all ids of its class are null; rows
with equal id, payload and url are the same record written again, and rows that share their class's
smallest id are all responses; very long payloads get a frame of their own; an empty table writes no
bundle.  Columns other than the three named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import ship, staged
from drawlake.session import ensure_checkpoint_dir

#: Bytes of a frame before compression, bytes of a bundle, slices of a class of equal payloads.
FRAME_BYTES, BUNDLE_BYTES, SLICES = 1 << 20, 256 << 20, 64
#: Payloads from this size on can be revisits.
MIN_REVISIT = 0
LEVEL = 3

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

_unsafe = re.compile(r"[\x00-\x20\x7F]")


def record_urn(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, first: int | None, revisit: bool,
           date: str) -> tuple[str, bytes]:
    """Id and bytes of one record; ``digest`` and ``length`` are the full payload's, also where it is left out."""
    name = record_urn(page_id, digest)
    uri = _unsafe.sub(lambda c: quote(c[0]), url) if url is not None else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_urn(first, digest)}>"]
        if first is not None:
            head.append(f"WARC-Refers-To-Page-ID: {first}")
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Writes records into frames; ``close`` appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.code = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.parts: list[bytes] = []
        self.raw = self.written = 0
        self.table: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset there of the record."""
        if self.raw and self.raw + len(data) > self.frame_bytes:
            self._flush()
        at = (len(self.table), self.raw)
        self.parts.append(data)
        self.raw += len(data)
        return at

    def _flush(self) -> None:
        packed = self.code.compress(b"".join(self.parts))
        self.sink.write(packed)
        self.table.append((len(packed), self.raw))
        self.written += len(packed)
        self.parts, self.raw = [], 0

    def close(self) -> None:
        if self.raw:
            self._flush()
        entries = b"".join(struct.pack("<II", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """``start, size, raw size`` of the frames of an open bundle."""
    end = source.size()
    source.seek(end - FOOTER_BYTES)
    frames, flags, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    source.seek(end - FOOTER_BYTES - width * frames)
    raw = source.read(width * frames)
    table, at = [], 0
    for k in range(frames):
        size, full = struct.unpack_from("<II", raw, k * width)
        table.append((at, size, full))
        at += size
    return table


def read_frame(source, start: int, size: int, raw: int) -> bytes:
    source.seek(start)
    data = zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=raw)
    if len(data) != raw:
        raise ValueError("frame shorter than its seek table says")
    return data


@dataclass
class Parsed:
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    end: int


def parse(data: bytes, at: int) -> Parsed:
    """The record that begins at ``at``; a response's payload is checked against its digest."""
    middle = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:middle].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no record at this offset")
    headers = dict(line.split(": ", 1) for line in lines)
    start = middle + 4
    stop = start + int(headers["Content-Length"])
    if data[stop: stop + 4] != b"\r\n\r\n":
        raise ValueError("record of another length than its header says")
    head = data.index(b"\r\n\r\n", start, stop) + 4
    payload = data[head:stop]
    length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[start:head])[1])
    if headers["WARC-Type"] == "response":
        if length != len(payload) or f"sha1:{base32(payload)}" != headers["WARC-Payload-Digest"]:
            raise ValueError("payload differs from its digest")
    return Parsed(headers, payload, length, stop + 4)


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(text: str | None) -> int | None:
    return None if text is None else int(text)


def _row(found: Parsed) -> tuple:
    h = found.headers
    return (_id(h.get("WARC-Page-ID")), h["WARC-Record-ID"][1:-1], h["WARC-Target-URI"], found.payload_bytes,
            h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], _id(h.get("WARC-Refers-To-Page-ID")))


def roles(pages: DataFrame, min_revisit: int = MIN_REVISIT, slices: int = SLICES) -> DataFrame:
    """``pages`` (page_id, url, payload) with hex digest, length, ``first_id`` of its class and ``revisit``."""
    known = pages.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    known = known.withColumn("slice", F.pmod(F.xxhash64("page_id", "url"), F.lit(slices)).cast("int"))
    part = known.groupBy("digest", "bytes", "slice").agg(F.min("page_id").alias("part_id"))
    whole = part.groupBy("digest", "bytes").agg(F.min("part_id").alias("first_id"))
    first = part.drop("part_id").join(whole, ["digest", "bytes"])
    return known.join(first, ["digest", "bytes", "slice"]).select(
        "page_id", "url", "digest", "bytes", "first_id",
        ((F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"), "payload")


def _writer(folder: str, date: str, frame_bytes: int, bundle_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        bundle, name, rows = None, "", []

        def done():
            bundle.close()
            columns = [list(c) for c in zip(*rows)]
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for values in zip(*batch.columns):
                page_id, url, digest, length, first, revisit, payload = (v.as_py() for v in values)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                urn, data = record(page_id, url, payload, digest, length, first, revisit, date)
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes, level)
                frame, offset = bundle.add(data)
                rows.append((urn, page_id, name, frame, offset, len(data)))
                if bundle.written >= bundle_bytes:
                    yield done()
                    bundle, rows = None, []
        if bundle:
            yield done()

    return write


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write a record for every row of ``pages`` below ``folder`` and return the committed index."""
    spark = pages.sparkSession
    ship(spark)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    return staged(roles(chosen, min_revisit).mapInArrow(_writer(folder, date, frame_bytes, bundle_bytes, level), INDEX), "warc-index")


def _tables(folder: str):
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as source:
                    starts, sizes, raws = (list(c) for c in zip(*seek_table(source)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(starts)), pa.array(range(len(starts)), pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, sizes, raws))],
                    names=["bundle", "frame", "start", "size", "raw"])

    return tables


def frames(index: DataFrame, folder: str) -> DataFrame:
    """``bundle, frame, start, size, raw`` of the frames of all bundles that the index names."""
    bundles = index.select("bundle").distinct()
    return bundles.mapInArrow(_tables(folder), "bundle string, frame int, start long, size long, raw long")


def _reader(folder: str, chosen: bool, payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if source:
                        source.close()
                    name, source = row["bundle"], store.open_input_file(f"{root}/{row['bundle']}")
                data, rows = read_frame(source, row["start"], row["size"], row["raw"]), []
                offsets = row["offsets"] if chosen else None
                at = 0
                while at < len(data) if offsets is None else offsets:
                    found = parse(data, at if offsets is None else offsets.pop())
                    at = found.end
                    rows.append((*_row(found), found.payload) if payload else _row(found))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
        if source:
            source.close()

    return read


def _dealt(found: DataFrame, index: DataFrame, task_bytes: int = 32 << 20) -> DataFrame:
    """Frames in tasks of about ``task_bytes`` of records, those of a bundle side by side."""
    raw = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-raw // task_bytes))
    return found.repartition(int(tasks), "bundle", "frame").sortWithinPartitions("bundle", "frame")


def read_archive(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """All records of the committed bundles, from their frames."""
    ship(index.sparkSession)
    return _dealt(frames(index, folder), index).mapInArrow(_reader(folder, False, payload), RECORD + ", payload binary" * payload)


def fetch(index: DataFrame, folder: str, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``; only their frames are read."""
    ship(index.sparkSession)
    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    # Records of one frame are bounded by its size.
    asked = places.groupBy("bundle", "frame").agg(F.collect_set("offset").alias("offsets"))
    found = frames(places, folder).join(asked, ["bundle", "frame"])
    return _dealt(found, places).mapInArrow(_reader(folder, True, payload), RECORD + ", payload binary" * payload)


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of the 160 bits of SHA-1, five at a time.
ORACLE = """
WITH known AS (
  SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS hex FROM pages
), spelled AS (
  SELECT page_id, payload_bytes, hex, CAST(unhex(hex) AS BIT)::VARCHAR AS bits FROM known
), coded AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
             + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
             + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
         MIN(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id
  FROM spelled
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM coded
"""
