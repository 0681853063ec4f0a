"""WARC archives as seekable Zstandard bundles, written and read back by Spark."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.session import checkpoint, shared_folder

# Fixed values of the Zstandard seekable format (little-endian 32-bit magic numbers).
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE = 0x8F92EAB1

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
#: The last byte of every bundle (of ``SEEKABLE``); Spark's text writer puts it there as the line end.
LAST_BYTE = "\x8f"
SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 response or revisit record; a revisit keeps the headers of the payload it leaves out."""
    target = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames, record index and seek table of one archive file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self._frame_bytes = frame_bytes
        self._packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open, self._open_bytes = [], 0
        self._index: list[bytes] = []
        self.bytes = 0

    def add(self, identifier: str, record: bytes) -> None:
        """Append a record; its index entry is (identifier, frame, offset in the frame, length)."""
        key = identifier.encode()
        self._index.append(struct.pack("<HIII", len(key), len(self._sizes), self._open_bytes, len(record)) + key)
        self._open.append(record)
        self._open_bytes += len(record)
        if self._open_bytes >= self._frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            frame = self._packer.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._open_bytes))
            self.bytes += len(frame)
            self._open, self._open_bytes = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        index = zstandard.ZstdCompressor(level=3).compress(b"".join(self._index))
        entries = b"".join(struct.pack("<II", *pair) for pair in (*self._sizes, (8 + len(index), 0)))
        footer = struct.pack("<IBI", len(self._sizes) + 1, 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer
        return b"".join([*self._frames, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, table])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the footer; the last one is the record index."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    head = len(bundle) - 9 - 8 * count
    if struct.unpack("<I", bundle[head - 8 : head - 4])[0] != SKIPPABLE_SEEK:
        raise ValueError("damaged seek table")
    frames, at = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", bundle, head + 8 * k)
        frames.append((at, packed, plain))
        at += packed
    return frames


def record_index(bundle: bytes) -> list[tuple[str, int, int, int]]:
    """(identifier, frame, offset in the frame, length) of every record."""
    at, packed, _ = seek_table(bundle)[-1]
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(bundle[at + 8 : at + packed])
    out, at = [], 0
    while at < len(raw):
        size, frame, offset, length = struct.unpack_from("<HIII", raw, at)
        at += 14
        out.append((raw[at : at + size].decode(), frame, offset, length))
        at += size
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def parse_record(record: bytes) -> dict:
    """Page id, type, target, digests and payload of one record, checked against its digest."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page), "record_id": fields["WARC-Record-ID"], "url": fields["WARC-Target-URI"],
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write_archives(
    pages: DataFrame, path: str | None = None, minimum: int = 0, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> str:
    """Write one record per row of ``pages`` (page_id, url, html) and return the folder of the bundles.

    Of the rows whose payloads are equal and of ``minimum`` bytes or more, that of the largest
    page_id is the response and the others revisit it. A null html is an empty payload. A
    null page_id is archived without an id, and revisits when its payload has a row with one. Rows that repeat the
    largest page_id of a payload are responses all.

    Only digests that occur more than once are joined back, from a written table whose size
    Spark knows, so pages are not shuffled where these are few. Each task packs the rows it
    has into bundles of about ``bundle_bytes``; a bundle is one row, written as one file by Spark's
    text writer with the last byte of the format as its line end, so the committer handles retries.
    """
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("payload"), F.sha1(html).alias("digest"))
    groups = rows.filter(F.octet_length("payload") >= minimum).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = checkpoint(groups.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    planned = rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")
    )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bundle: Bundle) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bundle.finish()[:-1]], pa.binary())], ["bundle"])

        bundle, filled = Bundle(frame_bytes), False
        for batch in batches:
            for page, url, payload, first, revisit in zip(*batch.columns, strict=True):
                page, payload = page.as_py(), payload.as_py()
                bundle.add(record_id(page), warc_record(page, url.as_py(), payload, first.as_py(), revisit.as_py(), date))
                filled = True
                if bundle.bytes >= bundle_bytes:
                    yield row(bundle)
                    bundle, filled = Bundle(frame_bytes), False
        if filled:
            yield row(bundle)

    bundles = planned.mapInArrow(pack, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    bundles.write.option("encoding", "ISO-8859-1").option("lineSep", LAST_BYTE).option("maxRecordsPerFile", 1).text(path)
    return path


FIELDS = "page_id bigint, record_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of every bundle, through seek table and record index; payloads are checked against their digests."""
    fields = FIELDS if payloads else FIELDS.removesuffix(", payload binary")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                bundle = content.as_py()
                frames, rows, now, plain = seek_table(bundle), [], -1, b""
                for _, frame, offset, length in record_index(bundle):
                    if frame != now:
                        if rows:
                            yield _records(rows, names)
                            rows = []
                        now, plain = frame, read_frame(bundle, frames[frame])
                    rows.append(parse_record(plain[offset : offset + length]))
                if rows:
                    yield _records(rows, names)

    return _bundles(spark, path).mapInArrow(run, fields)


def _records(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, path, frame, frame_start, frame_bytes, plain_bytes, offset, length): where each record is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "path", "frame", "frame_start", "frame_bytes", "plain_bytes", "offset", "length"]
        for batch in batches:
            for where, content in zip(*batch.columns, strict=True):
                bundle = content.as_py()
                frames = seek_table(bundle)
                rows = [(key, where.as_py(), frame, *frames[frame], offset, length) for key, frame, offset, length in record_index(bundle)]
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names)

    return _bundles(spark, path).mapInArrow(run, "record_id string, path string, frame bigint, frame_start bigint, frame_bytes bigint, plain_bytes bigint, offset bigint, length bigint")


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``; only frames that hold one are decompressed."""
    entries = archive_index(spark, path).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    frames = entries.groupBy("path", "frame", "frame_start", "frame_bytes", "plain_bytes").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                plain = zstandard.ZstdDecompressor().decompress(row["packed"], max_output_size=row["plain_bytes"])
                yield _records([parse_record(plain[s["offset"] : s["offset"] + s["length"]]) for s in row["spans"]], names)

    cut = _bundles(spark, path).join(frames, "path").select("plain_bytes", "spans", F.expr("substring(content, int(frame_start + 1), int(frame_bytes))").alias("packed"))
    return cut.mapInArrow(run, FIELDS)
