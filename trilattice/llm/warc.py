"""WARC archives as seekable Zstandard bundles.

A bundle holds a sequence of independent Zstandard frames, each of whole WARC records, and ends in the seek table
of the published seekable format: a skippable frame with the compressed and plain size of every frame. A record
is found by (bundle, frame, offset in the plain frame). Bundles are rows of a table in the shared folder, one
bundle a row, so that any store Spark can write holds them; their bytes are complete files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.llm.common import byte_texts, slices, table
from trilattice.session import stored

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 22, 3
BROADCAST_ROWS = 100_000
_SPACE = uuid.UUID("8a3f0f52-52f3-5b1e-9d0b-6f2b6f7f5d11")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A stable record URI of a page."""
    return f"<{uuid.uuid5(_SPACE, str(page_id)).urn}>"


def _header_safe(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit (refers_to given) carries no payload, but its length and digest."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, HTTP payload and end offset of the record at an offset."""
    split = plain.index(b"\r\n\r\n", at)
    first, *lines = plain[at:split].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines)
    end = split + 4 + int(headers["Content-Length"])
    block = plain[split + 4 : end]
    if plain[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, block[block.index(b"\r\n\r\n") + 4 :], end + 4


class Bundle:
    """Builds one bundle; `add` returns (frame, offset) of the record."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._close()
        where = len(self.sizes), len(self.open)
        self.open += record
        self.size += len(record)
        return where

    def _close(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.parts.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self._close()
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(body)), body])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of each frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (count - i))
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int, frames: list[tuple[int, int, int]] | None = None) -> bytes:
    at, packed, plain = (frames or seek_table(bundle))[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def fetch(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place; only its frame is unpacked."""
    return read_record(read_frame(bundle, frame), offset)[:2]


def write_archives(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle, records) of pages with the columns page_id, url, html and refers_to.

    A task streams its rows; it holds one open bundle and the record being added.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = Bundle(frame_bytes), []

        def made() -> pa.RecordBatch:
            rows = [{"page_id": p, "frame": f, "offset": o} for p, f, o in index]
            kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([bundle.finish()], pa.binary()), pa.array([rows], kind)], ["bundle", "records"])

        for b in slices(batches):
            for page, url, html, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), b.column(3).to_pylist()):
                index.append((page, *bundle.add(write_record(page, url, html, refers))))
                if bundle.size >= bundle_bytes:
                    yield made()
                    bundle, index = Bundle(frame_bytes), []
        if index:
            yield made()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.col("refers_to").cast("long")).mapInArrow(of, "bundle binary, records array<struct<page_id: long, frame: int, offset: long>>")


def read_archives(bundles: DataFrame) -> DataFrame:
    """One row per record that the index of the bundles (bundle, records) names, read from its frame and offset; the digest of a response is that of the payload read.

    Frames are unpacked one at a time, each once; only what the index names is read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4):
            for bundle, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                frames, out, now, plain = seek_table(bundle), [], -1, b""
                for place in sorted(index, key=lambda r: (r["frame"], r["offset"])):
                    if place["frame"] != now:
                        now = place["frame"]
                        plain = read_frame(bundle, now, frames)
                    h, payload, _ = read_record(plain, place["offset"])
                    page, kind, refers = h.get("X-Page-ID"), h["WARC-Type"], h.get("X-Refers-To-Page")
                    if (page and int(page)) != place["page_id"]:
                        raise ValueError("the index names another record")
                    size, digest = (len(payload), base32_sha1(payload)) if kind == "response" else (int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"))
                    out.append((page and int(page), size, digest, kind, refers and int(refers)))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("bundle", "records").mapInArrow(of, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html and refers_to: null for the page with the largest id of its payload, else that id.

    Only digests are grouped, and only those of repeated payloads are joined back; a counted table of at most
    `broadcast_rows` of them is broadcast, a larger one is joined by a shuffle.
    """
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    repeated = stored(hashed.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "original"), "warc-repeated")
    few = repeated.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = hashed.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Write every page to bundles in the shared folder, and what reading them back finds.

    Null html is an empty payload; a null url leaves out its header. A null page_id gets no id header: it comes
    back null, revisits the largest page_id of its payload, and is a response where that payload has null ids only.
    Rows that repeat the largest page_id of a payload are all responses. An empty table gives an empty one.
    """
    return read_archives(stored(write_archives(with_revisits(pages), **settings), "warc"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS original FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM q
"""
