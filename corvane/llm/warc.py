"""Seekable Zstandard WARC bundles.

A bundle is a run of Zstandard frames, each holding up to ``frame_bytes`` of whole
WARC records and decodable alone, then a skippable frame with a seek table: per
frame its compressed and raw sizes, per record its identifier, frame and offset
in the frame. A reader maps identifiers to places and decodes one frame a record.
Records are WARC/1.1: responses hold an HTTP head and the payload, revisits the
head alone; every record has an id of its own, and all bear ``date``, since the
pages have none. A page's identifier is its id in decimal; pages that share one
are all found under it.

Of records whose payloads are equal and at least ``least`` bytes long, that with
the smallest id is a response and the others revisit it; shorter ones are all
responses. Null payloads are empty. Null ids sort after all others; a row whose
id is null is written with an empty id and read back as null. Rows that repeat the
response's id and payload are responses too. An empty table gives no bundle and
an empty result.

Bundles are rows of a scratch table (bundle, content), so that Spark's commit
makes each whole or absent; ``export`` writes them out as files.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch

# The magic numbers of a skippable frame and of this footer.
SKIPPABLE = 0x184D2A5E
FOOTER = 0x57A2C5EE
DIGEST_FIELD = "WARC-Payload-Digest"


def record(page: int | None, number: str, url: str, payload: bytes, size: int, digest: str, refers: tuple[int | None, str] | None, date: str) -> bytes:
    """A WARC/1.1 record, a revisit where it ``refers`` to a response's page and URL.

    number: tells the record from all others of the archive.
    """
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{number} {page} {digest}'.encode()).digest()[:16], version=4)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"{DIGEST_FIELD}: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if page is not None:
        fields.append(f"X-Page-ID: {page}")
    if refers is not None:
        fields += [f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {date}"]
        fields.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers[0] is not None:
            fields.append(f"X-Refers-To-Page: {refers[0]}")
    block = head + (payload if refers is None else b"")
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields and payload of the record at an offset, and the next record's offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, data[data.index(b"\r\n\r\n", start, stop) + 4 : stop], stop + 4


class Bundle:
    """Collects records into frames."""

    def __init__(self, frame_bytes: int = 256 << 10, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.out: list[bytes] = []
        self.open: list[bytes] = []
        self.raw = self.size = 0

    def add(self, name: str, data: bytes) -> None:
        if self.raw and self.raw + len(data) > self.frame_bytes:
            self._close()
        self.index.append((name.encode(), len(self.frames), self.raw))
        self.open.append(data)
        self.raw += len(data)

    def _close(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.frames.append((len(packed), self.raw))
        self.out.append(packed)
        self.size += len(packed)
        self.open, self.raw = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        names = b"".join(struct.pack("<HII", len(n), f, o) + n for n, f, o in self.index)
        body = table + names + struct.pack("<III", len(self.frames), len(self.index), FOOTER)
        footer = struct.pack("<II", SKIPPABLE, len(body) + 4) + body + struct.pack("<I", len(body) + 12)
        return b"".join(self.out) + footer


class Reader:
    """Random access to a bundle through its seek table."""

    def __init__(self, data: bytes):
        self.data = data
        (size,) = struct.unpack_from("<I", data, len(data) - 4)
        start = len(data) - size
        magic, _ = struct.unpack_from("<II", data, start)
        frames, records, footer = struct.unpack_from("<III", data, len(data) - 16)
        if magic != SKIPPABLE or footer != FOOTER:
            raise ValueError("not a seekable bundle")
        self.frames, at, sum_at = [], start + 8, 0
        for _ in range(frames):
            packed, raw = struct.unpack_from("<II", data, at)
            self.frames.append((sum_at, packed, raw))
            sum_at += packed
            at += 8
        self.index: list[tuple[str, int, int]] = []
        for _ in range(records):
            n, f, o = struct.unpack_from("<HII", data, at)
            self.index.append((data[at + 10 : at + 10 + n].decode(), f, o))
            at += 10 + n
        self.places: dict[str, list[tuple[int, int]]] = {}
        for n, f, o in self.index:
            self.places.setdefault(n, []).append((f, o))
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return self.unpacker.decompress(self.data[at : at + packed], max_output_size=raw)

    def get(self, name: str) -> list[tuple[dict[str, str], bytes]]:
        """The records of an identifier, of which only their frames are decoded."""
        return [parse(self.frame(f), o)[:2] for f, o in self.places.get(name, [])]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record by its place in the seek table, each frame decoded once."""
        have, data = -1, b""
        for _, f, o in self.index:
            if f != have:
                have, data = f, self.frame(f)
            yield parse(data, o)[:2]


def write(pages: DataFrame, least: int = 100, bundle_bytes: int = 16 << 20, frame_bytes: int = 256 << 10, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles (bundle string, content binary) of (page_id, url, html) rows, as a scratch table."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("size"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
    )
    # One row for each long payload, whatever the number of its copies; joined on
    # the digest, whose hot values the adaptive skew join splits.
    first = (
        given.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("f"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("d"), F.col("f.page_id").alias("refers"), F.col("f.url").alias("there"))
    )
    marked = given.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    repeat = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers"))
    rows = marked.select(
        "page_id", "url", F.when(~repeat, F.col("body")).otherwise("").alias("body"), "size", "digest", "refers", repeat.alias("revisit"), "there"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, number, part = Bundle(frame_bytes), 0, TaskContext.get().partitionId()
        line = lambda x: x.replace("\r", " ").replace("\n", " ")

        def done() -> pa.RecordBatch:
            data = bundle.finish()
            name = f"{hashlib.sha256(data).hexdigest()[:24]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["bundle", "content"])

        for b in batches:
            cols = [b.column(k) for k in range(8)]
            for i in range(b.num_rows):
                page, url, text, size, digest, refers, revisit, there = (c[i].as_py() for c in cols)
                data = record(page, f"{part}-{number}", line(url), text.encode(), size, digest, (refers, line(there)) if revisit else None, date)
                number += 1
                bundle.add("" if page is None else str(page), data)
                if bundle.size >= bundle_bytes:
                    yield done()
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield done()

    return scratch.table(rows.mapInArrow(pack, "bundle string, content binary"), "warc")


def read(bundles: DataFrame) -> DataFrame:
    """Rows of every record, from the archives alone; a response's digest is taken from its payload."""

    def page(name: str | None) -> int | None:
        return None if name is None else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in Reader(content.as_py()).records():
                    revisit = fields["WARC-Type"] == "revisit"
                    said = fields[DIGEST_FIELD].removeprefix("sha256:")
                    digest = said if revisit else hashlib.sha256(block).hexdigest()
                    if digest != said:
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    size = int(fields["X-Payload-Length"]) if revisit else len(block)
                    refers = page(fields.get("X-Refers-To-Page")) if revisit else None
                    rows.append((page(fields.get("X-Page-ID")), size, digest, fields["WARC-Type"], refers, fields["WARC-Target-URI"], block if not revisit else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return bundles.select("content").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def digest(pages: DataFrame, least: int = 100) -> DataFrame:
    """What the archives of ``pages`` say of each page."""
    return read(write(pages, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to ``folder``, a URI that pyarrow's file systems reach, and return (bundle, bytes).

    A file gets its name, a digest of its content, only once it is whole, so a
    task that runs twice leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{root}/.{name}.{hashlib.sha256(struct.pack('<d', time.time())).hexdigest()[:8]}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], ["bundle", "bytes"])

    return bundles.select("bundle", "content").mapInArrow(run, "bundle string, bytes long")
