"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``. A bundle ends with two skippable frames:
a record map (identifier -> frame, offset in the frame, length) and the seek table of the Zstandard seekable format, so a
reader fetches the footer, then one frame, and any Zstandard tool still decompresses the file.

A response's block is an HTTP message with the payload; a revisit's is the HTTP head alone, whose Content-Length keeps the
payload's length. Equal payloads (by SHA-1, from ``least_bytes`` on) are written once: the smallest page_id is the response,
the others are revisits that name its record. Which is which is decided on narrow rows (id, digest): map-side combined
aggregates, and a join on the digest that is broadcast or split where it is skewed. Payloads are shuffled by id and digest,
so copies of one payload do not meet in one task, and a writer holds one batch and one frame. Bundles are written by
pyarrow's file systems into the shared folder under names of their own per attempt; only those that surviving attempts
report are listed and read.

A record is known by page_id and digest; where several rows share both, by the row's place too, for which ``pages`` must
come from a plan that numbers rows alike each time, such as files. Reading checks each response's payload against its
digest, and each revisit's digest against that of the record it names.

Nulls: a null html is an empty payload; a null page_id counts as the largest; a null url is written as ``urn:x-none`` and
read back as null. Rows that repeat the smallest page_id of a payload are all responses. CR and LF in urls are
percent-encoded. Pages carry no time of capture, so all records bear ``date``, a parameter. An empty table writes nothing
and reads back nothing. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, materialize, shuffle_partitions, utf8
from .token_files import open_fs

SEEK_MAGIC, SEEK_FRAME, MAP_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_LAST = (1 << 63) - 1
_MANIFEST = "file string, records long, bytes long"


#: When records are said to be captured, unless told otherwise.
DATE = "1970-01-01T00:00:00Z"
_NO_URL = "urn:x-none"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, place: int | None = None) -> str:
    """``digest`` in base 32; ``place`` only where several rows share page_id and digest."""
    return f"urn:page:{'none' if page_id is None else page_id}:{digest}" + ("" if place is None else f":{place}")


def page_of(name: str) -> int | None:
    own = name.split(":")[2]
    return None if own == "none" else int(own)


def encode_record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, a revisit where ``refers_to`` names another record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_NO_URL if url is None else url.replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def decode_records(raw: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Header fields, the payload's length and what the record holds of it."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        body = raw.index(b"\r\n\r\n", end + 4, stop) + 4
        http = dict(x.split(": ", 1) for x in raw[end + 4 : body - 4].decode().split("\r\n")[1:])
        yield head, int(http["Content-Length"]), raw[body:stop]
        at = stop + 4


class BundleWriter:
    def __init__(self, sink, frame_bytes: int):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=3)
        self.part, self.have, self.frames, self.map = [], 0, [], []
        self.size = 0

    def add(self, name: str, record: bytes) -> None:
        self.map.append((name, len(self.frames), self.have, len(record)))
        self.part.append(record)
        self.have += len(record)
        if self.have >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.part:
            packed = self.zip.compress(b"".join(self.part))
            self.frames.append((len(packed), self.have))
            self._put(packed)
            self.part, self.have = [], 0

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.size += len(raw)

    def close(self) -> None:
        self._frame()
        body = self.zip.compress(json.dumps(self.map).encode())
        self._put(struct.pack("<II", MAP_FRAME, len(body)) + body)
        table = [*self.frames, (len(body) + 8, 0)]  # the map counts as a frame of no content
        entries = b"".join(struct.pack("<II", *x) for x in table)
        footer = struct.pack("<IBI", len(table), 0, SEEK_MAGIC)
        self._put(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * n)
        self.frames = list(struct.iter_unpack("<II", source.read(8 * n)))
        self.starts = [0]
        for packed, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.source.seek(self.starts[k])
        packed, full = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=full)

    def records(self) -> Iterator[tuple[dict[str, str], int, bytes]]:
        for k, (_, full) in enumerate(self.frames):
            if full:
                yield from decode_records(self.frame(k))

    def index(self) -> list[list]:
        """[identifier, frame, offset in the frame, length] of each record."""
        self.source.seek(self.starts[-2] + 8)
        return json.loads(zstandard.ZstdDecompressor().decompress(self.source.read(self.frames[-1][0] - 8)))


def read_record(uri: str, name: str) -> tuple[dict[str, str], bytes]:
    """One record by its identifier: reads the footer, the map and one frame."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as source:
        reader = BundleReader(source)
        for key, frame, offset, length in reader.index():
            if key == name:
                head, _, payload = next(decode_records(reader.frame(frame)[offset : offset + length]))
                return head, payload
    raise KeyError(name)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, place, first, first_place): ``first`` is null for responses, places where ids repeat only."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("key", F.coalesce(F.col("page_id"), F.lit(_LAST)))
    own = rows.groupBy("key", "digest").agg(F.count("*").alias("many"), F.min("place").alias("head"), F.max(F.octet_length("html")).alias("size"))
    firsts = own.groupBy("digest").agg(F.min(F.struct("key", "many", "head")).alias("first"))
    own = own.join(firsts, "digest")
    again = (F.col("size") >= least_bytes) & (F.col("key") > F.col("first.key"))
    own = own.select("key", "digest", "many", F.when(again, F.col("first.key")).alias("first"), F.when(again & (F.col("first.many") > 1), F.col("first.head")).alias("first_place"))
    return rows.join(own, ["key", "digest"]).select("page_id", "url", "html", "digest", F.when(F.col("many") > 1, F.col("place")).alias("place"), "first", "first_place")


def write_bundles(pages: DataFrame, where: str, least_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, date: str = DATE) -> DataFrame:
    """Write all pages; returns the manifest (root, file, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(where)
        now, name, done = None, "", []

        def close() -> None:
            now.close()
            done.append((name, len(now.map), now.size))

        for batch in batches:
            data, offs = utf8(batch.column(2))
            narrow = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for i, (page_id, url, digest, place, first, first_place) in enumerate(zip(*narrow, strict=True)):
                if now is None:
                    name = f"{base}/bundle-{uuid.uuid4().hex}.warc.zst"
                    now = BundleWriter(fs.open_output_stream(name, compression=None), frame_bytes)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                own = record_id(page_id, digest, place)
                refers_to = None if first is None else record_id(first, digest, first_place)
                now.add(own, encode_record(own, url, data[offs[i] : offs[i + 1]].tobytes(), digest, refers_to, date))
                if now.size >= bundle_bytes:
                    close()
                    now = None
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "records", "bytes"])

    return materialize(with_revisits(pages, least_bytes).mapInArrow(write, _MANIFEST), "bundles").withColumn("root", F.lit(where))


def read_bundles(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for root, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, _ = open_fs(root)
                rows = []
                with fs.open_input_file(file) as source:
                    for head, size, body in BundleReader(source).records():
                        name, kind, url = head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], head["WARC-Target-URI"]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        other = head.get("WARC-Refers-To", "").strip("<>")
                        if base32_sha1(body) != digest if kind == "response" else other.split(":")[3] != digest:
                            raise ValueError(f"{file}: {name} is damaged")
                        rows.append((page_of(name), None if url == _NO_URL else url, size, digest, kind, page_of(other) if other else None))
                        if len(rows) == 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = manifest.select("root", "file").repartition(shuffle_partitions(manifest.sparkSession), "file")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc_bundles(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_bundles(write_bundles(pages, fresh_dir(spark, "warc"))).drop("url")
