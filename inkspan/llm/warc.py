"""WARC archives in Zstandard: writing, and a reader that trusts nothing.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, plain or itself a Zstandard frame; then comes one frame per record.
The reader loads the dictionary, decodes frame by frame, and checks for each
record the version, the required headers, that Content-Length is the length of
the block, the two line ends after it, and the block and payload digests.

Of pages with equal payloads of at least ``least`` bytes, the one with the
largest id is a response record and the others are revisits that refer to it;
equal means equal SHA-256.  A revisit keeps the HTTP head, and so the payload's
length, without the payload.

Archives are written to the shared folder by the tasks themselves, each under a
name of its attempt; only the names that the finished tasks return are read, so
a lost executor's files are never mistaken for data.  Reading and writing are
streams: a task holds one record (and at first the dictionary's sample) at a time.

Defined results: null html is an empty payload; null ids and repeated ids are
written record by record, and a null id never outranks another; urls that are
null or have control characters are escaped; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete_path, scratch_path

DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"
SAMPLE_BYTES, DICTIONARY_BYTES, CHUNK = 1 << 20, 1 << 14, 1 << 20
ARCHIVE_BYTES = 1 << 28


class BadArchive(ValueError):
    pass


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    body = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(body) if body else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:x-none', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{sha1(payload)}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def type(self) -> str:
        return self.headers["warc-type"]

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, found, body = self.block.partition(b"\r\n\r\n")
        if not found or not head.startswith(b"HTTP/"):
            raise BadArchive("the block is no HTTP message")
        return _headers(head.split(b"\r\n")[1:]), body


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"no header: {line[:80]!r}")
        key = name.decode().lower()
        if key in out:
            raise BadArchive(f"header twice: {key}")
        out[key] = value.strip().decode()
    return out


def parse(data: bytes) -> Record:
    """The one record that a frame holds."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or first not in (b"WARC/1.0", VERSION):
        raise BadArchive(f"no WARC record: {data[:40]!r}")
    headers = _headers(lines)
    if missing := [x for x in REQUIRED if not headers.get(x)]:
        raise BadArchive(f"headers missing: {missing}")
    if not headers["content-length"].isdigit() or len(rest) != (n := int(headers["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("Content-Length isn't the length of the block")
    out = Record(headers, rest[:n])
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{sha1(out.block)}":
        raise BadArchive("the block doesn't have its digest")
    if out.type == "response" and (want := headers.get("warc-payload-digest")):
        http, body = out.http
        if want != f"sha1:{sha1(body)}" or http.get("content-length", str(len(body))) != str(len(body)):
            raise BadArchive("the payload doesn't have its digest or length")
    return out


def write_archive(records: Iterator[bytes], out) -> int:
    """Writes the dictionary's frame and a frame per record; returns their number."""
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8)
    except zstandard.ZstdError:  # too little to train on
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(plain)) + plain)
    compressor, n = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True), 0
    for part in (sample, records):
        for r in part:
            out.write(compressor.compress(r))
            n += 1
    return n


def read_archive(source) -> Iterator[Record]:
    """The records of an archive; source is a binary stream."""
    head = source.read(8)
    if len(head) < 8:
        raise BadArchive("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise BadArchive("the archive doesn't begin with a dictionary frame")
    plain = source.read(size)
    if len(plain) != size:
        raise BadArchive("the dictionary frame is cut off")
    if plain.startswith(ZSTD_MAGIC):
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(plain)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    left = source.read(CHUNK)
    while left:
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            if frame.eof:
                break
            if not (left := source.read(CHUNK)):
                raise BadArchive("the last frame is cut off")
        left = frame.unused_data or source.read(CHUNK)
        yield parse(b"".join(parts))


def with_references(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): null for responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    slim = rows.where(F.length("payload") >= least)
    first = slim.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows of with_references to archives in folder: (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i) for i in range(4)), strict=True))
        written = [0]

        def records(first: bytes) -> Iterator[bytes]:
            yield first
            written[0] = len(first)
            while written[0] < archive_bytes and (r := next(rows, None)) is not None:
                data = record(*(x.as_py() for x in r))
                written[0] += len(data)
                yield data

        fs, base = pafs.FileSystem.from_uri(folder)
        while (r := next(rows, None)) is not None:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(path) as out:
                n = write_archive(records(record(*(x.as_py() for x in r))), out)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "records"])

    return cut(pages.mapInArrow(run, "path string, records long"))


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of archives (path, records) as rows of one page each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(path) as source:
                    for r in read_archive(source):
                        http, body = r.http
                        size = int(http["content-length"])
                        refers = r.headers.get("warc-refers-to")
                        rows.append((_page(r.headers["warc-record-id"]), size, r.headers["warc-payload-digest"].removeprefix("sha1:"), r.type, _page(refers) if refers else None))
                        n += 1
                        if len(rows) >= 10_000:
                            yield _pages(rows)
                            rows = []
                if n != want:
                    raise BadArchive(f"{path} has {n} records, {want} were written")
                if rows:
                    yield _pages(rows)

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op9(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    try:
        archives = write(with_references(pages), folder)
        return cut(read(archives, folder))
    finally:
        delete_path(spark, folder)
