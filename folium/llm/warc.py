"""Operator 1: Zstandard WARC archives: a writer, and a reader that validates.

An archive is a leading skippable frame that holds the compression dictionary (itself a zstd frame),
then one zstd frame for each record. The reader loads the dictionary, decodes frame by frame and checks
version line, mandatory headers, lengths, the closing blank lines and payload digests.

Records of equal payloads are deduplicated: of those with at least `revisit_bytes`, the one with the
largest page_id is a response and the others are revisits that refer to it.

Archives are rows (path, content), as Spark's binaryFile source gives them, so anything that Spark can
read can be read here, and no task needs a local disk; export() makes them files. A revisit must refer to a
response whose payload has its digest: unresolved() finds those that don't, in one aggregation.

Defined results: null html is an empty payload. A null page_id is written and read back as null; it is
the original of others only if none of them has an id, and then all are responses. Rows that repeat the
largest page_id are all responses. A null url leaves its header out. No rows make no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R

#: Fixed values of the formats.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
MANDATORY = ("warc-record-id", "warc-date", "warc-type", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"

REVISIT_BYTES, ARCHIVE_BYTES = 1000, 32 << 20
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 16 << 10, 1 << 20, 256
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class ArchiveError(ValueError):
    """An archive or a record that breaks the format."""


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(null|-?\d+)>", uri)
    if not m:
        raise ArchiveError(f"not a page's record id: {uri!r}")
    return None if m[1] == "null" else int(m[1])


def header_text(s: str) -> str:
    """s without characters that would end a header."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str = NO_DATE) -> bytes:
    """A response, or where refers_to is set a revisit, with an HTTP head and the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_uri(page_id)), ("WARC-Date", date)]
    head += [("WARC-Target-URI", header_text(url))] if url is not None else []
    head += [("WARC-Refers-To", page_uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)] * revisit
    head += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from a bounded number of an archive's first records; None where they are too few."""
    take, total = [], 0
    for s in samples[:SAMPLE_RECORDS]:
        if total + len(s) > SAMPLE_BYTES:
            break
        take.append(s)
        total += len(s)
    if len(take) < 16 or total < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, take, level=3)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    """An archive of these records."""
    d = train(records)
    out = []
    if d:
        packed = zstandard.ZstdCompressor(level=9).compress(d.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True) if d else zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    out += map(c.compress, records)
    return b"".join(out)


def frames(content: bytes) -> Iterator[bytes]:
    """What each record's frame holds; the leading skippable frame is the dictionary."""
    view, at, d = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise ArchiveError("the dictionary's frame is cut off")
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
        d, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    while at < len(view):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ArchiveError("the last frame is cut off")
            piece = view[at : at + (16 << 10)]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame at byte {at} doesn't decode: {e}") from e
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def headers(block: bytes, what: str) -> tuple[bytes, dict[str, str], bytes]:
    """First line, headers by lower-case name, and the rest."""
    head, blank, rest = block.partition(b"\r\n\r\n")
    if not blank:
        raise ArchiveError(f"{what}: no end of headers")
    first, *lines = head.split(b"\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"{what}: not a header: {line[:60]!r}")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return first, out, rest


def length_of(head: dict[str, str], what: str) -> int:
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise ArchiveError(f"{what}: Content-Length is missing or no number")
    return int(head["content-length"])


def parse(raw: bytes) -> dict:
    """A record's fields, validated."""
    first, head, rest = headers(raw, "record")
    if not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ArchiveError(f"not a version line: {first[:40]!r}")
    if lacks := [k for k in MANDATORY if not head.get(k)]:
        raise ArchiveError(f"a record lacks {', '.join(lacks)}")
    n = length_of(head, "record")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"record {head['warc-record-id']}: a block of {n} bytes and two line ends were announced, {len(rest)} bytes follow")
    kind = head["warc-type"]
    out = {"page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload": None}
    if kind not in ("response", "revisit"):
        return out | {"payload_bytes": n, "payload_digest": None}
    status, http, payload = headers(rest[:n], "HTTP")
    if not status.startswith(b"HTTP/"):
        raise ArchiveError(f"not a status line: {status[:40]!r}")
    size, (name, _, digest) = length_of(http, "HTTP"), head.get("warc-payload-digest", "").partition(":")
    if name != "sha1" or not re.fullmatch("[A-Z2-7]{32}", digest):
        raise ArchiveError(f"record {head['warc-record-id']} has no SHA-1 payload digest")
    digest = base64.b32decode(digest)
    if kind == "revisit":
        if payload or "warc-refers-to" not in head:
            raise ArchiveError(f"revisit {head['warc-record-id']} has a payload or refers to nothing")
        out["refers_to"] = page_of(head["warc-refers-to"])
    elif len(payload) != size or hashlib.sha1(payload).digest() != digest:
        raise ArchiveError(f"record {head['warc-record-id']}: payload and its length or digest differ")
    else:
        out["payload"] = payload
    return out | {"payload_bytes": size, "payload_digest": digest.hex()}


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, records, total = R.chunk_ids(), [], 0

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([f"part-{next(names):016x}.warc.zst"]), pa.array([archive(records)], pa.binary())], names=["path", "content"])

    for b in batches:
        for page_id, url, payload, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
            records.append(record(page_id, url, payload, bytes.fromhex(digest), refers_to))
            total += len(records[-1])
            if total >= ARCHIVE_BYTES:
                yield done()
                records, total = [], 0
    if records:
        yield done()


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in RECORDS.split(", ")) if with_payload or n != "payload"])
        for b in batches:
            for content in b.column("content").to_pylist():
                rows, total = [], 0
                for raw in frames(content):
                    rows.append(parse(raw))
                    total += rows[-1]["payload_bytes"] if with_payload else 0
                    if len(rows) >= 4096 or total >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, total = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def write_archives(pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(path, content): archives of the records of pages (page_id, url, html)."""
    R.attach(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_bytes)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).mapInArrow(_write, "path string, content binary")


def read_archives(archives: DataFrame, *, payload: bool = True) -> DataFrame:
    """The records of archives (content binary), in no order; RECORDS, without the last column unless payload."""
    R.attach(archives.sparkSession)
    return archives.select("content").mapInArrow(_read(payload), RECORDS if payload else RECORDS.removesuffix(", payload binary"))


def unresolved(records: DataFrame) -> DataFrame:
    """page_id and payload_digest that revisits among records refer to, where no response has them."""
    kind, page = F.col("record_type"), F.coalesce("refers_to", "page_id")
    found = records.groupBy(page.alias("page_id"), "payload_digest").agg(F.max(kind == "revisit").alias("asked"), F.max(kind == "response").alias("there"))
    return found.where("asked and not there").select("page_id", "payload_digest")


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Writes archives as files under a folder that all executors reach (file, s3, gs or hdfs URI); (path, bytes) of each.

    A file is written aside and moved into place, so that a task that is run again leaves whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, folder = fs.FileSystem.from_uri(uri)
        to.create_dir(folder, recursive=True)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer()
                aside = f"{folder}/.{path}.{uuid.uuid4().hex}"
                with to.open_output_stream(aside, compression=None) as out:
                    out.write(data)
                to.move(aside, f"{folder}/{path}")
                yield pa.record_batch([pa.array([path]), pa.array([data.size], pa.int64())], names=["path", "bytes"])

    return archives.select("path", "content").mapInArrow(write, "path string, bytes long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; an error if a revisit refers to nothing."""
    archives = R.checkpointed(write_archives(pages))
    if lost := unresolved(read_archives(archives, payload=False)).first():
        raise ArchiveError(f"a revisit refers to page {lost.page_id} for a payload with digest {lost.payload_digest}, which it doesn't have")
    return read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
