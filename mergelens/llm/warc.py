"""WARC archives in which equal payloads are stored once.

1. Headers (page id, payload digest, length) are shuffled by digest; of equal
   payloads of at least ``least`` bytes the one with the largest page id is the
   response, the others revisit it. A digest's winner is a maximum with map-side
   partial results, so a payload that a third of all pages share is no large group.
2. Revisit decisions go back to the pages by page id. A revisit record has fresh
   headers and no payload; its HTTP header still gives the payload's length.
3. Every task writes its records, one gzip member each, into archives of about
   ``archive_bytes``. Spark's writer puts each archive in a file of its own on the
   shared folder (with one zero byte of padding at the end, which gzip ignores).
4. Reading parses the members one after another by their lengths.

Null html is an empty payload, a null url has no target header, a null page id an
empty one. Control characters in a url are percent-encoded. Of rows with the same
page id and payload all have the same type. An empty table writes no record.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.sources.staging import Staging

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _member(body: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of an archive, up to its padding."""
    at = 0
    while at < len(data) and data[at] == 0x1F:
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof:
            piece = data[at : at + 65_536]
            if not len(piece):
                raise ValueError("archive ends inside a record")
            parts.append(opener.decompress(piece))
            at += len(piece)
        at -= len(opener.unused_data)
        yield b"".join(parts)


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or with ``refers_to`` a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url))
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(body: bytes) -> tuple:
    """Page id, payload length, digest (computed where the record has the payload), type, refers_to, url."""
    head, _, block = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = hashlib.sha1(payload).hexdigest()
        if found != digest or len(payload) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(name: str) -> int | None:
        text = fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(text) if text else None

    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To"), fields.get("WARC-Target-URI")


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """``page_id``, ``digest`` and ``refers_to`` of the records that revisit another page's payload."""
    headers = pages.filter(F.col("bytes") >= least).select("page_id", "digest")
    winners = headers.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    winners = winners.filter("n > 1").drop("n")
    return headers.join(winners, "digest").filter("page_id < refers_to").distinct()


def write_archives(
    pages: DataFrame, path: str, stage: Staging, id: str = "page_id", url: str = "url", html: str = "html",
    least: int = 1000, archive_bytes: int = 8_000_000, date: str = "2026-01-01T00:00:00Z",
) -> None:
    """Write all pages as WARC records below ``path``."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "bytes": F.octet_length("body")})
    decided = stage.table("revisits", revisits(rows, least))
    marked = rows.join(decided, ["page_id", "digest"], "left").select("page_id", "url", "body", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                member = _member(record(*row, date))
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]})

    archives = marked.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    archives.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [parse(body) for body in members(memoryview(content.as_buffer()))]
                columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)
