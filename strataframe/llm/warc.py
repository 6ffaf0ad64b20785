"""WARC archives: one gzip member per record, written in blocks, and a sequential reader.

The reader feeds zlib chunk by chunk, so it holds one record at a time, frames records by Content-Length, and verifies
block and payload digests. Archives are rows of binary blocks in shared storage, since executors share no local folder.

Defined results: null html is an empty payload; payloads under `least` bytes are always responses; of equal longer ones
the row with the largest page_id is the response and the others revisit it (rows that repeat that page_id are responses
too; rows with null page_id revisit it; if all are null, all are responses); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tidy

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 4) -> bytes:
    """One record as a gzip member of its own."""
    head = b"".join([VERSION, CRLF, *[f"{k}: {v}\r\n".encode() for k, v in headers], f"Content-Length: {len(block)}\r\n".encode(), CRLF])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(CRLF + CRLF) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 4) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers += [("WARC-Payload-Digest", digest32(payload)), ("WARC-Block-Digest", digest32(block)), ("Content-Type", "application/http; msgtype=response")]
    return member(headers, block, level)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream of chunks, one after another."""
    z, out, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            out.append(z.decompress(chunk))
            chunk = b""
            if z.eof:
                chunk = z.unused_data
                yield b"".join(out)
                z, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends within a record")


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record. A wrong frame or digest raises ValueError."""
    for data in members(chunks):
        head, sep, rest = data.partition(CRLF + CRLF)
        lines = head.split(CRLF)
        if not sep or not lines[0].startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != CRLF + CRLF:
            raise ValueError("Content-Length does not frame the record")
        block = rest[:n]
        if "warc-block-digest" in headers and digest32(block) != headers["warc-block-digest"]:
            raise ValueError("block digest does not match")
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str]:
    """Bytes and SHA-1 (hex) of the full payload: of a response as read and verified, of a revisit as its headers state."""
    stated = headers["warc-payload-digest"]
    http, _, body = block.partition(CRLF + CRLF)
    if headers["warc-type"] == "response":
        if digest32(body) != stated:
            raise ValueError("payload digest does not match")
        return len(body), hashlib.sha1(body).hexdigest()
    length = next(int(x.partition(b":")[2]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    return length, base64.b32decode(stated.partition(":")[2]).hex()


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, block_mb: int = 4, level: int = 4) -> DataFrame:
    """pages -> rows (records int, archive binary) in shared storage; each row is an archive of whole gzip members."""
    raw = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("html")).withColumn("_digest", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "utf-8"))))
    # Only payloads found twice need the join; counts and maxima are summed before the shuffle.
    first = base.where("_digest is not null").groupBy("_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marked = base.join(first, "_digest", "left").select("page_id", "url", "html", F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n = [], 0, 0
        schema = pa.schema([("records", pa.int32()), ("archive", pa.binary())])
        for b in slices(batches, "html"):
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                out.append(page_record(row[0], row[1], row[2].encode(), row[3], level))
                size, n = size + len(out[-1]), n + 1
                if size >= block_mb << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([b"".join(out)], pa.binary())], schema=schema)
                    out, size, n = [], 0, 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([b"".join(out)], pa.binary())], schema=schema)

    return materialize(marked.mapInArrow(tidy(write), "records int, archive binary"), "warc")


def read_archives(archives: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Archive blocks -> one row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def number(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                data, rows = archive.as_buffer(), []
                for headers, block in records(data.slice(i, min(chunk, len(data) - i)).to_pybytes() for i in range(0, len(data), chunk)):
                    n, digest = payload_of(headers, block)
                    kind = headers["warc-type"]
                    rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, number(headers.get("warc-refers-to")), n, digest, block.partition(CRLF + CRLF)[2] if kind == "response" else None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return archives.select("archive").mapInArrow(tidy(read), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM m
"""
