"""WARC archives: a writer of one gzip member per record and a sequential reader.

Archives are blobs of bounded size. The query keeps them as rows of a table in the shared folder, which any
store can hold; read() takes such rows or files that Spark's binaryFile source reads. The reader walks a blob
member by member with incremental decompression, frames each record by its content length and checks the
digest of its payload.

Of records with equal payloads of at least `least` bytes, that with the smallest key is a response and the
others are revisits of it; shorter payloads are always responses.

Defined results: a null page is an empty payload. Rows with the same key and payload are one resource: each
is written, and none revisits itself. Rows that share a key but not a payload are told apart by their digests. A
null key has an empty number in its record, which is read as null; such a page is always a response and no other
revisits it. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, table

LEAST = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "key long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, uri string"


def record(key: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    body = HTTP + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if key is None else key}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((uri or "").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Length": str(len(body)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(blob: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a blob, decompressed step by step."""
    at, view = 0, memoryview(blob)
    while at < len(blob):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(blob):
                raise ValueError("a member is cut off")
            part = view[at : at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; the digest of a response is checked."""
    cut = raw.index(b"\r\n\r\n")
    first, *lines = raw[:cut].split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines)}
    n = int(head["content-length"])
    body = raw[cut + 4 : cut + 4 + n]
    if len(body) != n or raw[cut + 4 + n :] != b"\r\n\r\n":
        raise ValueError("content length doesn't frame the record")
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    kind, _, digest = head.get("warc-payload-digest", "").partition(":")
    if head["warc-type"] == "response" and kind == "sha256" and sha256(payload).hexdigest() != digest:
        raise ValueError("payload and digest differ")
    return head, payload


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", uri: str = "url", least: int = LEAST) -> DataFrame:
    """Returns key, uri, html, digest, refers_to."""
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    x = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{uri}`").alias("uri"), text.alias("html"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("size"))
    # only digests with several keys are joined: a narrow table
    first = x.where(F.col("size") >= least).select("key", "digest").groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first")
    again = x.where(F.col("size") >= least).select("key", "digest").join(first, "digest").where("key > first").select("key", "digest", F.col("first").alias("refers_to")).distinct()
    return x.join(again, ["key", "digest"], "left").select("key", "uri", "html", "digest", "refers_to")


def write(pages: DataFrame, key: str = "page_id", html: str = "html", uri: str = "url", least: int = LEAST, archive_bytes: int = 8 << 20) -> DataFrame:
    """Archives as a table: content (binary), each of about archive_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for k, u, h, d, r in zip(*b.columns, strict=True):
                held.append(record(k.as_py(), u.as_py(), h.as_py().encode("utf-8", "surrogatepass"), d.as_py(), r.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    return with_revisits(pages, key, html, uri, least).mapInArrow(run, "content binary")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archives: content (binary). Returns RECORDS in the archives' order; payload is null if it isn't wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        def number(x):
            digits = x.strip("<>").rpartition(":")[2] if x else ""
            return int(digits) if digits else None

        for b in batches:
            for blob in b.column(0):
                rows = []
                for raw in members(blob.as_py()):
                    head, payload = parse(raw)
                    own = head["warc-type"] == "response"
                    digest = head["warc-payload-digest"].partition(":")[2]
                    rows.append((number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")), digest, len(payload) if own else None, payload if own and payloads else None, head.get("warc-target-uri")))
                    if len(rows) >= 500:
                        yield out(rows)
                        rows = []
                yield out(rows)

    return archives.select("content").mapInArrow(run, RECORDS)


def op6(spark, sf_dir: str) -> DataFrame:
    """Query op6_warc."""
    archives = scratch(write(table(spark, sf_dir, "pages")), "warc", codec="uncompressed")
    x = scratch(read(archives, payloads=False).drop("payload", "uri"), "records")
    # a revisit has no payload of its own: its length is that of the record it refers to
    again = x.where("refers_to is not null").select(F.col("refers_to").alias("key"), "payload_digest").distinct()
    size = x.where("record_type = 'response'").join(again, ["key", "payload_digest"]).select(F.col("key").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")).dropDuplicates(["refers_to", "payload_digest"])
    return x.join(size, ["refers_to", "payload_digest"], "left").select(F.col("key").alias("page_id"), F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND n >= 100
"""
