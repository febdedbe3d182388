"""Operator 5: WARC archives, index first.

Writing. Every page becomes one record in a gzip member of its own (``.warc.gz``). Of pages with equal payloads the one
with the largest id is the ``response``; the others are ``revisit`` records that refer to it and carry no payload.
Which is which is settled on (id, digest) rows alone; whole pages are shuffled once. A task writes its archives to the
shared folder under names that no other attempt uses and returns, for every record, file, offset, length, URL and
digest. Those rows are the index. It is a Parquet table written by Spark's commit protocol, so it only ever names
files of tasks that succeeded: a lost executor or a second attempt leaves files that no index row points to.

Reading. Selected index rows are dealt in ranges of (file, offset), sorted, and neighbours less than ``GAP`` bytes apart
are read in one go of at most ``SPAN`` bytes (more only for a single larger record).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, shuffle_parts, table, uri_filesystem

ROLL, GAP, SPAN = 256 << 20, 64 << 10, 8 << 20
_INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, as WARC payload digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_of_hex(hexed: F.Column) -> F.Column:
    """Base32 of a 40-digit hex string with built-in functions: 5 hex digits are 4 letters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_bytes(page_id: int | None, url: str | None, digest: str, payload: bytes | None, payload_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` None makes a revisit. The HTTP header keeps the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = "".join(" " if c in "\r\n" else c for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The fields of ``_RECORD`` of one record; a response whose payload doesn't have its digest raises an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged payload in {h['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := h[name][10:-1]) else None
    return number("WARC-Record-ID"), h["WARC-Target-URI"], size, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None, payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes all pages below ``folder`` and returns the index, read back from ``folder``/index.

    Payload: the html as UTF-8, null as empty. Payloads under ``least_bytes`` are never revisits. Of rows with equal
    id and payload one is the response and the others revisit that id. Null ids sort lowest. Other columns are not read.
    """
    spark = pages.sparkSession
    none = -(2**63)
    p = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(none)).alias("key"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    ids = p.select("key", F.unhex("sha").alias("sha"), F.octet_length("html").alias("size"))
    latest = ids.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("key").alias("latest"))  # copies meet in the map-side combine
    roles = ids.select("key", "sha").distinct().join(latest, "sha").select("key", F.lower(F.hex("sha")).alias("sha"), "latest")
    kept = p.repartition("key", "sha").join(roles, ["key", "sha"], "left").sortWithinPartitions("key", "sha", "url").select("key", "url", "html", "latest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = uri_filesystem(folder)
        out, name, at, last = None, "", 0, None
        try:
            for batch in batches:
                rows = []
                for key, url, html, latest in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(top, recursive=True)
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    payload = html.encode()
                    digest = digest_of(payload)
                    page_id, copy = None if key == none else key, latest is not None and (latest != key or (key, digest) == last)
                    last = key, digest  # equal rows stand together: one is the response
                    member = gzip.compress(record_bytes(page_id, url, digest, None if copy else payload, len(payload), latest if copy and latest != none else None), 6, mtime=0)
                    out.write(member)
                    rows.append((page_id, url, digest, "revisit" if copy else "response", name, at, len(member)))
                    at += len(member)
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    kept.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined to reads: file, start, size and the (offset, length) in each."""
    held: tuple | None = None
    for file, offset, length in ranges:
        if held and held[0] == file and offset - (held[1] + held[2]) <= gap and offset + length - held[1] <= span:
            held = file, held[1], max(held[2], offset + length - held[1]), [*held[3], (offset - held[1], length)]
        else:
            if held:
                yield held
            held = file, offset, length, [(0, length)]
    if held:
        yield held


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, each checked against its digest; any subset and order of rows will do."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = uri_filesystem(folder)
        names = [x.split()[0] for x in _RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        opened, name = None, None
        for batch in batches:
            rows = []
            for file, start, size, parts in coalesced(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if name != file:
                    opened, name = fs.open_input_file(f"{top}/{file}"), file
                data = opened.read_at(size, start)
                for offset, length in parts:
                    r = parse_record(zlib.decompress(data[offset : offset + length], 31))
                    rows.append(r if payloads else (*r[:6], None))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = shuffle_parts(selected.sparkSession)
    dealt = selected.select("file", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length")).repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, _RECORD)


def op5_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGEST = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '')"
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS latest FROM p)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE CAST(latest AS BIGINT) END AS refers_to
FROM r
"""
