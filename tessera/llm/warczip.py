"""WARC records in ZIP-packaged archives, written and read back by ranges.

An archive is a ZIP file with two stored members: ``records.warc.gz`` (a gzip member for each record) and
``index.cdxj`` (a line for each record with its range).  The reader finds members through the end record, its
ZIP64 counterpart and the central directory, locates their bytes through the local headers, and reads only the
ranges of the index and of the records; nothing is extracted.

Defined results: a null html is an empty payload; of records with equal payloads of at least ``min_bytes`` bytes the
one with the largest page_id (null ids are smallest) is the response and the others revisit it; rows repeated with
that id are responses too; an empty table gives no rows; columns but page_id, url and html are not read, whatever their
names; a target URI is written without its white space and control characters, and a null one as empty; a very long
html is held whole by one worker, and ends the archive that it comes to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bestfit import filesystem, write_whole
from .common import attach, reading_parts, saved, scratch, small_batches, to_batch

RECORDS, INDEX = "records.warc.gz", "index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class Archive:
    """The stored members of a ZIP file of which only ranges are read."""

    def __init__(self, f) -> None:
        self.f = f
        f.seek(0, 2)
        size = f.tell()
        tail_at = max(0, size - 65_557 - 20)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            end64 = self.read(at, 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int]] = {}
        directory, at = self.read(start, length), 0
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain, n, m, k, header = (*struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<II", directory, at + 20), *struct.unpack_from("<HHH", directory, at + 28), *struct.unpack_from("<I", directory, at + 42))
            name = directory[at + 46 : at + 46 + n].decode()
            extra = directory[at + 46 + n : at + 46 + n + m]
            if 0xFFFFFFFF in (packed, plain, header):
                plain, packed, header = self._wide(extra, plain, packed, header)
            if method:
                raise ValueError(f"{name} is not stored")
            self.members[name] = (header, packed)
            at += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, *fields: int) -> list[int]:
        """The ZIP64 extra field has, in order, those values that did not fit."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                return [next(values) if x == 0xFFFFFFFF else x for x in fields]
            at += 4 + n
        raise ValueError("no ZIP64 field")

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def range(self, name: str) -> tuple[int, int]:
        """Where a member's bytes begin, and how many there are."""
        header, n = self.members[name]
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        a, b = struct.unpack_from("<HH", local, 26)
        return header + 30 + a + b, n


def archive_bytes(records: list[bytes], index: list[bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((RECORDS, records), (INDEX, index)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                for x in parts:
                    f.write(x)
    return out.getvalue()


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, archive_size: int = 32 << 20) -> DataFrame:
    """Write a record for each row; returns the archives: path, records."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = saved(pages.select("page_id", F.sha1(html).alias("sha1"), F.octet_length(html).alias("n")).filter(F.col("n") >= min_bytes), "payloads")
    groups = digests.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("size")).filter("size > 1")
    met = attach(digests, saved(groups, "payload_groups"), "sha1", "size", digests.count())
    revisits = saved(met.filter("not (page_id <=> top)").select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1"), "top").distinct(), "revisits")
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["__id"]) & (F.sha1("html") == revisits["__sha1"]), "left").select("page_id", "url", "html", "top", F.col("__sha1").isNotNull().alias("revisit"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def work(batches):
        from pyspark import TaskContext

        task, records, index, size, k = TaskContext.get(), [], [], 0, 0

        def flush():
            path = f"{out}/part-{task.partitionId():05d}-{k:05d}.zip"
            write_whole(path, archive_bytes(records, index), str(task.taskAttemptId()))
            return to_batch(schema, {"path": [path], "records": [len(records)]})

        for b in batches:
            for row in b.to_pylist():
                data = gzip.compress(record(row["page_id"], row["url"], row["html"], row["top"], row["revisit"]), 6, mtime=0)
                index.append(f"{row['page_id']} {DATE} {json.dumps({'offset': size, 'length': len(data)})}\n".encode())
                records.append(data)
                size += len(data)
                if size >= archive_size:
                    yield flush()
                    records, index, size, k = [], [], 0, k + 1
        if records:
            yield flush()

    return saved(rows.mapInArrow(work, "path string, records long"), "archives")


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, verify: bool = True) -> DataFrame:
    """Every record of the archives; a response's payload is held against its digest."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None):
        return int(n) if urn and (n := urn[len("<urn:page:") : -1]) else None

    def row(data: bytes) -> tuple:
        warc, http, payload = parse_record(gzip.decompress(data))
        digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
        n = int(http["content-length"])
        if verify and kind == "response" and (len(payload) != n or digest32(payload) != digest):
            raise ValueError(f"{warc['warc-record-id']}: the payload does not match its digest")
        return number(warc["warc-record-id"]), n, digest, kind, number(warc.get("warc-refers-to"))

    def work(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_file(at) as f:
                    archive = Archive(f)
                    base, _ = archive.range(RECORDS)
                    lines = archive.read(*archive.range(INDEX)).decode().splitlines()
                    for i in range(0, len(lines), 1000):
                        ranges = [json.loads(x.split(" ", 2)[2]) for x in lines[i : i + 1000]]
                        rows = [row(archive.read(base + r["offset"], r["length"])) for r in ranges]
                        yield to_batch(schema, dict(zip(schema.names, zip(*rows))))

    return archives.select("path").repartition(reading_parts(archives.sparkSession, archives.count(), 1), "path").mapInArrow(work, ROWS)


def round_trip(pages: DataFrame, out: str | None = None, min_bytes: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, out or scratch(pages.sparkSession, "warc"), min_bytes))


#: Base 32 takes five bits a letter, so four letters of each five hexadecimal digits.
ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p
)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""
