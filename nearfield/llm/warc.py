"""WARC archives: writer, and sequential reader of one gzip member per record.

Writer: pages with equal payloads (SHA-1 and length) share one ``response``, the one of largest page_id; the others are
``revisit`` records without payload that name it. Finding it is a partial aggregate of narrow rows by digest and a left join
with the digests that occur more than once: broadcast up to ``LENT`` of them, so the payloads stay where they are read;
beyond that a sorted join, in which adaptive execution splits a hot digest as the aggregated side has one row for it.
Archives are rows of a Parquet table (binary, about ``PART`` bytes compressed each): Spark's committer makes them
whole or absent when executors are lost, and no executor writes to a local disk. ``export`` gives them as files.

Reader: feeds each archive in small pieces to incremental zlib decompression, frames the record by its header block and
Content-Length, and checks payload and block digests; a member holds exactly one record. Memory holds one record.

Defined cases: null html is an empty payload; null page_id is smaller than any other; repeated rows (equal id and
payload) are alike, so all rows with the largest id are responses, and each has a number behind its record id; null url gives no target URI; an empty table gives no
archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import table, written

PART, PIECE, LENT = 8 << 20, 1 << 16, 200_000
#: The tables have no fetch times; the format requires one.
DATE = "1970-01-01T00:00:00Z"
ARCHIVES = "archive string, n_records int, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, sha1: str, number=None) -> str:
    """A page's name: its id, its payload's digest, and a number where rows repeat."""
    return f"<urn:page:{'' if page_id is None else page_id}:{sha1}{'' if number is None else f':{number}'}>"


def record(page_id, url, payload: bytes, sha1: str, refers_to, number=None) -> bytes:
    """One gzip member. ``refers_to``: the response's page_id, or 'self' for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to != "self"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1, number)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _archives(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    task, part, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{part:06d}.warc.gz"]), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "n_records", "data"])

    for batch in batches:
        for page_id, url, html, last, copies, number in zip(*[x.to_pylist() for x in batch.columns[:2]], batch.column(2), *[x.to_pylist() for x in batch.columns[3:]], strict=True):
            payload = (html.as_py() or "").encode()
            copy = copies is not None and len(payload) >= least and page_id != last
            held.append(record(page_id, url, payload, digest(payload), last if copy else "self", number))
            size += len(held[-1])
            if size >= PART:
                yield flush()
                part, held, size = part + 1, [], 0
    if held:
        yield flush()


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)``; payloads of fewer than ``least`` bytes are always responses. The archives."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).alias("size"))
    each = rows.groupBy("sha1", "size", "page_id").agg(F.count("*").alias("n"))
    several = each.groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.sum("n").alias("copies"), F.max("n").alias("alike")).where("copies > 1")
    several = written(several, "warc-copies")
    if several.count() <= LENT:
        several = F.broadcast(several)
    number = F.when(F.col("alike") > 1, F.monotonically_increasing_id())
    joined = rows.join(several, ["sha1", "size"], "left").select("page_id", "url", "html", "last", "copies", number.alias("number"))
    return written(joined.mapInArrow(lambda x: _archives(x, least), ARCHIVES), "warc", "none")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive, in order, as its pieces arrive."""
    unpack, text, left = zlib.decompressobj(31), bytearray(), b""
    for piece in pieces:
        left = piece
        while left:
            text += unpack.decompress(left)
            left = unpack.unused_data
            if unpack.eof:
                yield framed(bytes(text))
                unpack, text = zlib.decompressobj(31), bytearray()
            else:
                break
    if text or left:
        raise ValueError("the archive ends inside a record")


def framed(text: bytes) -> tuple[dict[str, str], bytes]:
    """One record: version line, named fields, a block of Content-Length bytes, two line ends and nothing else."""
    head, gap, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("this is no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: its length is not the Content-Length")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: the block digest differs")
    return fields, block


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = RECORDS.replace(",", "").split()[::2]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        for data in batch.column(0):
            view, rows, held = memoryview(data.as_buffer()), [], 0
            for fields, block in records(bytes(view[k : k + PIECE]) for k in range(0, len(view), PIECE)):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, sha1 = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                if kind == "response" and (len(payload) != size or digest(payload) != sha1):
                    raise ValueError(f"record {fields.get('warc-record-id')}: the payload digest differs")
                rows.append((_page(fields["warc-record-id"]), size, sha1, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if kind == "response" else None))
                held += len(payload)
                if held > PART:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(archives: DataFrame) -> DataFrame:
    """The records of all archives, verified; a damaged record is an error."""
    return archives.select("data").mapInArrow(_records, RECORDS)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file in ``folder``, which driver and executors must share; their paths."""

    def files(batches):
        for batch in batches:
            Path(folder).mkdir(parents=True, exist_ok=True)
            paths = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                paths.append(f"{folder}/{name}")
                Path(paths[-1]).write_bytes(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return archives.select("archive", "data").mapInArrow(files, "path string")


def op10_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    return read(write(table(spark, sf_dir, "pages"))).drop("url", "payload")


OP10_SQL = """
WITH h AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM m
"""
