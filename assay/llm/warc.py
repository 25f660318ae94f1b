"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

The writer makes one gzip member per record. Spark's own file writer stores them, so a retried
task never leaves half an archive; it puts one zero byte after each record, which gzip readers
skip as padding.

The reader checks every record: gzip checksum, version line, header lines, length, record end,
block digest. After a failed check it searches for the next place where a whole valid member
or version line begins, goes on from there, and logs the bytes between as a quarantined gap.
Plain and gzip archives may be mixed, also within a file.

Results for unusual input: a null page is an empty payload; a null url gives no target line; a
null page_id gives a record without a page number that is never referred to; rows that repeat
the smallest page_id of a payload are all responses; no rows give no archive and no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.llm.common import ensure_checkpoint_dir

#: Smaller payloads are always stored in full.
SMALLEST_SHARED = 100
RECORDS_PER_FILE = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d")
_FIELDS = ["archive", "offset", "length", "error", "record_id", "record_type", "page_id", "target_uri",
           "refers_to", "declared_digest", "declared_bytes", "payload"]
SCHEMA = ("archive string, offset long, length long, error string, record_id string, record_type string, "
          "page_id long, target_uri string, refers_to long, declared_digest string, declared_bytes long, "
          "payload binary")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit without."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}",
            "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Damaged(ValueError):
    """A check of a record or member failed."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``at``; raises Damaged if any check fails."""
    first = _VERSION.match(data, at)
    if not first:
        raise Damaged("no version line")
    crlf, bare = data.find(b"\r\n\r\n", at), data.find(b"\n\n", at)
    stop, skip = (crlf, 4) if crlf >= 0 and (bare < 0 or crlf < bare) else (bare, 2)
    if stop < 0:
        raise Damaged("header does not end")
    head: dict[str, str] = {}
    try:
        for line in data[first.end():stop].decode().splitlines():
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("header line without a colon")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
    except (UnicodeDecodeError, KeyError, ValueError) as bad:
        raise Damaged(f"bad header: {bad}") from None
    begin = stop + skip
    end = begin + size
    if size < 0 or end > len(data):
        raise Damaged("block is cut short")
    after = 4 if data[end:end + 4] == b"\r\n\r\n" else 2 if data[end:end + 2] == b"\n\n" else 0
    if not after:
        raise Damaged("no record end after the block")
    block = data[begin:end]
    told = head.get("warc-block-digest", "")
    if told.startswith("sha256:") and told[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    return head, block, end + after


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``."""
    d, out, here = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            if here >= len(data):
                raise Damaged("gzip member is cut short")
            out.append(d.decompress(data[here:here + 65536]))
            here += 65536
    except zlib.error as bad:
        raise Damaged(f"gzip: {bad}") from None
    return b"".join(out), min(here, len(data)) - len(d.unused_data)


def _records_at(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The records that begin at ``at``: those of a whole member, or one plain record."""
    if data[at:at + 2] != b"\x1f\x8b":
        head, block, end = parse_record(data, at)
        return [(head, block)], end
    inner, end = inflate(data, at)
    found, here = [], 0
    while here < len(inner):
        head, block, here = parse_record(inner, here)
        found.append((head, block))
    return found, end


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, list[tuple[dict[str, str], bytes]]]]:
    """(offset, length, error, records): error is None for good bytes, else a quarantined gap."""
    at = 0
    while at < len(data):
        while at < len(data) and data[at] in b"\0\r\n":
            at += 1
        if at >= len(data):
            return
        try:
            found, end = _records_at(data, at)
            yield at, end - at, None, found
            at = end
            continue
        except Damaged as bad:
            why = str(bad)
        begin = at
        at = len(data)
        for start in _START.finditer(data, begin + 1):
            try:
                _records_at(data, start.start())
            except Damaged:
                continue
            at = start.start()
            break
        yield begin, at - begin, why, []


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _read(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows, size = [], 0
            for offset, length, error, records in salvage(data):
                if error is not None:
                    rows.append((path, offset, length, error) + (None,) * 8)
                for head, block in records:
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = head.get("warc-type")
                    told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    rows.append((path, offset, length, None, head.get("warc-record-id"), kind,
                                 _number(head.get("warc-record-id")), head.get("warc-target-uri"),
                                 _number(head.get("warc-refers-to")),
                                 head.get("warc-payload-digest", "").removeprefix("sha256:"),
                                 int(told[1]) if told else None, payload if kind == "response" else None))
                    size += len(block)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows):
    s, n = pa.string(), pa.int64()
    kinds = [s, n, n, s, s, s, n, s, n, s, n, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, and one with an ``error`` per quarantined gap."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, SCHEMA)


def _write(batches):
    for batch in batches:
        out, size = [], 0
        for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in
                                                 ("page_id", "url", "html", "refers_to"))):
            out.append(member(record(page_id, url, html.encode(), refers)))
            size += len(out[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def with_revisits(pages: DataFrame, smallest: int = SMALLEST_SHARED) -> DataFrame:
    """page_id, url, html and, for all but the first of equal payloads, ``refers_to``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= smallest, F.sha2("html", 256))
    first = (rows.select("page_id", key.alias("digest")).filter("digest IS NOT NULL").groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    refers = F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first"))
    return (rows.withColumn("digest", key).join(first, "digest", "left")
            .select("page_id", "url", "html", refers.alias("refers_to")))


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST_SHARED,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    members = with_revisits(pages, smallest).mapInArrow(_write, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
