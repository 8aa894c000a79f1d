"""WARC archives: a writer on Spark's text sink and a salvage reader.

The writer makes one string per record, separated by the blank lines that end a WARC
record, so executors write archives straight to any file system Spark knows. Equal payloads
are stored once; later records revisit the first.

The reader goes through each archive record by record. Where a check fails (version
line, header, length, end mark, digest, gzip data) it looks for the next gzip member or
version line that parses, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

END = b"\r\n\r\n"
FILE_RECORDS = 2_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
CHUNK = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, by 20-bit pieces of its hex digits."""
    digits = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*pieces)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with payload_bytes, payload_digest, refers_to and the record's text.

    Among payloads of at least `min_bytes` bytes the record with the smallest page_id holds
    the payload and the others refer to it. A null html is an empty payload, a null url has no
    header. Rows with a null page_id hold their payload and are referred to by none; of rows that
    share page_id and payload all hold it.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.encode("html", "UTF-8")))
    whole = pages.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = whole.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    later = (
        whole.select("page_id", "payload_digest").join(first.filter("last > refers_to").drop("last"), "payload_digest")
        .filter("page_id > refers_to").distinct()
    )
    pages = pages.join(later, ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    )
    return pages.withColumn("record", F.concat(head, F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("html"))))


def write(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none", file_records: int = FILE_RECORDS) -> None:
    """Archives of at most `file_records` records in the folder `path`; "gzip" makes each file one member."""
    sink = records(pages, min_bytes).select("record").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records)
    sink.option("compression", compression).text(path)


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def _head(data: bytes, at: int) -> tuple[dict[str, str], int] | str:
    """Headers and where the payload starts, or what is wrong."""
    if not VERSION.match(data, at):
        return "no version line"
    stop = data.find(END, at)
    if stop < 0:
        return "header without end"
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return "broken header line"
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        return "no content length"
    if not headers.get("warc-type"):
        return "no record type"
    return headers, stop + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_plain(data: bytes, base: int = 0) -> Iterator[Record | Gap]:
    """Records and gaps of uncompressed data; offsets are counted from `base`."""
    at = 0
    while at < len(data):
        head = _head(data, at)
        if isinstance(head, str):
            reason, resume = head, at + 1
        else:
            headers, start = head
            stop = start + int(headers["content-length"])
            payload = data[start:stop]
            told = headers.get("warc-payload-digest", "")
            if stop > len(data):
                reason, resume = "cut off", at + 1
            elif data[stop : stop + 4] != END:
                reason, resume = "no end mark", at + 1
            elif headers["warc-type"] != "revisit" and told.startswith("sha1:") and told[5:] != digest_of(payload):
                reason, resume = "digest differs", stop + 4
            else:
                yield Record(base + at, stop + 4 - at, headers, payload)
                at = stop + 4
                continue
        following = resume
        while True:
            found = VERSION.search(data, following)
            if not found:
                following = len(data)
                break
            following = found.start()
            if not isinstance(_head(data, following), str):
                break
            following += 1
        yield Gap(base + at, following - at, reason)
        at = following


def _before_error(data: bytes, at: int, step: int = 4096) -> bytes:
    """What the deflate data of a broken member gives up to the error: in steps, the last one byte by byte."""
    unpack, out = zlib.decompressobj(31), []
    while at < len(data) and not unpack.eof:
        kept = unpack.copy()
        try:
            out.append(unpack.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            if step == 1:
                break
            unpack, step = kept, 1
    return b"".join(out)


def _member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What a gzip member at `at` gives, where it ends, whether it is whole."""
    unpack, out, i = zlib.decompressobj(31), [], at
    try:
        while i < len(data) and not unpack.eof:
            out.append(unpack.decompress(data[i : i + CHUNK]))
            i += CHUNK
    except zlib.error:
        return _before_error(data, at), min(i, len(data)), False
    return b"".join(out), min(i, len(data)) - len(unpack.unused_data), unpack.eof


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, of gzip members or plain; within a member offsets are those of the member."""
    if not data.startswith(MEMBER) and MEMBER not in data[:4096]:
        yield from read_plain(data)
        return
    at = 0
    while at < len(data):
        plain, stop, whole = _member(data, at) if data.startswith(MEMBER, at) else (b"", at, False)
        good = 0
        for item in read_plain(plain):
            if isinstance(item, Record):
                good += 1
                yield Record(at, stop - at, item.headers, item.payload)
            elif whole:
                yield Gap(at, stop - at, item.reason)
        if whole:
            at = stop
            continue
        following = data.find(MEMBER, at + 1)
        following = len(data) if following < 0 else following
        yield Gap(at, following - at, "broken gzip member" if data.startswith(MEMBER, at) else "no gzip member")
        at = following


SCHEMA = (
    "file string, offset long, length long, gap string, record_type string, record_id string, refers_to string, target string, "
    "payload_length long, payload_digest string, payload binary"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (gap is null) and gaps (gap tells why, the record columns are null) of all archives under `path`.

    A file is one value, so archives have to be of a size that fits a task, as the writer makes them.
    For a revisit, payload_length and payload_digest are those its header tells.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def row(file: str, item: Record | Gap) -> tuple:
        if isinstance(item, Gap):
            return (file, item.offset, item.length, item.reason, *[None] * 7)
        h = item.headers
        revisit = h["warc-type"] == "revisit"
        size = int(h["x-payload-length"]) if revisit and h.get("x-payload-length", "").isdigit() else len(item.payload)
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest_of(item.payload)
        return (
            file, item.offset, item.length, None, h["warc-type"], h.get("warc-record-id"), h.get("warc-refers-to"),
            h.get("warc-target-uri"), size, digest, item.payload,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                held: list[tuple] = []
                size = 0
                for item in read_archive(data.as_py()):
                    held.append(row(file.as_py(), item))
                    size += len(held[-1][-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("path", "content").mapInArrow(run, SCHEMA)


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
