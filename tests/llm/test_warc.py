import base64
import gzip
import hashlib

import pytest

from latticework.llm import warc

PAGES = [(3, "http://a/", "<p>ä</p>"), (1, None, "<p>ä</p>"), (2, "http://b/ c", None), (4, "http://c/", ""), (5, "http://d/", "WARC/1.1\r\n\r\n\r\nx" * 3),
         (6, "http://e/", "long " * 50_000), (None, "http://f/", "<p>ä</p>"), (1, None, "<p>ä</p>")]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize(("compression", "min_bytes"), [("none", 0), ("gzip", 0), ("none", 5)])
def test_round_trip(spark, tmp_path, compression, min_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write(pages.withColumn("record", pages.url), path, min_bytes, compression, file_records=3)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES) and all(r.gap is None for r in rows)
    first = {}
    for i, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        if len((html or "").encode()) >= min_bytes:
            first.setdefault(html or "", i)
    want = sorted(
        (str(i), len((h or "").encode()), sha(h), "response" if i is None or first.get(h or "", i) == i else "revisit",
         None if i is None or first.get(h or "", i) == i else first[h or ""]) for i, _, h in PAGES
    )
    page = lambda name: None if not (name or "").removeprefix("<urn:page:")[:-1] else int(name.removeprefix("<urn:page:")[:-1])
    got = sorted((str(page(r.record_id)), r.payload_length, r.payload_digest, r.record_type, page(r.refers_to)) for r in rows)
    assert str(got) == str(want)
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}


def record(i, payload, digest=True):
    told = f"WARC-Payload-Digest: sha1:{sha(payload)}\r\n" if digest else ""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n{told}Content-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n".encode()


def names(items):
    return [x.headers["warc-record-id"][10:-1] if isinstance(x, warc.Record) else (x.offset, x.length) for x in items]


def test_salvage_of_plain_archives():
    a, b, c = record(1, "first"), record(2, "second text"), record(3, "third")
    assert names(warc.read_archive(a + b + c)) == ["1", "2", "3"]
    assert names(warc.read_archive(a + b"garbage\r\n" + c)) == ["1", (len(a), 9), "3"]
    assert names(warc.read_archive(a + b[:-8] + c)) == ["1", (len(a), len(b) - 8), "3"]
    assert names(warc.read_archive(a + b.replace(b"second", b"sEcond") + c)) == ["1", (len(a), len(b)), "3"]
    assert names(warc.read_archive(a + b.replace(b"Content-Length: 11", b"Content-Length: x") + c)) == ["1", (len(a), len(b) - 1), "3"]
    assert names(warc.read_archive(a + b[:20])) == ["1", (len(a), 20)]
    assert names(warc.read_archive(b"")) == []
    inside = record(4, "x\r\n\r\nWARC/1.1\r\nnot a record")
    assert names(warc.read_archive(inside + c)) == ["4", "3"]


def test_salvage_of_gzip_archives():
    a, b, c = (gzip.compress(record(i, f"text {i}" * 50)) for i in (1, 2, 3))
    assert names(warc.read_archive(a + b + c)) == ["1", "2", "3"]
    assert names(warc.read_archive(a + b"junk" + c)) == ["1", (len(a), 4), "3"]
    broken = bytearray(b)
    broken[-6] ^= 255  # the checksum: the record inside is whole, the member is not
    assert names(warc.read_archive(a + bytes(broken) + c)) == ["1", "2", (len(a), len(b)), "3"]
    assert names(warc.read_archive(a + b[: len(b) // 2] + c))[0] == "1" and names(warc.read_archive(a + b[: len(b) // 2] + c))[-1] == "3"


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
