"""Archives read back, by this module and by plain gzip."""

import gzip
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, warc
from graphloom.session import table

SF = "/root/testdata/sf0.01"

LONG = "é" * 700
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (9, "http://a/9", LONG), (3, None, "x" * 1000), (4, "u", "x" * 1000), (5, "u", "y" * 999), (6, "u", "y" * 999),
    (7, "u", None), (8, "u", ""), (8, "u", ""), (None, "bad\r\nurl \x00", "z" * 5000), (None, "n", LONG), (10, "u", "".join(chr(33 + i * i % 900) for i in range(90_000))), (11, "u", "WARC/1.1\r\n\r\nline"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 7, "c", b"d") for p in PAGES], "page_id long, url string, html string, record int, chunk string, data binary").repartition(3)


def written(pages, size=512, **how):
    folder = warc.archives_folder(pages.sparkSession)
    return warc.write_archives(warc.chunk_table(pages, "page_id", "url", "html", size), folder, **how), folder


def expected(pages):
    """id, bytes, digest, type, refers_to of each page; of repeated rows with the largest id one is the response."""
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            again = len(data) >= 1000 and k < len(ids) - 1
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", ids[-1] if again else None))
    return sorted(out, key=str)


def test_pages(pages):
    archives, folder = written(pages, archive_bytes=20_000)
    assert archives.count() > 3
    got = warc.pages_of(warc.read_archives(archives, folder, keep_data=False)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(PAGES) and all(r.intact for r in got)


@pytest.mark.parametrize("size", [100, 1 << 16])
def test_chunks_come_back(pages, size):
    """Every chunk of a read payload is full but the last, and together they are the payload."""
    archives, folder = written(pages)
    read = warc.read_archives(archives, folder, size=size).where("id is not null or type is null or type = 'response'")
    whole = defaultdict(dict)
    for r in read.collect():
        whole[r.record_id][r.chunk] = r
    seen = []
    for chunks in whole.values():
        end = chunks[max(chunks)]
        data = b"".join(bytes(chunks[k].data) for k in range(len(chunks)))
        assert all(len(chunks[k].data) == size for k in range(len(chunks) - 1))
        if end.type == "response":
            assert hashlib.sha1(data).hexdigest() == end.digest and len(data) == end.payload_bytes
            seen.append((end.id, data.decode()))
        elif end.type == "revisit":
            assert data == b""
    want = [(e[0], e[2]) for e in expected(PAGES) if e[3] == "response"]
    assert sorted(((i, hashlib.sha1(d.encode()).hexdigest()) for i, d in seen), key=str) == sorted(want, key=str)


def test_plain_gzip_reads_members(pages):
    """Each record is a gzip member of its own, with right check sums, headers and lengths."""
    archives, folder = written(pages)
    kinds = []
    for row in archives.collect():
        raw = open(f"{folder.removeprefix('file://')}/{row.file}", "rb").read()
        assert len(raw) == row.n_bytes
        gzip.decompress(raw)  # all check sums
        while raw:
            z = zlib.decompressobj(31)
            record, raw = z.decompress(raw), z.unused_data
            head, _, block = record.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
            kinds.append(fields["WARC-Type"])
            assert not any(c in fields.get("WARC-Target-URI", "") for c in " \r\n\0")
    assert kinds.count("response") + kinds.count("revisit") == len(PAGES) and kinds.count("revisit") == 5


def test_foreign_and_damaged(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\nthere"
    stated = b"WARC-Payload-Digest: sha1:AAAA\r\n"
    record = lambda kind, extra, block: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <a>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, extra, len(block), block)
    (tmp_path / "plain.warc").write_bytes(record(b"response", b"Content-Type: application/http\r\n" + stated, body) + record(b"resource", b"", b"raw") + record(b"metadata", b"", b""))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record(b"resource", b"", b"raw" * 1000))[:-30])
    read = lambda name: warc.read_archives(spark.createDataFrame([(name,)], "file string"), f"file://{tmp_path}").collect()
    got = read("plain.warc")
    assert [(r.type, bytes(r.data), r.payload_bytes, r.intact, r.id) for r in got] == [("response", b"hello\nthere", 11, False, None), ("resource", b"raw", 3, None, None), ("metadata", b"", 0, None, None)]
    with pytest.raises(Exception, match="middle of a record"):
        read("cut.warc.gz")


def test_empty(spark):
    archives, folder = written(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archives.count() == 0
    assert warc.pages_of(warc.read_archives(archives, folder, keep_data=False)).count() == 0


def test_query(spark):
    want = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").collect()]
    got = queries.op11_warc(spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(want)
