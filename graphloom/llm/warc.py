"""WARC archives by way of a chunked record table.

A payload never stands whole in a task of this module: it is a run of rows (record, chunk, data)
of at most CHUNK bytes each, deflated by itself, and what is known of a payload only at its end, its
length and its SHA-1, is carried from chunk to chunk and stands on the last row.  Of records
with equal payloads of at least LEAST_BYTES bytes the one with the largest id is written as a
`response`, the others as `revisit` records that refer to it.

Writing lays the chunks of a record behind its header as one gzip member, as readers of WARC
files expect: blocks that are deflated already are laid one after the other, only the check
sum is made anew.  Reading streams an archive back into the same kind of rows.

Archives get their name only when complete, and a table of the archives names those that
count, so a task that is repeated leaves at most an unused file.

Null payloads are empty; a null id is smaller than any other and a record of its own, a null
uri is left out; repeated rows are records of their own, of equal ids the first is the
response.  Empty tables have no archives.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import shared_dir, stage

#: Bytes of a chunk, of an archive (about), and of equal payloads that are written once.
CHUNK, ARCHIVE_BYTES, LEAST_BYTES = 64 << 10, 1 << 30, 1000
#: Bytes of an archive that are read at once; bytes of rows that a reader hands on together.
READ_BYTES, ROWS_BYTES = 1 << 20, 4 << 20
#: Tasks that read archives at most.
MOST_READERS = 100_000

# Names and forms of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GZIP_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
LAST_BLOCK = b"\x03\x00"

CHUNKS = "record long, id long, uri string, chunk int, data binary, payload_bytes long, digest string"


def _deflated(data) -> bytes:
    """Blocks that end at a byte and of which none is the last."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_SYNC_FLUSH)


def chunk_table(rows: DataFrame, id_: str, uri: str, payload: str, size: int = CHUNK) -> DataFrame:
    """The payloads of `rows` as a table of chunks: record (a number of its own for each row),
    chunk (from 0), data (deflated); id, uri, payload_bytes and digest stand on the last chunk of
    a record.  An empty payload has one empty chunk."""
    whole = rows.select(F.monotonically_increasing_id().alias("record"), F.col(id_).cast("long").alias("id"), F.col(uri).alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    last = F.greatest(F.ceil(F.length("payload") / size).cast("int") - 1, F.lit(0))
    cut = whole.select("record", "id", "uri", "payload", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    cut = cut.select("record", "id", "uri", "chunk", F.substring("payload", F.col("chunk") * size + 1, F.lit(size)).alias("data"), (F.col("chunk") == F.col("last")).alias("end"))

    def digest(batches):
        sha, total = hashlib.sha1(), 0
        for batch in batches:
            data, chunks, ends = batch.column("data"), batch.column("chunk").to_pylist(), batch.column("end").to_pylist()
            out, lengths, digests = [], [], []
            for i, (chunk, end) in enumerate(zip(chunks, ends)):
                piece = data[i].as_buffer()
                if chunk == 0:
                    sha, total = hashlib.sha1(), 0
                sha.update(piece)
                total += piece.size
                out.append(_deflated(piece))
                lengths.append(total if end else None)
                digests.append(sha.hexdigest() if end else None)
            uris = pa.array([u if e else None for u, e in zip(batch.column("uri").to_pylist(), ends)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("record"), batch.column("id"), uris, batch.column("chunk"), pa.array(out, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())],
                names=["record", "id", "uri", "chunk", "data", "payload_bytes", "digest"],
            )

    return stage(cut.mapInArrow(digest, CHUNKS), "record-chunks")


def record_types(chunks: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """record, id, uri, payload_bytes, digest, type and, of a revisit, to (the response's record) for each record."""
    records = chunks.where("digest is not null").select("record", "id", "uri", "payload_bytes", "digest")
    one = F.max(F.struct("id", (-F.col("record")).alias("first"))).alias("one")
    groups = records.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), one).where("n > 1").select("digest", (-F.col("one.first")).alias("to"))
    met = records.join(groups, "digest", "left")
    revisit = F.col("to").isNotNull() & (F.col("to") != F.col("record"))
    return met.select("record", "id", "uri", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("to")).alias("to"))


def record_name(run: str, record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), str(record))}>"


def _header(row: dict, run: str, date: str) -> bytes:
    revisit = row["type"] == "revisit"
    fields = [("WARC-Type", row["type"]), ("WARC-Record-ID", record_name(run, row["record"])), ("WARC-Date", date)]
    if row["uri"] is not None:  # what would end a line is escaped
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["uri"])))
    if row["id"] is not None:
        fields.append(("X-Source-ID", str(row["id"])))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_name(run, row["to"]))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(HTTP_HEAD) + (0 if revisit else row["payload_bytes"])))]
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + HTTP_HEAD


class _Archive:
    """One archive; every record is a gzip member."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.sink = fs.open_output_stream(path)
        self.bytes = self.crc = self.size = 0
        self.open_ = False

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def _count(self, plain: bytes) -> None:
        self.crc, self.size = zlib.crc32(plain, self.crc), self.size + len(plain)

    def begin(self, head: bytes) -> None:
        self.end()
        self.crc = self.size = 0
        self.open_ = True
        self._put(GZIP_HEAD)
        self.add(_deflated(head), head)

    def add(self, deflated: bytes, plain: bytes | None = None) -> None:
        self._count(zlib.decompressobj(-15).decompress(deflated) if plain is None else plain)
        self._put(deflated)

    def end(self) -> None:
        if self.open_:
            self.add(_deflated(b"\r\n\r\n"), b"\r\n\r\n")
            self._put(LAST_BLOCK + self.crc.to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little"))
            self.open_ = False


def write_archives(chunks: DataFrame, folder: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records of a chunked table to archives in `folder` (an URI) and gives the table of the archives: file, n_records, n_bytes.

    Payloads meet their headers in one shuffle by record, of deflated chunks; a task streams them, sorted, into its archive."""
    run = str(uuid.uuid4())
    types = record_types(chunks, least)
    total = chunks.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = max(-(-total // archive_bytes), chunks.sparkSession.sparkContext.defaultParallelism)
    heads = types.select("record", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("data"), "id", "uri", "payload_bytes", "digest", "type", "to")
    none = {"id": "long", "uri": "string", "payload_bytes": "long", "digest": "string", "type": "string", "to": "long"}
    bodies = chunks.select("record", "chunk", "data", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    ordered = heads.unionByName(bodies).repartition(archives, "record").sortWithinPartitions("record", "chunk")
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        archive, name, n, kind = None, f"{uuid.uuid4().hex}.warc.gz", 0, None
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            data, chunk = batch.column("data"), batch.column("chunk").to_pylist()
            for i, c in enumerate(chunk):
                if c < 0:
                    row = {k: batch.column(k)[i].as_py() for k in ("record", "id", "uri", "payload_bytes", "digest", "type", "to")}
                    if archive is None:
                        fs.create_dir(root, recursive=True)
                        archive = _Archive(fs, f"{root}/{name}.tmp")
                        about = b"software: graphloom\r\nformat: WARC File Format 1.1\r\n"
                        info = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
                        archive.begin(VERSION + info.encode() + about)
                    archive.begin(_header(row, run, date))
                    kind, n = row["type"], n + 1
                elif kind == "response":
                    archive.add(data[i].as_py())
        if archive is not None:
            archive.end()
            archive.sink.close()
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n], "n_bytes": [archive.bytes]}, schema=schema)

    return stage(ordered.mapInArrow(write, "file string, n_records long, n_bytes long"), "archives")


class _Stream:
    """Plain bytes of an archive, gzipped member by member or not, never more than a block of them ahead."""

    def __init__(self, source, name: str):
        self.source, self.name = source, name
        self.held, self.taken = b"", 0  # `taken`: bytes of lines
        self.rest = source.read(READ_BYTES)
        self.gz = zlib.decompressobj(31) if self.rest[:2] == GZIP_HEAD[:2] else None

    def _more(self) -> bool:
        """Takes a further block; false at the end of the archive."""
        while True:
            if not self.rest:
                self.rest = self.source.read(READ_BYTES)
                if not self.rest:
                    return False
            if self.gz is None:
                got, self.rest = self.rest, b""
            else:
                got = self.gz.decompress(self.rest, READ_BYTES)
                self.rest = self.gz.unconsumed_tail
                if self.gz.eof:
                    self.rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if got:
                self.held = self.held + got if self.held else got
                return True

    def _broken(self):
        return ValueError(f"{self.name}: the archive ends in the middle of a record")

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the archive."""
        while (at := self.held.find(b"\n")) < 0:
            if not self._more():
                if self.held:
                    raise self._broken()
                return None
        line, self.held = self.held[:at], self.held[at + 1 :]
        self.taken += at + 1
        return line.rstrip(b"\r")

    def some(self, most: int) -> bytes:
        """At least one byte, at most `most`."""
        if not self.held and not self._more():
            raise self._broken()
        got, self.held = self.held[:most], self.held[most:]
        return got

    def headers(self) -> dict[str, str]:
        """Fields up to an empty line by their names in lower case."""
        found = {}
        while line := self.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        if line is None:
            raise self._broken()
        return found

    def skip_headers(self) -> int:
        """Bytes of lines up to an empty one, which are passed over."""
        before = self.taken
        self.headers()
        return self.taken - before


READ = "file string, record_id string, chunk int, data binary, type string, id long, uri string, refers_to string, payload_bytes long, digest string, intact boolean"


def read_archives(archives: DataFrame, folder: str, keep_data: bool = True, size: int = CHUNK) -> DataFrame:
    """The records of archives (file) as a chunked table: file, record_id, chunk and data (if it is kept); on the last
    chunk type, id, uri, refers_to (of a revisit), payload_bytes and digest, as counted while reading, and whether the
    digest is the stated one.  Without data only the last row of each record is given.

    The payload of a HTTP record is what stands behind the HTTP header.  Records without an id of ours have none."""
    fields = ["file", "record_id", "chunk", "data", "type", "id", "uri", "refers_to", "payload_bytes", "digest", "intact"]
    types = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(fields, types)))

    def rows(stream: _Stream, name: str):
        while (line := stream.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: not a WARC record")
            head = stream.headers()
            left = int(head["content-length"])
            if left and head.get("content-type", "").startswith("application/http"):
                left -= stream.skip_headers()
            sha, total, chunk = hashlib.sha1(), 0, 0
            held = b""
            while left > 0:
                got = stream.some(min(left, size - len(held)) if keep_data else min(left, READ_BYTES))
                left -= len(got)
                total += len(got)
                sha.update(got)
                if keep_data:
                    held += got
                    if len(held) == size and left:
                        yield (name, head["warc-record-id"], chunk, held, *[None] * 7)
                        held, chunk = b"", chunk + 1
            stated = head.get("warc-payload-digest", "")
            own = "sha1:" + base64.b32encode(sha.digest()).decode()
            revisit = head.get("warc-type") == "revisit"
            number = head.get("x-source-id")
            yield (
                name, head["warc-record-id"], chunk, held if keep_data else None, head.get("warc-type"), int(number) if number else None, head.get("warc-target-uri"), head.get("warc-refers-to"),
                None if revisit else total, None if revisit else sha.hexdigest(), None if revisit or not stated else own == stated,
            )

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], schema=schema)

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for names in batches:
            for name in names.column("file").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    some, held = [], 0
                    for row in rows(_Stream(source, name), name):
                        some.append(row)
                        held += 500 + len(row[3] or b"")
                        if held >= ROWS_BYTES:
                            yield batch(some)
                            some, held = [], 0
                    if some:
                        yield batch(some)

    files = archives.select("file").repartition(max(1, min(archives.count(), MOST_READERS)), "file")
    return files.mapInArrow(read, READ)


def pages_of(read: DataFrame) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to (the response's id) and intact for each response and revisit
    of a read table; what a revisit leaves out is looked up at its response."""
    ends = stage(read.where("type in ('response', 'revisit')").drop("data", "chunk", "file"), "read-records")
    response = ends.where("type = 'response'")
    to = response.select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("digest").alias("d"), F.col("id").alias("to"), F.col("intact").alias("i"))
    revisit = ends.where("type = 'revisit'").select("refers_to", "id", "type").join(to, "refers_to", "left")
    shape = lambda df, b, d, to, i: df.select("id", F.col(b).alias("payload_bytes"), F.col(d).alias("payload_digest"), F.col("type").alias("record_type"), to.alias("refers_to"), F.col(i).alias("intact"))
    return shape(response, "payload_bytes", "digest", F.lit(None).cast("long"), "intact").unionByName(shape(revisit, "b", "d", F.col("to"), "i"))


def archives_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
