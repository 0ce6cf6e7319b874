"""Token ids as Arrow files of equal-length sequences.

Texts are encoded in ascending doc_id order and their ids laid one after the other.
Each partition becomes one Arrow IPC file whose record batches hold
`ids: fixed_size_list<uint16 or uint32>[length]` and `mask: fixed_size_list<bool>[length]`
(the mask is false only on the padding behind a file's last id), so sequence i lies at a
fixed place of the file and is read without a copy.  Beside it stands `<file>.docs`, an
IPC file of doc_id, start (ids before the document in this file) and n_tokens.

Files appear under their name only when complete, and a table of the files (`manifest`)
names those that count: a retried or doubled task leaves at most an unused file.

Null texts are empty; a null doc_id comes first; repeated doc_ids are ordered by text and
stay separate rows.  An empty table has no files.  Other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.units import blocks, encoder
from graphloom.session import shared_dir, stage

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 64
#: Tasks that read files at most.
MOST_READERS = 10_000


class _Writer:
    """One file of equal-length sequences, filled from runs of ids."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype, length: int):
        self.length, self.dtype = length, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.length * BATCH:
            run = np.concatenate(self.rest)
            whole = len(run) // (self.length * BATCH) * self.length * BATCH
            for at in range(0, whole, self.length * BATCH):
                self._put(run[at : at + self.length * BATCH], self.length * BATCH)
            self.rest, self.held = [run[whole:]], len(run) - whole

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            run = np.concatenate(self.rest)
            padded = np.zeros(-(-len(run) // self.length) * self.length, self.dtype)
            padded[: len(run)] = run
            self._put(padded, len(run))
        self.file.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = LENGTH) -> DataFrame:
    """Writes the files to `folder` (an URI) and gives the manifest:
    file, part, first_doc, n_docs, n_ids, where part counts files in doc_id order."""

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encode = encoder(tokenizer)
        name = f"{uuid.uuid4().hex}.arrow"
        writer = docs_file = None
        n_docs = n_ids = 0
        first = None
        for batch in batches:
            for block in blocks(batch):
                ids, counts = encode.encode(block.column("text"))
                if writer is None:
                    first = block.column("doc_id")[0].as_py()
                    writer = _Writer(fs, f"{root}/{name}.tmp", encode.dtype, length)
                    docs_sink = fs.open_output_stream(f"{root}/{name}.docs.tmp")
                    docs_schema = pa.schema([("doc_id", block.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    docs_file = pa.ipc.new_file(docs_sink, docs_schema)
                ends = np.cumsum(counts)
                writer.add(np.insert(ids, ends, encode.dtype(end_id)))
                counts = counts + 1
                starts = n_ids + np.cumsum(counts) - counts
                docs_file.write_batch(pa.record_batch([block.column("doc_id"), pa.array(starts), pa.array(counts)], schema=docs_schema))
                n_docs += len(counts)
                n_ids += int(counts.sum())
        if writer is not None:
            writer.close()
            docs_file.close()
            docs_sink.close()
            for end in ("", ".docs"):
                fs.move(f"{root}/{name}{end}.tmp", f"{root}/{name}{end}")
            yield pa.RecordBatch.from_pydict({"file": [name], "first_doc": [first], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=manifest_schema)

    manifest_schema = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(ordered.mapInArrow(write, "file string, first_doc long, n_docs long, n_ids long"), "token-manifest")
    # a row a file: small, so one window may order it
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file")
    return manifest.withColumn("part", F.row_number().over(order) - 1).withColumn("start", F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])


def read_token_files(manifest: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), and ids if they are kept."""

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['file']}"
                source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
                ids = pa.ipc.open_file(source)
                width = ids.schema.field("ids").type.list_size * BATCH
                held: dict[int, np.ndarray] = {}

                def run(a: int, b: int) -> np.ndarray:
                    """Ids a to b of the file: views of its record batches."""
                    parts = []
                    for k in range(a // width, (b - 1) // width + 1):
                        if k not in held:
                            held.pop(k - 2, None)
                            column = ids.get_batch(k).column("ids")
                            held[k] = column.flatten().to_numpy()
                        parts.append(held[k][max(0, a - k * width) : b - k * width])
                    return np.concatenate(parts) if len(parts) > 1 else parts[0]

                with fs.open_input_file(f"{path}.docs") as docs_source:
                    docs = pa.ipc.open_file(docs_source)
                    for i in range(docs.num_record_batches):
                        part = docs.get_batch(i)
                        starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        crcs, kept = np.zeros(len(starts), np.int64), []
                        for j, (a, n) in enumerate(zip(starts.tolist(), counts.tolist())):
                            x = run(a, a + n).astype("<u4")
                            crcs[j] = zlib.crc32(x)
                            if keep_ids:
                                kept.append(x.astype(np.int32))
                        columns = [part.column("doc_id"), pa.array(starts + row["start"]), part.column("n_tokens"), pa.array(crcs)]
                        if keep_ids:
                            columns.append(pa.array(kept, pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    # a row a file; with a number of partitions Spark keeps them apart
    files = manifest.select("file", "start").repartition(max(1, min(manifest.count(), MOST_READERS)), "file")
    return files.mapInArrow(read, schema)


def token_files_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
