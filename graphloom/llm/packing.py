"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k has the lengths over
capacity/(k+1) and up to capacity/k, and a bin of class k takes k pieces of whatever
lengths of the class, one behind the other.  Documents are cut at the powers of two (capacity, capacity/2, ... down to
SMALLEST), whose classes their bins fill without a gap; only the rest below SMALLEST, a
piece of its own, is in a class that leaves a few ids of padding.

A bin needs pieces of one class only, so each worker fills bins of its own.  What a
worker has left of a class, less than one bin, meets the rests of a few other workers,
and so on; the rests of all workers, less than a bin of each class, are then laid by
falling length into the last bins, whose number depends on the classes alone.

Null texts are empty (the end id alone); rows with a null or repeated doc_id are
documents like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.units import blocks, encoder
from graphloom.session import stage

CAPACITY, SMALLEST = 2048, 128
#: Workers whose rests meet in a round.
FAN = 32
#: Sequence ids: the round, then the worker or group, then the bin.
_ROUND, _GROUP = 1 << 58, 1 << 34

PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cut(n: np.ndarray, capacity: int = CAPACITY, smallest: int = SMALLEST) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of documents of n ids: powers of two, the largest first, and a rest.  The document and the length of each."""
    powers = [capacity >> i for i in range(capacity.bit_length()) if i == 0 or capacity >> i >= smallest]
    rest = n % powers[-1]
    values = np.stack([np.broadcast_to(p, n.shape) for p in powers] + [rest], 1)
    times = np.stack([n // capacity] + [(n % capacity) // p % 2 for p in powers[1:]] + [rest > 0], 1)
    return np.repeat(np.arange(len(n)), times.sum(1)), np.repeat(values.ravel(), times.ravel())


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids if they are kept.  `capacity` is a power of two, 2048 at most."""
    extra = ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in (PIECE + extra).split(", ")]

    def encode(batches):
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        code = encoder(tokenizer)
        waiting = piece_schema.empty_table()
        bins = 0

        def placed(table: pa.Table, where: np.ndarray | None, offset: np.ndarray | None) -> list[pa.RecordBatch]:
            n = len(table)
            columns = [pa.array(np.full(n, worker)), *(pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (where, offset))]
            for name, column in zip(("worker", "sequence_id", "offset"), columns):
                table = table.append_column(name, column)
            return table.combine_chunks().to_batches(max_chunksize=20_000)

        for batch in batches:
            for block in blocks(batch):
                ids, counts = code.encode(block.column("text"))
                ids = np.insert(ids, np.cumsum(counts), code.dtype(end_id)).astype("<u4")
                n = counts + 1
                doc, length = cut(n, capacity)
                ends = np.cumsum(length)
                view = memoryview(ids)
                crcs = [zlib.crc32(view[a:b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
                columns = [block.column("doc_id").take(pa.array(doc)), pa.array(ends - length - (np.cumsum(n) - n)[doc]), pa.array(length.astype(np.int32)), pa.array(crcs, pa.int64()), pa.array(n[doc])]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32))))
                rows = pa.concat_tables([waiting, pa.Table.from_arrays(columns, schema=piece_schema)])
                # of each class as many bins as its pieces fill; the others wait
                length = rows.column("length").to_numpy().astype(np.int64)
                class_ = capacity // np.maximum(length, 1)
                order = np.argsort(class_, kind="stable")
                full, first, many = np.unique(class_[order], return_index=True, return_counts=True)
                kind = np.repeat(np.arange(len(full)), many)
                rank, made = np.arange(len(order)) - first[kind], many // full
                inside = rank < (made * full)[kind]
                where = worker * _GROUP + bins + (np.cumsum(made) - made)[kind] + rank // full[kind]
                before = np.cumsum(length[order]) - length[order]
                offset = before - before[np.arange(len(order)) - rank % full[kind]]
                bins += int(made.sum())
                yield from placed(rows.take(pa.array(order[inside])), where[inside], offset[inside])
                waiting = rows.take(pa.array(order[~inside])).combine_chunks()
        yield from placed(waiting, None, None)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids
    piece_schema = pa.schema(fields)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = stage(rows.mapInArrow(encode, PIECE + extra + ", worker long, sequence_id long, offset long"), "packed")
    done = [packed.where("sequence_id is not null").select(*names, "sequence_id", "offset")]
    rest = packed.where("sequence_id is null").select(*names, "worker")
    groups = (packed.agg(F.max("worker")).first()[0] or 0) + 1
    level = 1
    while groups > 1:
        groups = -(-groups // FAN)
        rest = rest.withColumn("worker", F.floor(F.col("worker") / FAN).cast("long"))
        # a group has less than a bin of each class from each of FAN workers
        full = F.floor(F.lit(capacity) / F.col("length"))
        by = Window.partitionBy("worker", full)
        counted = stage(
            rest.withColumn("n", F.row_number().over(by.orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "length")) - 1)
            .withColumn("bins", F.floor(F.count("*").over(by) / full)),
            f"rests-{level}",
        )
        bin_ = F.floor(F.col("n") / full)
        key = level * _ROUND + F.col("worker") * _GROUP + full.cast("long") * (1 << 22) + bin_
        before = F.sum("length").over(Window.partitionBy("worker", full, bin_).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
        filled = counted.where(F.col("n") < F.col("bins") * full)
        done.append(filled.select(*names, key.cast("long").alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("long").alias("offset")))
        rest = counted.where(F.col("n") >= F.col("bins") * full).select(*names, "worker")
        level += 1
    done.append(_last_bins(rest.select(*names), capacity, level))
    out_rows = done[0]
    for part in done[1:]:
        out_rows = out_rows.unionByName(part)
    return out_rows.withColumn("length", F.col("length").cast("long"))


def _last_bins(rest: DataFrame, capacity: int, level: int) -> DataFrame:
    """Less than a bin of each class: first fit by falling length, in one task."""
    names = rest.columns

    def fit(frames):
        import pandas as pd

        held = list(frames)
        if not held:
            return
        frame = pd.concat(held).sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        used: list[int] = []
        where, offset = [], []
        first_open = 0
        for length in frame["length"].tolist():
            while first_open < len(used) and used[first_open] == capacity:
                first_open += 1
            i = next((i for i in range(first_open, len(used)) if used[i] + length <= capacity), len(used))
            if i == len(used):
                used.append(0)
            where.append(level * _ROUND + i)
            offset.append(used[i])
            used[i] += length
        yield frame.assign(sequence_id=where, offset=offset)

    return rest.coalesce(1).mapInPandas(fit, rest.schema.add("sequence_id", "long").add("offset", "long"))
