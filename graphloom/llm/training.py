"""What the trained operators share: folds, bounded samples and a logistic regression."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.units import blocks
from graphloom.session import stage


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, rows: int) -> DataFrame:
    """At most `rows` labelled documents (at, doc_id, text, y), those with the smallest hashed ids, as a table;
    `at` orders them, the same way in every run.

    Of texts that share the smallest hash of their five-word shingles (copies, nearly all near
    copies) the one with the smallest hashed id stays, so that a copied text teaches once.  The
    bound is on rows of `labels`, before they meet the texts; a document with several labels has
    the largest.  Rows without an id or a label are left out; without any the table is empty."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isNotNull())
        .where(where)
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most `rows` pairs of numbers
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")

    def sketch(batches):
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                keys.append(min(crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))))
            yield batch.append_column("key", pa.array(keys, pa.int64()))

    keyed = found.mapInArrow(sketch, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string, y int, key long")
    row = F.struct(F.xxhash64("doc_id").alias("at"), "doc_id", F.xxhash64("text").alias("th"), "text")
    return stage(keyed.groupBy("key", "y").agg(F.min(row).alias("r")).select("r.at", "r.doc_id", "r.text", "y"), "labelled")


def keep(docs: DataFrame, model, accepts) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score `accepts` (an array of scores in, of booleans out).

    Null texts are scored as empty ones; repeated rows and null ids are judged like others; an
    empty table gives no rows."""

    def put(batches):
        for batch in batches:
            for block in blocks(batch):
                yield block.filter(pa.array(accepts(model.score(block.column("text")))))

    return docs.mapInArrow(put, docs.schema)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class SparseRows:
    """Binary rows given by their columns."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        # rows of any length have the length one
        size = np.maximum(np.bincount(self.row, minlength=self.n), 1)
        self.value = np.ones(len(self.row)) if width < 1 << 14 else 1 / np.sqrt(size[self.row])

    def dot(self, w):
        return np.bincount(self.row, w[self.column] * self.value, minlength=self.n)

    def back(self, r):
        return np.bincount(self.column, r[self.row] * self.value, minlength=self.width)


def logistic(x: SparseRows, target, weight, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by Nesterov's accelerated gradient."""
    w, b = np.zeros(x.width), 0.0
    if not x.n:
        return w, b
    v, vb, last = w.copy(), b, 1.0
    total = weight.sum()
    u = np.ones(x.width + 1)
    for _ in range(15):  # the largest curvature, by power iteration
        r = weight * (x.dot(u[:-1]) + u[-1]) / total
        u = np.append(x.back(r), r.sum())
        most = np.linalg.norm(u)
        u /= most
    pace = 1 / (0.25 * 1.2 * most + l2 / total)
    for _ in range(steps):
        r = weight * (sigmoid(x.dot(v) + vb) - target) / total
        w2, b2 = v - pace * (x.back(r) + l2 / total * v), vb - pace * r.sum()
        now = (1 + np.sqrt(1 + 4 * last**2)) / 2
        v, vb = w2 + (last - 1) / now * (w2 - w), b2 + (last - 1) / now * (b2 - b)
        w, b, last = w2, b2, now
    return w, b
