"""Approximate nearest neighbours over a hierarchical k-means tree.

A tree of k-means clusters is fitted on a bounded sample and every row is put into the leaf
that a walk along nearest centres leads to.  A query visits leaves best bin first: a
priority queue holds the open branches by distance to their centre, the nearest is opened
next, a leaf is searched exactly.  How many leaves a query visits is calibrated on held
queries of the sample, for which all neighbours are known, and widened until the wanted
recall is reached there; a query goes on beyond that while its leaves hold too few rows.

Equal vectors share one entry with their k + 1 smallest ids, all that any query can want of
them, so a vector that a third of all rows have is searched once.  Large leaves, and leaves
that many queries visit, are dealt out in blocks.

Rows take no part (as queries or candidates) if the id or the vector is null, if the vector
is empty or all zero, holds null or non-finite components, or has another size than most
rows of the sample.  Ties go to the smaller id.  Repeated rows count once; an id with several
vectors is a candidate with each of them and asks with the smallest, never finding itself.  An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.session import stage

#: Rows and numbers of the sample at most; queries held for calibration; branches of a node; rows of a leaf and leaves at most.
SAMPLE, SAMPLE_NUMBERS, HELD, BRANCHES, LEAF_ROWS, MOST_LEAVES = 20_000, 4_000_000, 400, 8, 400, 2_000
#: Rows of a leaf, and queries of a leaf, that one task takes.
BLOCK, QUERY_BLOCK = 4_000, 4_000


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)  # ~leaf, or a node's place
    leaves: int = 0
    visits: int = 1
    size: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = _distances(x[rows], self.centres[node]).argmin(1)
            for i, child in enumerate(self.children[node]):
                mine = rows[near == i]
                if child < 0:
                    leaf[mine] = ~child
                elif len(mine):
                    todo.append((child, mine))
        return leaf

    def walk(self, q: np.ndarray):
        """The leaves, best bin first."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield ~node
            else:
                for d, child in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node]):
                    heapq.heappush(queue, (d, child))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, quick but not to the last digit."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _cluster(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def grow(x: np.ndarray, rows: int, k: int, recall: float, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over a sample `x` of `rows` rows, with visits calibrated for `recall` at k."""
    rng = np.random.default_rng(7)
    leaves = int(np.clip(rows / leaf_rows, 1, min(MOST_LEAVES, max(1, len(x) // 12))))
    tree = Tree(size=x.shape[1] if len(x) else 0)

    def split(part: np.ndarray, share: int) -> int:
        centres = _cluster(x[part], min(BRANCHES, share, len(part)), rng) if share > 1 and len(part) > 1 else None
        if centres is None or len(centres) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        node = len(tree.centres)
        tree.centres.append(centres)
        tree.children.append([])
        near = _distances(x[part], centres).argmin(1)
        for i in range(len(centres)):
            mine = part[near == i]
            tree.children[node].append(split(mine, round(share * len(mine) / len(part))))
        return node

    split(np.arange(len(x)), leaves)
    if not tree.centres:
        tree.leaves = 1
        return tree
    # calibration: how early the walk comes to the leaves of the true neighbours
    leaf = tree.assign(x)
    held = rng.choice(len(x), min(HELD, len(x)), replace=False)
    found = np.zeros(tree.leaves + 1)
    for q in held.tolist():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want = Counter(leaf[np.argsort(d, kind="stable")[: min(k, len(x) - 1)]].tolist())
        for i, at in enumerate(tree.walk(x[q])):
            found[i + 1] += want[at]
    reached = np.cumsum(found) / max(1, found.sum())
    tree.visits = max(1, int(np.argmax(reached >= recall)))
    return tree


def takes_part(id_: Column, vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(id_.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def search(vectors: DataFrame, queries: Column, k: int = 10, recall: float = 0.97, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `queries` holds for.

    `vectors`: vec_id, embedding (an array of numbers)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(takes_part(F.col("vec_id"), F.col("v")))
    sizes = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select(F.size("v").alias("n")).limit(1_000).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    size = sizes.n if sizes else 1
    rows = rows.where(F.size("v") == size)
    # k + 1 ids of each distinct vector: Spark keeps no more of a vector before and after the shuffle
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.select("v", "vec_id").withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = stage(distinct, "vectors")
    bound = max(50, min(SAMPLE, SAMPLE_NUMBERS // size))
    sample = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(bound).select("v").toPandas()["v"]
    tree = grow(np.array(sample.tolist(), np.float64).reshape(-1, size), distinct.count(), k, recall, leaf_rows)

    def assign(batches):
        for batch in batches:
            if len(batch):
                yield batch.append_column("leaf", pa.array(tree.assign(_matrix(batch.column("v"), size))))

    candidates = stage(distinct.mapInArrow(assign, "v array<double>, ids array<long>, leaf long"), "leaves")
    # a row a leaf, MOST_LEAVES at most
    held = {r.leaf: (r.n, r.ids) for r in candidates.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}

    def visit(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, leaf = [], []
            for i, q in enumerate(_matrix(batch.column("v"), size)):
                seen = visits = 0
                for at in tree.walk(q):
                    if visits >= tree.visits and seen > k:
                        break
                    visits += 1
                    if at in held:
                        seen += held[at][1]
                        ids.append(i)
                        leaf.append(at)
            for a in range(0, len(ids), 10_000):
                part = batch.take(pa.array(ids[a : a + 10_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[a : a + 10_000], pa.int64())], names=["query_id", "v", "leaf"])

    asked = stage(rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").groupBy("query_id").agg(F.min("v").alias("v")).mapInArrow(visit, "query_id long, v array<double>, leaf long"), "visits")
    blocks = asked.groupBy("leaf").agg(F.count("*").alias("queries")).join(candidates.groupBy("leaf").agg(F.count("*").alias("rows")), "leaf")
    blocks = F.broadcast(blocks.select("leaf", F.ceil(F.col("rows") / BLOCK).alias("b"), F.ceil(F.col("queries") / QUERY_BLOCK).alias("c")))
    # every block of a leaf's rows meets every block of its queries once
    left = candidates.join(blocks, "leaf").select("leaf", "v", "ids", F.pmod(F.xxhash64(F.col("ids")[0]), "b").alias("block"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("part"))
    right = asked.join(blocks, "leaf").select("leaf", "v", "query_id", F.pmod(F.xxhash64("query_id"), "c").alias("part"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"))

    def nearest(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x = np.stack(rows["v"].to_numpy()).astype(np.float64)
            ids = rows["ids"].to_list()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at : at + 256]
                q = np.stack(part["v"].to_numpy()).astype(np.float64)
                rough = _distances(q, x)
                some = min(k + 1, len(x))
                edge = np.partition(rough, some - 1, axis=1)[:, some - 1] if some < len(x) else rough.max(1)
                slack = 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max())
                for i, query_id in enumerate(part["query_id"].tolist()):
                    close = np.flatnonzero(rough[i] <= edge[i] + slack[i])
                    exact = np.sqrt(((x[close] - q[i]) ** 2).sum(1))
                    found = [(d, v) for d, c in zip(exact.tolist(), close.tolist()) for v in ids[c] if v != query_id]
                    out += [(query_id, int(v), d) for d, v in heapq.nsmallest(k, found)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ("leaf", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
