"""Exact k-means in whole numbers, with bounds from pivots by Ptolemy's inequality.

For any four points d(x,c) d(s,t) >= |d(x,s) d(c,t) - d(x,t) d(c,s)|, so two pivots s and t and
the distances to them bound d(x,c) from below.  The distances of every vector to a few fixed pivots are
computed once and stand in the table beside it; those of the centroids are computed once a round.
A vector is held against the centroid with the smallest bound first, then only against those whose
bound does not pass that distance, in whole numbers.  Bounds are rounded down by more than
all errors of the cached distances, so neither they nor the choice of pivots change a result.

Pivots are the first centroids and what the centroids of a bounded sample come to in a few of its
rounds: a pivot next to a centroid gives a sharp bound.  In many dimensions without clusters all
distances are nearly equal, and then most centroids are looked at.

Sums of a round are made in each task (a row for each centroid), then by Spark; only the
centroids come to the driver.

Vectors of another size, null or with null or non-finite components are left out, as are those with
a component beyond +-131,072, whose squared distances no long holds.  Null ids are kept but start no
centroid while there are others; repeated rows count as often as they stand there.  With fewer
vectors than centroids each is a centroid; equal centroids leave all to the smallest number.  An
empty table gives no rows.  Sums of distances that pass a long are null.
"""

from __future__ import annotations

import hashlib
import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import stage

#: Rows of the sample that pivots are taken from at most; its rounds that give pivots; pivots near a centroid and partners of each that bound it.
SAMPLE, PIVOT_ROUNDS, NEAR, PARTNERS = 16_384, (0, 1, 3, 10), 2, 3
#: Largest component in whole numbers.
LARGEST = 1 << 27
#: Shares of a cached distance (a float) and of a bound that errors stay below.
SLACK = 2.0**-22
#: Rows that are compared at once.
BLOCK = 8_192


def whole_numbers(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) for each component; null for vectors that take no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > LARGEST))
    return F.when((F.size(vector) == size) & ~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _matrix(column: pa.Array, size: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size).astype(kind, copy=False)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point, exactly."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _rounds(x: np.ndarray, start: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Centroids of a sample after 0, 1, ... rounds, nearly: for pivots only."""
    x, found = x.astype(float), [start.astype(float)]
    for _ in range(rounds if len(x) else 0):
        c = found[-1].copy()
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for k in range(len(c)):
            if (mine := near == k).any():
                c[k] = np.floor(x[mine].mean(0))
        found.append(c)
    return found


def choose_pivots(sample: np.ndarray, start: np.ndarray) -> np.ndarray:
    found = _rounds(sample, start, max(PIVOT_ROUNDS))
    return np.unique(np.concatenate([found[i] for i in PIVOT_ROUNDS if i < len(found)]), axis=0).astype(np.int64)


class Nearest:
    """The nearest of a few centroids for rows with cached distances to the pivots."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        apart = lambda a, b: np.sqrt(((a[:, None].astype(float) - b[None]) ** 2).sum(2))
        between, to = apart(pivots, pivots), apart(centroids, pivots)
        self.pairs = []  # of each centroid: pivots s and t, d(c,t) / d(s,t), d(c,s) / d(s,t)
        for k in range(len(centroids)):
            pairs = {(min(s, t), max(s, t)) for t in np.argsort(to[k], kind="stable")[:NEAR].tolist() for s in np.argsort(-between[t], kind="stable")[:PARTNERS].tolist() if between[s, t] > 0}
            self.pairs.append([(s, t, to[k, t] / between[s, t], to[k, s] / between[s, t]) for s, t in sorted(pairs)])

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of rows to all centroids."""
        low = np.zeros((len(self.centroids), len(cached)))
        for k, pairs in enumerate(self.pairs):
            for s, t, a, b in pairs:
                left, right = cached[:, s] * a, cached[:, t] * b
                np.maximum(low[k], np.abs(left - right) - SLACK * (left + right), out=low[k])
        return low

    def __call__(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and squared distances of the nearest centroids, and how many distances were computed."""
        low = self.bounds(cached)
        low = low * low * (1 - SLACK)
        near = low.argmin(0)
        best = np.zeros(len(x), np.int64)
        for k in np.unique(near).tolist():
            mine = near == k
            best[mine] = squared(x[mine], self.centroids[k])
        done, tried = len(x), near.copy()
        for k in range(len(self.centroids)):
            rows = np.flatnonzero((low[k] <= best) & (tried != k))
            if len(rows):
                d = squared(x[rows], self.centroids[k])
                nearer = (d < best[rows]) | (d == best[rows]) & (k < near[rows])
                best[rows[nearer]], near[rows[nearer]] = d[nearer], k
                done += len(rows)
        return near, best, done


def _blocks(batches, size: int, pivots: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column("v"), size, np.int64), _matrix(part.column("p"), pivots, np.float64)


def cluster(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, salt: str = "3") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for each vector that takes part.

    The first centroids are the vectors with the smallest SHA-256 of `salt:id`; after a number of
    rounds (nearest centroid, then the floor of the mean; centroids without vectors stay) all are assigned once more."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).alias("id"), whole_numbers(F.col(vector), size, scale).alias("v")).where("v is not null")
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    id_type = rows.schema["id"].dataType.simpleString()
    first = rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    result = f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_)
    centroids = np.array([r.v for r in first], np.int64)
    share = SAMPLE / max(1, rows.count())
    # which rows the limit takes changes no result
    sampled = rows.where(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") <= int(share * 2**32)).select("v").limit(SAMPLE).toArrow()
    pivots = choose_pivots(_matrix(sampled.column("v").combine_chunks(), size, np.int64) if len(sampled) else np.zeros((0, size), np.int64), centroids)
    n_pivots = len(pivots)

    def cache(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("v"), size, np.int64)
                p = np.stack([np.sqrt(squared(x, c).astype(float)) for c in pivots], 1).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_pivots), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists], names=["id", "v", "p"])

    held = stage(rows.mapInArrow(cache, f"id {id_type}, v array<int>, p array<float>"), "vectors")

    def partial(nearest: Nearest):
        def sums(batches):
            n, total = np.zeros(len(nearest.centroids), np.int64), np.zeros((len(nearest.centroids), size), np.int64)
            for _, x, p in _blocks(batches, size, n_pivots):
                near = nearest(x, p)[0]
                for c in np.unique(near).tolist():
                    mine = near == c
                    n[c] += mine.sum()
                    total[c] += x[mine].sum(0)
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        return sums

    for _ in range(rounds):
        parts = held.select("v", "p").mapInArrow(partial(Nearest(centroids, pivots)), "cluster int, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]

    nearest = Nearest(centroids, pivots)

    def assign(batches):
        for part, x, p in _blocks(batches, size, n_pivots):
            near, best, _ = nearest(x, p)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(near, pa.int32()), pa.array(best)], names=["id", "cluster", "distance"])

    assigned = stage(held.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    everything = fits(reduce(operator.add, inertia.values(), 0))
    told = spark.createDataFrame([(c, fits(t), everything, text[c]) for c, t in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each centroid
    return assigned.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
