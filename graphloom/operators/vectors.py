"""Vectors: exact cosine search, flat metadata, upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import top_per_key


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(vector: Column) -> Column:
    """The vector with length one; null without a length."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def nearest_to(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows (vec_id, embedding) most like one vector, with score (cosine, 0 at least)."""
    length = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    q = F.array(*(F.lit(float(x) / length) for x in query))
    e = F.col("embedding")
    return vectors.withColumn("score", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(e, q), F.sqrt(dot(e, e))), F.lit(0.0)))).orderBy(F.desc("score"), "vec_id").limit(max(1, k))


def nearest_per_query(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4_096) -> DataFrame:
    """query_id, vec_id, score: exact search of a stated set of queries against all other rows.

    Rows and queries are dealt into blocks of about `block`; each block of rows meets each block of
    queries in one task, which keeps the k best of each query.  A vector that is null, empty or zero scores 0."""
    many = max(1, -(-vectors.count() // block))
    asked = max(1, -(-queries.count() // block))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = vectors.select("vec_id", unit(F.col("embedding")).alias("v"), deal(many).alias("b"), parts(asked).alias("c"))
    right = queries.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("v"), deal(asked).alias("c"), parts(many).alias("b"))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def best(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        size = max(max((len(v) for v in (*rows["v"], *asks["v"]) if v is not None), default=1), 1)
        table = lambda c: np.stack([np.zeros(size) if v is None or len(v) != size else np.asarray(v, np.float64) for v in c])
        x, q, ids = table(rows["v"]), table(asks["v"]), rows["vec_id"].to_numpy()
        out = []
        for at in range(0, len(q), 256):
            # equal vectors have equal scores, whatever the order of sums
            score = np.maximum(0.0, np.round(q[at : at + 256] @ x.T, 12))
            for s, query in zip(score, asks["query_id"].to_numpy()[at : at + 256]):
                s = np.where(ids == query, -1.0, s)
                edge = np.partition(s, len(s) - min(k, len(s)))[len(s) - min(k, len(s))]
                near = np.flatnonzero((s >= edge) & (s >= 0))
                near = near[np.lexsort((ids[near], -s[near]))][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near], "score": s[near]}))
        return pd.concat(out)

    met = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(best, f"query_id {kind}, vec_id {kind}, score double")
    return top_per_key(met, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def flat_metadata(rows: DataFrame, fields: list[str], tags: str) -> DataFrame:
    """Nulls of scalar fields become empty, the array of tags a text."""
    for name in fields:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    return rows.withColumn(tags, F.array_join(F.coalesce(F.col(tags), F.array().cast("array<string>")), ","))


def hashing_embedder(texts: DataFrame, text: str, to: str, size: int = 64) -> DataFrame:
    """A deterministic vector for each text without a model: signed counts of hashed words, of length one."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9_]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("i"), F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    rows = texts.withColumn("_p", places)
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter("_p", lambda p: p["i"] == i), F.lit(0.0), lambda a, p: a + p["s"]))
    rows = rows.withColumn("_v", raw)
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn(to, F.transform("_v", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))).drop("_p", "_v")
