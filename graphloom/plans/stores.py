"""Tables that change from one run to the next: repositories indexed again, a cache by prefix, batches that fail, job snapshots."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, vectors
from graphloom.plans.registry import Registry
from graphloom.session import shared_dir, table
from graphloom.sources import stores
from graphloom.streaming import indexing, jobs

registry = query = Registry()


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _indexed(orders: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and vectors of orders, whose months are the repositories."""
    repo = F.date_format("o_orderdate", "yyyy/MM").alias("repo_id")
    order, customer = graph.node_id("Order", F.col("o_orderkey")), graph.node_id("Customer", F.col("o_custkey"))
    nodes = orders.select(repo, order.alias("id"), F.lit("Order").alias("label")).unionByName(orders.select(repo, customer.alias("id"), F.lit("Customer").alias("label"))).distinct()
    edges = orders.select(repo, customer.alias("src"), F.lit("CALLS").alias("type"), order.alias("dst"))
    text = orders.select(repo, F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("t"))
    return nodes, edges, vectors.hashing_embedder(text, "t", "vector", size).select("repo_id", "chunk_id", "vector")


def _stores(spark):
    at = _folder(spark, "index")
    shape = {"nodes": "id string, label string", "edges": "src string, type string, dst string", "vectors": "chunk_id string, vector array<double>"}
    return [stores.Store(spark, f"{at}/{k}", f"repo_id string, {v}") for k, v in shape.items()]


_MONTH = "strftime(o_orderdate, '%Y/%m')"
_KINDS = """SELECT {m} AS repo_id, 'nodes' AS kind, count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) AS n FROM {o} GROUP BY 1
    UNION ALL SELECT {m}, 'edges', count(*) FROM {o} GROUP BY 1 UNION ALL SELECT {m}, 'vectors', count(*) FROM {o} GROUP BY 1"""


@query(
    "reindex_repositories",
    f"""
    WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate < DATE '1996-07-01' AND month(o_orderdate) <> 2),
    x AS ({_KINDS.format(m=_MONTH, o="a")}), y AS ({_KINDS.format(m=_MONTH, o="b")}), asked AS (SELECT DISTINCT {_MONTH} AS repo_id FROM orders WHERE o_orderdate < DATE '1996-07-01'), k(kind) AS (VALUES ('nodes'), ('edges'), ('vectors'))
    SELECT asked.repo_id, k.kind, coalesce(x.n, 0) AS deleted, coalesce(y.n, 0) AS written, coalesce(y.n, 0) AS again, coalesce(y.n, 0) AS now FROM asked CROSS JOIN k LEFT JOIN x USING (repo_id, kind) LEFT JOIN y USING (repo_id, kind)
    UNION ALL SELECT x.repo_id, x.kind, 0, 0, 0, x.n FROM x WHERE x.repo_id NOT IN (SELECT repo_id FROM asked)
    """,
)
def reindex_repositories(spark, sf_dir):
    """Months of orders are repositories; those before July 1996 are indexed again from another state of the orders, in which Februaries
    are empty, and once more: what went, what came, what went the second time, and what is there in the end."""
    orders = table(spark, sf_dir, "orders")
    nodes, edges, held = _stores(spark)
    for store, rows in zip((nodes, edges, held), _indexed(orders.where("o_orderkey % 3 <> 0"), 16)):
        store.replace(rows)
    early = orders.where("o_orderdate < '1996-07-01'")
    asked = early.select(F.date_format("o_orderdate", "yyyy/MM").alias("repo_id")).distinct()
    new = _indexed(early.where("o_orderkey % 5 <> 0 and month(o_orderdate) <> 2"), 16)
    first = stores.reindex(nodes, edges, held, asked, new, 16)
    again = stores.reindex(nodes, edges, held, asked, new, 16).select("repo_id", "kind", F.col("deleted").alias("again"))
    now = reduce(DataFrame.unionByName, (s.counts().withColumn("kind", F.lit(k)) for k, s in (("nodes", nodes), ("edges", edges), ("vectors", held))))
    met = first.join(again, ["repo_id", "kind"], "full_outer").join(now.withColumnRenamed("n", "now"), ["repo_id", "kind"], "full_outer")
    return met.select("repo_id", "kind", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("deleted", "written", "again", "now")))


@query("reset_vectors", "SELECT min(o_orderkey) AS first, count(*) AS n, 24 AS size FROM orders WHERE o_orderkey % 7 = 0")
def reset_vectors(spark, sf_dir):
    """Vectors of another size: the store is emptied before they come."""
    orders = table(spark, sf_dir, "orders")
    nodes, edges, held = _stores(spark)
    none = spark.createDataFrame([], "repo_id string")
    stores.reindex(nodes, edges, held, none, _indexed(orders, 16), 16)
    stores.reindex(nodes, edges, held, none, _indexed(orders.where("o_orderkey % 7 = 0"), 24), 24)
    return held.read().agg(F.min(F.col("chunk_id").cast("long")).alias("first"), F.count("*").alias("n"), F.min(F.size("vector")).alias("size"))


@query("delete_files", f"SELECT {_MONTH} AS repo_id, count(*) AS n FROM orders WHERE NOT (month(o_orderdate) = 3 AND o_orderpriority LIKE '1%') GROUP BY 1")
def delete_files(spark, sf_dir):
    """Vectors of urgent orders of each March go, as the files of a repository do; the others stay."""
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy/MM").alias("repo_id"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("chunk_id"))
    held = stores.Store(spark, _folder(spark, "files"), "repo_id string, file string, chunk_id long")
    held.replace(rows)
    held.delete_rows(rows.where("repo_id like '%/03' and file like '1%'").select("repo_id", "file"))
    return held.counts()


@query(
    "cache_by_prefix",
    """
    WITH k AS (SELECT c_custkey, c_mktsegment || ':' || c_nationkey || ':' || c_custkey AS key, c_name AS value, CASE WHEN c_custkey % 4 = 0 THEN 60 ELSE 6000 END AS seconds FROM customer)
    SELECT key, CASE WHEN c_custkey % 6 = 1 THEN upper(value) || '!' ELSE value END AS value FROM k WHERE key NOT LIKE 'BUILDING:1%' AND (seconds > 600 OR c_custkey % 6 = 1)
    """,
)
def cache_by_prefix(spark, sf_dir):
    """Customers under keys of segment and nation, every fourth for a minute; some are put anew, one prefix is deleted, and ten minutes pass."""
    key = F.concat_ws(":", "c_mktsegment", "c_nationkey", "c_custkey").alias("key")
    rows = table(spark, sf_dir, "customer").select("c_custkey", key, F.col("c_name").alias("value"))
    cache = stores.KeyCache(spark, _folder(spark, "cache"))
    at = lambda minutes: F.lit("2024-01-01").cast("timestamp") + F.expr(f"INTERVAL '{minutes}' MINUTE")
    cache.put(rows.where("c_custkey % 4 = 0"), 60, at(0))
    cache.put(rows.where("c_custkey % 4 <> 0"), 6000, at(0))
    cache.put(rows.where("c_custkey % 6 = 1").withColumn("value", F.concat(F.upper("value"), F.lit("!"))), 6000, at(1))
    cache.delete_prefix("BUILDING:1", at(2))
    cache.compact(at(10))
    return cache.living(at(10)).select("key", "value")


def _stream(spark, sf_dir, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # a pattern: a streamed path is a folder or a pattern, and the table may be one file
    return jobs.read(spark, path + "*", spark.read.parquet(path).schema)


def _embedder(weak: bool):
    """Counts of letters; while it is `weak` it does not take a text whose length is a multiple of 211."""

    def embed(texts: list[str]) -> list[list[float]]:
        if weak and any(len(t) % 211 == 0 for t in texts):
            raise ValueError("no answer")
        return [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]

    return embed


@query(
    "index_in_batches",
    """
    WITH d AS (SELECT doc_id // 64 AS batch, count(*) AS n, bool_or(length(coalesce(text, '')) % 211 = 0) AS fails, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1)
    SELECT CAST(batch AS BIGINT) AS batch, n AS first_chunks, CASE WHEN fails THEN n ELSE 0 END AS first_failed, CASE WHEN fails THEN n ELSE 0 END AS second_chunks, CAST(0 AS BIGINT) AS second_failed, n AS indexed, CAST(chars AS DOUBLE) AS chars FROM d
    """,
)
def index_in_batches(spark, sf_dir):
    """Documents in batches of 64: some batches fail at first, and a second run does only those."""
    folder = _folder(spark, "batches")
    chunks = _stream(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.floor(F.col("doc_id") / 64).alias("batch"), F.col("text").alias("document"))
    for run, weak in ((1, True), (2, False)):
        indexing.index(chunks, _embedder(weak), folder, f"{folder}/checkpoint-{run}", run).awaitTermination()
    told = indexing.manifest(spark, folder).withColumn("run", F.substring("part", 1, 6).cast("int"))
    sums = [F.coalesce(F.sum(F.when(F.col("run") == i, F.col(c))), F.lit(0)).cast("long").alias(f"{name}_{c}") for i, name in ((1, "first"), (2, "second")) for c in ("chunks", "failed")]
    done = indexing.vectors(spark, folder).groupBy("batch").agg(F.count("*").alias("indexed"), F.sum(F.col("vector")[0]).alias("chars"))
    return told.groupBy("batch").agg(*sums).join(done, "batch", "left")


_JOB_STAGE = "CASE WHEN event_id % 11 = 0 THEN 'completed' WHEN event_type = 'view' THEN 'cloning' WHEN event_type = 'click' THEN 'parsing' WHEN event_type = 'purchase' THEN 'embedding' END"


@query(
    "job_snapshots",
    f"""
    WITH u AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, ts, {_JOB_STAGE} AS stage, CASE WHEN event_id % 4 = 0 THEN event_id % 120 END AS given, CASE WHEN event_id % 3 = 0 THEN 'm' || event_id END AS message FROM events),
    k AS (SELECT u.*, coalesce(given, CASE stage WHEN 'completed' THEN 100 WHEN 'cloning' THEN 20 WHEN 'parsing' THEN 50 WHEN 'embedding' THEN 90 END) AS p FROM u LEFT JOIN (SELECT job_id, min(event_id) AS e FROM u WHERE stage = 'completed' GROUP BY 1) f USING (job_id) WHERE e IS NULL OR event_id <= e)
    SELECT job_id, arg_max(stage, event_id) AS stage, CAST(least(100, coalesce(arg_max(p, event_id), 0)) AS INTEGER) AS progress, arg_max(message, event_id) AS message, count(*) AS updates, max(ts) AS updated_at FROM k GROUP BY job_id
    """,
)
def job_snapshots(spark, sf_dir):
    """The fold of all updates, in two runs over two halves, from the snapshots of the first one on."""
    folder = _folder(spark, "jobs")
    half = table(spark, sf_dir, "events").agg((F.max("event_id") / 2).cast("long")).first()[0] or 0
    rows = _stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("ord"), F.expr(_JOB_STAGE).alias("stage"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 120).cast("int").alias("progress"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("m"), F.col("event_id").cast("string"))).alias("message"), F.col("ts").cast("timestamp").alias("at"),
    )
    for run, part in ((1, rows.where(F.col("ord") <= half)), (2, rows.where(F.col("ord") > half))):
        jobs.save_snapshots(part, f"{folder}/snapshots", f"{folder}/checkpoint-{run}", run).awaitTermination()
    return jobs.load_snapshots(spark, f"{folder}/snapshots").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
