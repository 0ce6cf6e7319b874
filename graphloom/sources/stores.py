"""Tables that change: partitions that are replaced as a whole, and a cache of keys in a log.

A store is a folder of Parquet files with a folder for each value of its partition column.
Replacing writes the new partitions by dynamic partition overwrite, so a job that is repeated
leaves what it left the first time; what it reads of the store is written aside before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.session import stage

#: Folders of a cache; parts of a key that name its folder end at the first of these marks.
PARTS, MARK = 64, ":"


class Store:
    """Rows below `path`, partitioned by `partition` (text)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str = "repo_id"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema: StructType = spark.createDataFrame([], schema).schema

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def read(self) -> DataFrame:
        """All rows; none where nothing was written yet."""
        fs, where = self._fs()
        if not fs.exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def counts(self) -> DataFrame:
        return self.read().groupBy(self.partition).agg(F.count("*").alias("n"))

    def replace(self, rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
        """Puts `rows` in place of the partitions that they name, and of those that `also` (partition) names, which may
        have none any more.  Gives partition, deleted, written: the rows that went and that came."""
        rows = stage(rows.select(*self.schema.names), "replacing")
        written = rows.groupBy(self.partition).agg(F.count("*").alias("written"))
        asked = written.select(self.partition, "written")
        if also is not None:
            asked = also.select(self.partition).distinct().join(written, self.partition, "full_outer").select(self.partition, "written")
        found = asked.join(self.counts().withColumnRenamed("n", "deleted"), self.partition, "left")
        told = stage(found.select(self.partition, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("deleted", "written"))), "replaced")
        self._remove(told.where("written = 0 and deleted > 0").select(self.partition))
        # a partition is written by few tasks, a large one by more of them
        rows.hint("rebalance", self.partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.path)
        return told

    def _remove(self, partitions: DataFrame) -> None:
        """Deletes the folders of partitions, under the names that their files stand in."""
        if partitions.isEmpty():
            return
        files = self.spark.read.schema(self.schema).parquet(self.path).select(self.partition, F.col("_metadata.file_path").alias("file"))
        folders = files.join(partitions, self.partition, "left_semi").select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct()
        fs, _ = self._fs()
        for r in folders.toLocalIterator():  # one for each partition that goes
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(r.folder)), True)

    def delete(self, partitions: DataFrame) -> DataFrame:
        """Deletes whole partitions; partition, deleted, written (0) of those that are asked for."""
        return self.replace(self.spark.createDataFrame([], self.schema), partitions)

    def delete_rows(self, keys: DataFrame) -> DataFrame:
        """Deletes the rows that `keys` (the partition and further columns) names; partition and how many went.

        Only partitions that are named are read and written again."""
        on = [c for c in keys.columns]
        named = keys.select(self.partition).distinct()
        held = stage(self.read().join(named, self.partition, "left_semi"), "held")
        gone = held.join(keys.distinct(), on, "left_semi").groupBy(self.partition).agg(F.count("*").alias("deleted"))
        told = stage(gone, "deleted")
        self.replace(held.join(keys.distinct(), on, "left_anti").join(told.select(self.partition), self.partition, "left_semi"), told)
        return told

    def reset_if_size_differs(self, vector: str, size: int) -> bool:
        """Empties the store if the vectors in it have another size; whether it did."""
        if self.read().where(F.size(vector) != size).isEmpty():
            return False
        fs, where = self._fs()
        fs.delete(where, True)
        return True


def reindex(nodes: Store, edges: Store, vectors: Store, repo: DataFrame, new: tuple[DataFrame, DataFrame, DataFrame], size: int) -> DataFrame:
    """Replaces the graph and the vectors of repositories (repo_id) by `new`; repo_id, kind, deleted, written.

    Vectors of another size than before empty the store of vectors first.  A second run changes nothing."""
    vectors.reset_if_size_differs("vector", size)
    told = [store.replace(rows, repo).withColumn("kind", F.lit(kind)) for kind, store, rows in zip(("nodes", "edges", "vectors"), (nodes, edges, vectors), new)]
    return told[0].unionByName(told[1]).unionByName(told[2]).select("repo_id", "kind", "deleted", "written")


CACHE = "key string, value string, stored timestamp, expires timestamp, gone boolean, part int"


def cache_part(key: Column) -> Column:
    """The folder of a key: a hash of what stands before its first mark."""
    return F.pmod(F.xxhash64(F.substring_index(key, MARK, 1)), F.lit(PARTS)).cast("int")


class KeyCache:
    """Values with a time to live, in a log that is partitioned by the leading part of the key.

    Putting and deleting append; the newest row of a key counts.  Reading by a prefix that has a
    whole leading part looks into one folder, and `compact` keeps what counts and lives."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(CACHE).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], CACHE)

    def _append(self, rows: DataFrame) -> None:
        rows.select("key", "value", "stored", "expires", "gone", cache_part(F.col("key")).alias("part")).hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(self.path)

    def put(self, rows: DataFrame, seconds: int, now: Column) -> None:
        """Keeps rows (key, value) for some seconds from `now` on; a row without a key is left out."""
        self._append(rows.where("key is not null").select("key", "value", now.alias("stored"), (now + F.expr(f"INTERVAL '{int(seconds)}' SECOND")).alias("expires"), F.lit(False).alias("gone")))

    def living(self, now: Column, prefix: str = "") -> DataFrame:
        """key, value, stored, expires of what has a prefix and is valid; of rows of one time the larger value counts, a deletion before any."""
        log = self._log().where(F.col("key").startswith(prefix))
        if MARK in prefix:
            log = log.where(F.col("part") == self.spark.range(1).select(cache_part(F.lit(prefix))).first()[0])
        last = log.groupBy("key").agg(F.max(F.struct("stored", "gone", "value", "expires")).alias("r"))
        return last.where(~F.col("r.gone") & (F.col("r.expires") > now)).select("key", "r.value", "r.stored", "r.expires")

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """key, value of keys (key) that live."""
        return self.living(now).join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")

    def delete_prefix(self, prefix: str, now: Column) -> int:
        """Deletes all keys with a prefix; how many lived."""
        met = stage(self.living(now, prefix), "gone")
        self._append(met.select("key", F.lit(None).cast("string").alias("value"), now.alias("stored"), "expires", F.lit(True).alias("gone")))
        return met.count()

    def compact(self, now: Column) -> int:
        """Keeps one row for each key that lives, folder by folder; how many rows went."""
        before = self._log().count()
        kept = stage(self.living(now).withColumn("gone", F.lit(False)), "kept")
        empty = self._log().select("part").distinct().join(kept.select(cache_part(F.col("key")).alias("part")).distinct(), "part", "left_anti")
        held = Store(self.spark, self.path, CACHE, "part")
        held.replace(kept.select("key", "value", "stored", "expires", "gone", cache_part(F.col("key")).alias("part")), empty)
        return before - kept.count()
