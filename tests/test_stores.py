"""Stores of partitions and the cache of keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import report
from graphloom.sources import stores

ROWS = "repo_id string, file string, n int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    held = stores.Store(spark, f"file://{tmp_path}/s", ROWS)
    assert held.read().count() == 0 and rows_of(held.delete(spark.createDataFrame([("x",)], "repo_id string"))) == [("x", 0, 0)]
    held.replace(spark.createDataFrame([("me/shop", "a", 1), ("me/shop", "b", 2), ("you/a=b %", "a", 3), ("third", "c", 4), ("third", "c", 4)], ROWS))
    return held


def test_replace(spark, store):
    new = spark.createDataFrame([("me/shop", "z", 9), ("new", "q", 1)], ROWS)
    asked = spark.createDataFrame([("me/shop",), ("you/a=b %",), ("unknown",)], "repo_id string")
    assert rows_of(store.replace(new, asked)) == [("me/shop", 2, 1), ("new", 0, 1), ("unknown", 0, 0), ("you/a=b %", 1, 0)]
    state = [("me/shop", "z", 9), ("new", "q", 1), ("third", "c", 4), ("third", "c", 4)]
    assert rows_of(store.read()) == state
    assert rows_of(store.replace(new, asked)) == [("me/shop", 1, 1), ("new", 1, 1), ("unknown", 0, 0), ("you/a=b %", 0, 0)] and rows_of(store.read()) == state
    assert rows_of(store.replace(spark.createDataFrame([], ROWS))) == [] and rows_of(store.read()) == state


def test_replace_by_what_is_there(store):
    """A store may be written from itself."""
    store.replace(store.read().withColumn("n", F.col("n") + 1).where("repo_id <> 'third'"))
    assert rows_of(store.read()) == [("me/shop", "a", 2), ("me/shop", "b", 3), ("third", "c", 4), ("third", "c", 4), ("you/a=b %", "a", 4)]


def test_delete_rows(spark, store):
    gone = store.delete_rows(spark.createDataFrame([("me/shop", "a"), ("third", "c"), ("third", "c"), ("unknown", "a")], "repo_id string, file string"))
    assert rows_of(gone) == [("me/shop", 1), ("third", 2)] and rows_of(store.read()) == [("me/shop", "b", 2), ("you/a=b %", "a", 3)]


def test_size_of_vectors(spark, tmp_path):
    held = stores.Store(spark, str(tmp_path / "v"), "repo_id string, vector array<double>")
    assert not held.reset_if_size_differs("vector", 2)
    held.replace(spark.createDataFrame([("a", [1.0, 2.0])], "repo_id string, vector array<double>"))
    assert not held.reset_if_size_differs("vector", 2) and held.read().count() == 1
    assert held.reset_if_size_differs("vector", 3) and held.read().count() == 0


def test_cache(spark, tmp_path):
    cache = stores.KeyCache(spark, str(tmp_path / "c"))
    at = lambda s: F.lit(datetime(2024, 1, 1, 0, 0, s))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert cache.delete_prefix("a", at(0)) == 0 and rows_of(cache.get(keys("a"), at(0))) == []
    put = lambda rows, seconds, now: cache.put(spark.createDataFrame(rows, "key string, value string"), seconds, now)
    put([("repo:1:x", "1"), ("repo:1:y", "2"), ("repo:12:z", "3"), ("job:1", "4"), ("", "5"), (None, "6"), ("short", None)], 10, at(0))
    put([("repo:1:x", "new")], 30, at(2))
    assert rows_of(cache.get(keys("repo:1:x", "short", "no"), at(5))) == [("repo:1:x", "new"), ("short", None)]
    assert cache.delete_prefix("repo:1:", at(6)) == 2
    put([("repo:1:y", "back")], 10, at(7))
    want = [("", "5"), ("job:1", "4"), ("repo:12:z", "3"), ("repo:1:y", "back"), ("short", None)]
    assert rows_of(cache.living(at(8)).select("key", "value")) == want
    assert cache.compact(at(8)) == 5 and rows_of(cache.living(at(8)).select("key", "value")) == want
    assert rows_of(cache.living(at(12)).select("key", "value")) == [("repo:1:y", "back")]
    assert cache.compact(at(50)) == 5 and cache.living(at(50)).count() == 0


def test_prefix_reads_one_folder(spark, tmp_path):
    cache = stores.KeyCache(spark, str(tmp_path / "c"))
    cache.put(spark.range(200).select(F.format_string("k%d:x", "id").alias("key"), F.lit("v").alias("value")), 100, F.lit(datetime(2024, 1, 1)))
    plan = cache.living(F.lit(datetime(2024, 1, 1)), "k7:")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "StartsWith(key,k7:)" in plan
    assert cache.living(F.lit(datetime(2024, 1, 1)), "k7:").count() == 1


def test_owner_of_a_common_end(spark):
    """A path end that very many files have makes no more rows than it is asked for."""
    owners = spark.range(3000).select(F.lit("index").alias("key"), F.format_string("f%d", "id").alias("file")).unionByName(spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b"), ("two", "b"), ("self", "s1")], "key string, file string"))
    wanted = spark.createDataFrame([("s%d" % i, k) for i in range(3) for k in ("index", "one", "two", "self", "none")] + [("a", "two"), ("b", "two"), ("a", "one")], "source string, key string")
    got = rows_of(report.resolved_once(wanted, owners, "file", ["source", "key"], "source"))
    assert got == sorted([(f"s{i}", "one", "a") for i in range(3)] + [("s0", "self", "s1"), ("s2", "self", "s1"), ("a", "two", "b"), ("b", "two", "a")], key=str)
