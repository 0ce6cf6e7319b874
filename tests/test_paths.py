"""Paths against plain search over small graphs, and shapes that plain search would not survive."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import paths

EDGES = "src string, type string, dst string"


def seeds_of(df):
    return df.select(F.col("src").alias("id")).distinct()


def some_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", rng.choice(["CALLS", "IMPORTS"]), f"n{rng.randrange(nodes)}") for _ in range(edges)})


@pytest.mark.parametrize("seed, nodes, edges, depth", [(1, 6, 9, 5), (2, 5, 20, 4), (3, 9, 12, 5), (4, 3, 6, 5)])
def test_dependencies(spark, seed, nodes, edges, depth, monkeypatch):
    monkeypatch.setattr(paths, "FEW", 1)  # sets are chosen wherever there are two
    rows = some_graph(seed, nodes, edges)
    want = set()

    def go(start, node, used, first):
        for e in rows:
            if e[0] == node and e not in used and len(used) < depth:
                want.add((start, e[2], len(used) + 1, first or e[1]))
                go(start, e[2], used | {e}, first or e[1])

    for n in {e[0] for e in rows}:
        go(n, n, frozenset(), None)
    df = spark.createDataFrame(rows, EDGES)
    got = [tuple(r) for r in paths.dependencies(df, seeds_of(df), depth).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dependencies_of_a_complete_graph(spark):
    """Sixty nodes, all joined: 3,540 edges, some 40 million paths of four edges from a single start."""
    nodes = spark.range(60).select(F.col("id").cast("string").alias("n"))
    df = nodes.select(F.col("n").alias("src"), F.lit("CALLS").alias("type")).crossJoin(nodes.select(F.col("n").alias("dst"))).where("src <> dst")
    began = time.time()
    got = paths.dependencies(df, spark.createDataFrame([("0",), ("7",)], "id string"), 4).groupBy("seed", "depth").agg(F.count("*").alias("n")).collect()
    assert {(r.seed, r.depth): r.n for r in got} == {(s, d): 59 if d == 1 else 60 for s in ("0", "7") for d in (1, 2, 3, 4)}
    assert time.time() - began < 120


def test_distances(spark):
    df = spark.createDataFrame([("a", "CALLS", "b"), ("b", "CALLS", "c"), ("a", "CALLS", "c"), ("c", "CALLS", "a"), ("c", "CALLS", "d"), ("d", "CALLS", "d")], EDGES)
    got = {(r.seed, r.node): r.depth for r in paths.distances(df, spark.createDataFrame([("a",), ("d",), ("x",)], "id string"), 9).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("d", "d"): 0, ("x", "x"): 0}


def plain_longest(rows, most):
    out, after = {}, {}
    for a, _, b in rows:
        if a != b:
            after.setdefault(a, set()).add(b)

    def go(node, seen):
        return max((1 + go(n, seen | {n}) for n in after.get(node, ()) if n not in seen), default=0)

    for n in after:
        out[n] = min(most, 1 + go(n, {n}))
    return {n: d for n, d in out.items() if d > 1}


@pytest.mark.parametrize("seed, nodes, edges, most", [(1, 9, 10, 9), (2, 6, 30, 5), (3, 30, 28, 30), (4, 12, 12, 4)])
def test_longest(spark, seed, nodes, edges, most, monkeypatch):
    monkeypatch.setattr(paths, "FEW", 1)
    rows = some_graph(seed, nodes, edges)
    got = {r.seed: r.depth for r in paths.longest(spark.createDataFrame(rows, EDGES), most).collect()}
    assert got == plain_longest(rows, most)


def test_longest_of_odd_shapes(spark):
    """A run into a cycle, a cycle of runs alone, a cycle with exits, a diamond, a loop."""
    pairs = "p0>p1 p1>p2 p2>c0 c0>c1 c1>c2 c2>c0 c1>x0 x0>x1 x1>x2 q0>q1 q1>q0 d0>d1 d0>d2 d1>d3 d2>e1 e1>d3 d3>d4 z>z z>d4 y>p0 y>d0"
    rows = [(*p.split(">")[:1], "IMPORTS", p.split(">")[1]) for p in pairs.split()]
    got = {r.seed: r.depth for r in paths.longest(spark.createDataFrame(rows, EDGES), 100).collect()}
    assert got == plain_longest(rows, 100)
    assert paths.longest(spark.createDataFrame([], EDGES), 5).count() == 0


def test_longest_of_a_long_chain(spark):
    df = spark.range(2000).select(F.format_string("f%05d", "id").alias("src"), F.lit("IMPORTS").alias("type"), F.format_string("f%05d", F.col("id") + 1).alias("dst"))
    found = paths.longest(df, 5000)
    got = {r.seed: r.depth for r in found.collect()}
    assert len(got) == 2000 and all(got[f"f{i:05d}"] == 2001 - i for i in range(2000))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
