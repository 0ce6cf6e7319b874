"""Paths in a table of edges (src, type, dst), level by level.

A path may meet a node again but no edge (edges are unique by src, type and dst).  What is
asked for decides what a level carries: distances carry a node once; dependencies carry a few
sets of used edges for each node, enough to tell every longer path (see `representatives`), so a level is
linear in the edges; only chains, which are asked for one by one, carry whole paths.  Levels are
joins on the node at the path's end, cut by written tables; a node with very many edges is split by
adaptive skew joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import stage

#: Sets of used edges that are kept for a key without a choice.
FEW = 8
#: Nodes of a path inside of cycles that `longest` looks for at most.
WITHIN = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numbered(edges: DataFrame) -> DataFrame:
    """The edges with a 64-bit hash to know them by."""
    return stage(edges.select("src", "type", "dst", F.xxhash64("src", "type", "dst").alias("edge")), "edges")


def trails(edges: DataFrame, seeds: DataFrame, max_depth: int, least: int = 1) -> DataFrame:
    """seed, node, depth, first_type, nodes (array from seed on): every path of 1 to max_depth edges."""
    edges = _numbered(edges)
    level = (
        seeds.select(F.col("id").alias("seed"))
        .join(edges, F.col("seed") == F.col("src"))
        .select("seed", F.col("dst").alias("node"), F.lit(1).alias("depth"), F.col("type").alias("first_type"), F.array("src", "dst").alias("nodes"), F.array("edge").alias("used"))
    )
    levels = [level]
    for depth in range(2, max_depth + 1):
        level = (
            level.join(edges, F.col("node") == F.col("src"))
            .where(~F.array_contains("used", F.col("edge")))
            .select("seed", F.col("dst").alias("node"), F.lit(depth).alias("depth"), "first_type", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("used", F.col("edge")).alias("used"))
        )
        levels.append(level)
    return _union(levels[least - 1 :]).drop("used")


def representatives(rows: DataFrame, key: list[str], further: int) -> DataFrame:
    """Of the sets `used` of each key, few that stand for all: whatever at most `further` things some set of the key
    has none of, a kept set of the key has none of either.

    One set A is kept, and for each of its members in turn what represents the sets without it, one thing less being
    open: what meets A holds one of A's members, and then only sets without this member matter."""
    if further <= 0:
        return rows.groupBy(*key).agg(F.min("used").alias("used"))
    rows = stage(rows.distinct(), "sets")
    many = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > FEW).drop("n")
    if many.isEmpty():
        return rows
    many = stage(many, "many")
    left = rows.join(many, key, "left_semi").withColumn("without", F.array().cast(rows.schema["used"].dataType))
    found = [rows.join(many, key, "left_anti")]
    for step in range(further + 1):
        one = stage(left.groupBy(*key, "without").agg(F.min("used").alias("one")), "chosen")
        found.append(one.select(*key, F.col("one").alias("used")))
        if step < further:
            met = left.join(one, [*key, "without"]).withColumn("x", F.explode("one")).where(~F.array_contains("used", F.col("x")))
            left = stage(met.select(*key, "used", F.array_append("without", F.col("x")).alias("without")), "open-sets")
    return _union(found).distinct()


def dependencies(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Distinct seed, node, depth, first_type of all paths within max_depth (1 to 5), without the paths themselves."""
    most = min(max(max_depth, 1), 5)
    edges = _numbered(edges)
    key = ["seed", "node", "first_type"]
    level = seeds.select(F.col("id").alias("seed")).distinct().join(edges, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"), F.col("type").alias("first_type"), F.array("edge").alias("used"))
    rows = [level.select(*key, F.lit(1).alias("depth")).distinct()]
    for depth in range(2, most + 1):
        grown = level.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("used", F.col("edge")))
        used = F.array_sort(F.array_append("used", F.col("edge"))).alias("used")
        grown = grown.select("seed", F.col("dst").alias("node"), "first_type", *([used] if depth < most else []))
        level = representatives(grown, key, most - depth) if depth < most else grown
        rows.append(level.select(*key, F.lit(depth).alias("depth")).distinct())
    return _union(rows).select("seed", "node", "depth", "first_type")


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """seed, node, depth: the nodes within max_depth edges of each seed, and the seed itself (0), by their least number of edges.

    A level holds only nodes that no level before has; it ends with the first that is empty."""
    edges = stage(edges.select("src", "dst").distinct(), "steps")
    front = known = stage(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "front")
    for depth in range(1, max_depth + 1):
        met = front.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = stage(met.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def call_chains(edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """seed, depth, nodes of every chain of calls within max_depth (1 to 12)."""
    return trails(edges.where("type = 'CALLS'"), seeds, min(max(max_depth, 1), 12)).select("seed", "depth", "nodes")


def _runs(edges: DataFrame) -> DataFrame:
    """node, to, steps: nodes of one outgoing edge, with the end of the run of such nodes that they lead along.

    Each round doubles the run that a node knows, so rounds grow with the logarithm of the longest; runs that come to a cycle are left out."""
    one = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1")
    jumps = stage(one.select(F.col("src").alias("node"), "to", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")), "jumps")
    left = jumps.count()
    while left:
        ahead = jumps.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = jumps.where("not done").join(ahead, "to", "left")
        moved = moved.select("node", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("ends", F.lit(True)).alias("done"))
        jumps = stage(jumps.where("done").unionByName(moved), "jumps")
        before, left = left, jumps.where("not done").count()
        if left == before:  # outside of cycles the nearest run to an end always comes to it
            break
    return jumps.where("done").drop("done")


def _best(steps: DataFrame, best: DataFrame, value: Column) -> DataFrame:
    """src and the largest `value` (of best, the successor's, and what steps hold) over the edges of `steps` whose ends are in `best` (node, best)."""
    return steps.join(best.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.max(value).alias("value"), F.count("*").alias("met"))


def longest(edges: DataFrame, max_depth: int, within: int = WITHIN) -> DataFrame:
    """seed, depth: nodes of the longest path of at most max_depth nodes, none of them twice, from each start.

    Nodes that lead to no cycle are settled from the ends of the graph on, a level at a time, runs of nodes of one
    outgoing edge at once.  What is left and behind a cycle, too, is searched with sets of nodes (`representatives`);
    there paths are followed for at most `within` nodes before they leave for good.  What only leads to cycles is
    settled last.  All levels are tables, so plans stay small."""
    edges = stage(edges.select("src", "dst").where("src <> dst").distinct(), "imports")
    runs = stage(_runs(edges), "runs")
    sources = edges.select(F.col("src").alias("node")).distinct()
    settled = [stage(edges.select(F.col("dst").alias("node")).distinct().join(sources, "node", "left_anti").withColumn("best", F.lit(1).cast("long")), "settled")]
    # what is not a run itself, with runs for single steps
    to = runs.select(F.col("node").alias("dst"), "to", "steps")
    short = edges.join(runs.select(F.col("node").alias("src")), "src", "left_anti").join(to, "dst", "left")
    short = stage(short.groupBy("src", F.coalesce("to", "dst").alias("dst")).agg(F.max(F.coalesce("steps", F.lit(0)) + 1).alias("w")), "short")
    state = short.groupBy("src").agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("best"))
    while True:
        met = _best(short, settled[-1], F.col("best") + F.col("w"))
        state = state.join(met, "src", "left").select("src", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("best", F.coalesce("value", F.lit(0))).alias("best"))
        state = stage(state, "open")
        new = state.where("open = 0").select(F.col("src").alias("node"), "best")
        if new.isEmpty():
            break
        settled.append(new)
        state = state.where("open > 0")
    best = _union(settled)
    along = runs.join(best.withColumnRenamed("node", "to"), "to").select("node", (F.col("best") + F.col("steps")).alias("best"))
    best = stage(best.unionByName(along), "best")
    # nodes that lead to a cycle, and the edges between them
    rest = stage(edges.join(best.select(F.col("node").alias("src")), "src", "left_anti"), "rest")
    exits = rest.join(best.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("best").alias("exit"))
    exits = stage(exits, "exits")
    inner = stage(rest.join(best.select(F.col("node").alias("dst")), "dst", "left_anti"), "inner")
    layers = []
    core = inner
    while not core.isEmpty():
        ahead = stage(core.select(F.col("src").alias("node")).distinct().join(core.select(F.col("dst").alias("node")), "node", "left_anti"), "ahead")
        if ahead.isEmpty():
            break
        layers.append(ahead)
        core = stage(core.join(ahead.withColumnRenamed("node", "src"), "src", "left_anti"), "core")
    if layers or not core.isEmpty():
        cyclic = _through_cycles(core, exits, min(within, max_depth))
        solved = stage(best.unionByName(cyclic), "best")
        for layer in reversed(layers):
            met = _best(rest.join(layer.withColumnRenamed("node", "src"), "src", "left_semi"), solved, F.col("best") + 1)
            solved = stage(solved.unionByName(met.select(F.col("src").alias("node"), F.col("value").alias("best"))), "best")
        best = solved
    return best.where("best > 1").select(F.col("node").alias("seed"), F.least("best", F.lit(max_depth)).cast("int").alias("depth"))


def _through_cycles(core: DataFrame, exits: DataFrame, most: int) -> DataFrame:
    """node, best: nodes of the longest path from each node of `core`, of at most `most` nodes there and what follows behind an exit."""
    nodes = core.select(F.col("src").alias("node")).unionByName(core.select(F.col("dst").alias("node"))).distinct()
    level = nodes.select(F.col("node").alias("seed"), "node", F.array("node").alias("used"))
    found = []
    for n in range(1, most + 1):
        ends = level.select("seed", "node").distinct().join(exits, "node", "left")
        found.append(ends.groupBy("seed").agg((F.max(F.coalesce("exit", F.lit(0))) + n).alias("best")))
        if n < most:
            grown = level.join(core, F.col("node") == F.col("src")).where(~F.array_contains("used", F.col("dst")))
            grown = grown.select("seed", F.col("dst").alias("node"), F.array_sort(F.array_append("used", F.col("dst"))).alias("used"))
            level = stage(representatives(grown, ["seed", "node"], most - n - 1), "inside")
            if level.isEmpty():
                break
    return _union(found).groupBy(F.col("seed").alias("node")).agg(F.max("best").alias("best"))
