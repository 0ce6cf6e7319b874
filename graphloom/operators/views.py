"""Views of a graph that are drawn: tiers of a system, the best connected part of its dependencies, classes, and a report.

A view is two tables: nodes (id, label, kind, group, description, file, x, y) and edges (id, source, target, label, kind).
Every part has a limit, which is part of the view; of parts with limits Spark keeps the first rows of each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions import text as T
from graphloom.operators.diagrams import induced, top_by_degree
from graphloom.operators.ranking import top_per_key

# Tiers with label, kind and x; which tier calls which.
TIERS = [
    ("frontend", "Frontend", "frontend", 0.08), ("presentation", "API Layer", "backend", 0.32), ("business", "Services", "service", 0.52), ("data", "Database", "database", 0.72), ("infrastructure", "Infrastructure", "util", 0.92),
]
FLOW = [("frontend", "presentation"), ("presentation", "business"), ("business", "data")]
FRONTEND_SUFFIXES = [".tsx", ".jsx", ".vue"]
#: Endpoints, tables and calls between tiers of a system at most; nodes of a dependency view at most.
ENDPOINTS, TABLES, CROSSING, DRAWN = 6, 5, 12, 48
# The canvas; columns of tiers, order of groups in a dependency view.
WIDTH, HEIGHT = 1200, 720
GROUPS = ["core", "api", "service", "util", "external"]

NODE = ["id", "label", "kind", "group", "description", "file", "x", "y"]


def _node(id_, label, kind, group, description, file, x, y) -> list[Column]:
    as_column = lambda v: F.lit(v) if isinstance(v, (str, int, float)) else v
    return [as_column(v).cast("double" if n in ("x", "y") else "string").alias(n) for n, v in zip(NODE, (id_, label, kind, group, description, file, x, y))]


def _first(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows with their place `i`, from 0: a small table, so one window may number it."""
    return df.orderBy(*order).limit(most).withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1)


def system_view(layers: DataFrame, crossing: DataFrame, endpoints: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiers of layers (layer, files, samples, joined by commas), six endpoints (method, route, handler, file), five tables
    (name, file), and edges: endpoints to their tier, services to tables, tiers that call each other by design, and
    the first calls between tiers (source, target, source_layer, target_layer), one for each pair of tiers."""
    spark = layers.sparkSession
    known = spark.createDataFrame(TIERS, "tier string, label string, kind string, x double")
    files = F.split("samples", ",")
    front = F.exists(files, lambda f: F.contains(F.lower(f), F.lit("frontend")) | F.concat(F.lit("."), F.substring_index(f, ".", -1)).isin(FRONTEND_SUFFIXES))
    names = F.array_join(F.transform(F.slice(F.filter(files, lambda f: f != ""), 1, 3), T.basename), ", ")
    told = F.concat(F.col("files").cast("string"), F.lit(" files · "), F.when(names == "", "no samples").otherwise(names))
    tiers = layers.where("layer <> 'frontend'").select(F.col("layer").alias("tier"), told.alias("description"))
    tiers = tiers.unionByName(layers.where(front).limit(1).select(F.lit("frontend").alias("tier"), F.lit("what users see").alias("description"))).join(F.broadcast(known), "tier")
    tier_id = lambda t: F.concat(F.lit("tier_"), t)
    ends, held = _first(endpoints, ["route", "method"], ENDPOINTS), _first(tables, ["name", "file"], TABLES)
    number = F.col("i").cast("string")
    nodes = tiers.select(*_node(tier_id(F.col("tier")), F.col("label"), F.col("kind"), F.col("tier"), F.col("description"), "", F.col("x"), 0.5))
    nodes = nodes.unionByName(ends.select(*_node(F.concat(F.lit("ep_"), number), F.concat_ws(" ", F.upper("method"), "route"), "backend", "presentation", F.coalesce("handler", F.lit("")), F.coalesce("file", F.lit("")), 0.28, F.round(0.12 + F.col("i") * 0.13, 6))))
    nodes = nodes.unionByName(held.select(*_node(F.concat(F.lit("db_"), number), F.col("name"), "database", "data", "", F.coalesce("file", F.lit("")), 0.88, F.round(0.2 + F.col("i") * 0.12, 6))))

    # a row for each tier that is there
    there = tiers.select("tier")
    at = lambda name: there.where(F.col("tier") == name)
    edge = lambda df, id_, source, target, label, kind: df.select(id_.alias("id"), source.alias("source"), target.alias("target"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), F.lit(kind).alias("kind"))
    flow = spark.createDataFrame(FLOW, "a string, b string").join(there.withColumnRenamed("tier", "a"), "a", "left_semi").join(there.withColumnRenamed("tier", "b"), "b", "left_semi")
    server = F.when(F.col("business"), tier_id(F.lit("business"))).otherwise(tier_id(F.lit("data")))
    serves = at("data").select(F.lit(1).alias("k")).join(there.agg(F.coalesce(F.bool_or(F.col("tier") == "business"), F.lit(False)).alias("business"), F.lit(1).alias("k")), "k")
    one = lambda df: df.withColumn("k", F.lit(1))
    pairs = _first(crossing, ["source", "target", "source_layer", "target_layer"], CROSSING)
    pairs = pairs.join(there.withColumnRenamed("tier", "source_layer"), "source_layer", "left_semi").join(there.withColumnRenamed("tier", "target_layer"), "target_layer", "left_semi")
    pairs = top_per_key(pairs.where("source_layer <> target_layer"), ["source_layer", "target_layer"], [F.col("i")])
    parts = [
        edge(one(ends).join(one(at("presentation")), "k"), F.concat(F.lit("ep-tier-"), number), F.concat(F.lit("ep_"), number), tier_id(F.lit("presentation")), "handler", "link"),
        edge(one(held).join(serves, "k"), F.concat(F.lit("db-tier-"), number), server, F.concat(F.lit("db_"), number), "READS/WRITES", "link"),
        edge(flow, F.concat_ws("-", F.lit("flow"), "a", "b"), tier_id(F.col("a")), tier_id(F.col("b")), "calls", "flow"),
        edge(pairs, F.concat(F.lit("cross-"), number), tier_id(F.col("source_layer")), tier_id(F.col("target_layer")), F.concat_ws(" → ", "source", "target"), "cross_layer"),
    ]
    return nodes, reduce(DataFrame.unionByName, parts)


def drawn_system(nodes: DataFrame) -> DataFrame:
    """Nodes of a system with their place on the canvas: tiers in columns, endpoints and tables down beside theirs."""
    kind = F.split_part("id", F.lit("_"), F.lit(1))
    part = F.when(kind.isin("tier", "ep", "db"), kind).otherwise("other")
    w = Window.partitionBy("part")
    rows = nodes.withColumn("part", part).withColumn("i", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    place = F.array_position(F.array(*(F.lit(t[0]) for t in TIERS)), F.col("group")) - 1
    column = F.round(0.08 + F.when(place >= 0, place).otherwise(F.col("i")) * 0.2, 6)
    down = lambda one, top, height: F.when(F.col("n") == 1, one).otherwise(top + F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) * height)
    x = F.when(F.col("part") == "tier", column).when(F.col("part") == "ep", 0.28).when(F.col("part") == "db", 0.82).otherwise(0.5)
    y = F.when(F.col("part") == "tier", 0.55).when(F.col("part") == "ep", down(0.35, 0.12, 0.5)).when(F.col("part") == "db", down(0.55, 0.15, 0.55)).otherwise(0.15 + F.col("i") * 0.15)
    return rows.select(*(c for c in nodes.columns if c not in ("x", "y")), F.round(x * WIDTH, 3).alias("x"), F.round(y * HEIGHT, 3).alias("y"))


def drawn_dependencies(nodes: DataFrame, edges: DataFrame, most: int = DRAWN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The `most` nodes (id, group, ...) with most edges on a grid, group by group; the edges (src, dst, ...) between
    them; and one row that says whether nodes were left out (truncated)."""
    top = top_by_degree(nodes, edges, most)
    rows = nodes.join(top, "id").withColumn("group", F.when(F.coalesce("group", F.lit("")) == "", "core").otherwise(F.col("group")))
    w = Window.partitionBy("group")
    rows = rows.withColumn("i", F.row_number().over(w.orderBy(F.desc("degree"), "id")) - 1).withColumn("n", F.count("*").over(w))
    wide = F.least(F.lit(4), F.greatest(F.lit(2), F.ceil(F.sqrt("n")))).cast("int")
    # a row for each group of a few nodes
    groups = rows.select("group", "n").distinct().withColumn("wide", wide).withColumn("place", F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group")))
    above = Window.orderBy("place", "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("top", F.coalesce(F.sum(F.ceil(F.col("n") / F.col("wide")) + 1).over(above), F.lit(0)))
    rows = rows.join(groups.select("group", "wide", "top"), "group")
    x = F.least(F.lit(0.92), 0.06 + F.col("i") % F.col("wide") * 0.23)
    y = F.least(F.lit(0.92), 0.06 + (F.col("top") + F.floor(F.col("i") / F.col("wide"))) * 0.13)
    placed = rows.select(*(c for c in nodes.columns if c not in ("x", "y")), "degree", F.round(x * WIDTH, 3).alias("x"), F.round(y * HEIGHT, 3).alias("y"))
    return placed, induced(edges, top), nodes.agg((F.count("*") > most).alias("truncated"))


def drawn_edges(edges: DataFrame) -> DataFrame:
    """Edges with `animated`: those that show how calls flow."""
    return edges.withColumn("animated", F.coalesce(F.col("kind").isin("flow", "cross_layer"), F.lit(False)))


def class_relations(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """source, target, type of what classes extend and implement, by the names of nodes (id, label, name); the first ones in order."""
    ends = nodes.select("id", F.coalesce("name", F.lit("")).alias("name"), "label")
    rows = edges.where("type in ('EXTENDS', 'IMPLEMENTS')").join(ends.where("label = 'Class'").select(F.col("id").alias("src"), F.col("name").alias("source")), "src")
    rows = rows.join(ends.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return rows.select("source", "target", "type").orderBy("source", "target", "type").limit(most)


def report_text(repo: str, labels: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """One row, text: a report in Markdown with counts (ord, name, n), the six most frequent labels (label, n) and diagrams (ord, title, text)."""
    joined = lambda df, order, line, sep: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), sep).alias("t"))
    row = F.concat(F.lit("| "), "name", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    top = labels.orderBy(F.desc("n"), "label").limit(6)
    blocks = joined(texts, F.col("ord"), F.concat(F.lit("## "), "title", F.lit("\n\n```mermaid\n"), "text", F.lit("\n```")), "\n\n").withColumnRenamed("t", "blocks")
    table = joined(counts, F.col("ord"), row, "\n").withColumnRenamed("t", "rows")
    used = joined(top, F.struct((-F.col("n")).alias("n"), F.col("label").alias("label")), F.concat_ws(": ", "label", F.col("n").cast("string")), ", ").withColumnRenamed("t", "labels")
    all_ = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    one = reduce(lambda a, b: a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k"), (blocks, table, used, all_))
    head = F.concat(F.lit(f"# Diagrams of `{repo}`\n\nDrawn from "), F.col("all").cast("string"), F.lit(" nodes of its graph.\n\n| Part | Count |\n| --- | --- |\n"), "rows", F.lit("\n| Labels | "), "labels", F.lit(" |\n\n"))
    return one.select(F.concat(head, F.col("blocks"), F.lit("\n")).alias("text"))
