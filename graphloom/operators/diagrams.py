"""Layouts and diagram texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions import text as T

# Tiers from left to right with their x.
TIERS = {"client": "0.08", "api": "0.28", "service": "0.5", "data": "0.72", "external": "0.92"}


def circle(nodes: DataFrame, order: str, radius: float = 0.38) -> DataFrame:
    """Nodes on a circle, from the top; for a graph small enough to draw."""
    i, n = F.row_number().over(Window.partitionBy().orderBy(order)) - 1, F.count("*").over(Window.partitionBy())
    angle = 2 * F.pi() * i / n - F.pi() / 2
    return nodes.withColumn("x", F.round(0.5 + radius * F.cos(angle), 6)).withColumn("y", F.round(0.5 + radius * F.sin(angle), 6))


def columns(nodes: DataFrame, tier: str, order: str) -> DataFrame:
    """Nodes in one column for each tier, evenly down."""
    w = Window.partitionBy(tier)
    place, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return nodes.withColumn("x", F.coalesce(T.lookup(TIERS, F.col(tier)).cast("double"), F.lit(0.5))).withColumn("y", F.round(place / (n + 1), 6))


def top_by_degree(nodes: DataFrame, edges: DataFrame, most: int = 48) -> DataFrame:
    """id, degree of the nodes with most edges, ties by id."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(most)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def lines_text(lines: DataFrame, head: str) -> DataFrame:
    """One row, text: the head and the lines (ord, line) in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(head + "\n"), body).alias("text"))


def flowchart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A flowchart of nodes (id, label) and edges (src, dst, label)."""
    boxes = nodes.select(F.concat(F.lit("0"), "id").alias("ord"), F.concat(F.lit("    "), T.diagram_id(F.col("id")), T.diagram_label(F.col("label"))).alias("line"))
    arrows = edges.select(F.concat(F.lit("1"), "src", F.lit(">"), "dst").alias("ord"), F.concat(F.lit("    "), T.diagram_id(F.col("src")), F.lit(" -->|"), "label", F.lit("| "), T.diagram_id(F.col("dst"))).alias("line"))
    return lines_text(boxes.unionByName(arrows), "flowchart LR")


def class_diagram(classes: DataFrame, relations: DataFrame, most: int = 20, ties: int = 25) -> DataFrame:
    """The first classes (name, methods array, of which six are shown) and relations (source, target, type) in order of their names."""
    classes, relations = classes.orderBy("name").limit(most), relations.orderBy("source", "target", "type").limit(ties)
    methods = F.array_join(F.transform(F.slice("methods", 1, 6), lambda m: F.concat(F.lit("        +"), T.diagram_method(m), F.lit("()"))), "\n")
    boxes = classes.select(F.concat(F.lit("0"), "name").alias("ord"), F.concat(F.lit("    class "), T.diagram_id(F.col("name")), F.lit(" {\n"), methods, F.lit("\n    }")).alias("line"))
    arrow = F.when(F.col("type") == "EXTENDS", " <|-- ").when(F.col("type") == "IMPLEMENTS", " <|.. ")
    source, target = T.diagram_id(F.col("source")), T.diagram_id(F.col("target"))
    line = F.when(arrow.isNotNull(), F.concat(target, arrow, source)).otherwise(F.concat(source, F.lit(" --> "), target))
    tied = relations.select(F.concat(F.lit("1"), "source", F.lit(">"), "target").alias("ord"), F.concat(F.lit("    "), line).alias("line"))
    return lines_text(boxes.unionByName(tied), "classDiagram")


def sequence(chains: DataFrame) -> DataFrame:
    """A sequence diagram of chains (ord, nodes array of names)."""
    steps = chains.select("ord", F.posexplode(F.zip_with(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", 2, F.size("nodes")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "s"))
    line = F.concat(F.lit("    "), T.diagram_id(F.col("s.a")), F.lit("->>"), T.diagram_id(F.col("s.b")), F.lit(": calls"))
    return lines_text(steps.select(F.struct("ord", "i").alias("ord"), line.alias("line")), "sequenceDiagram")
