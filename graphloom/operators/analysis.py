"""Symbols, files and trees of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import missing

# Names that are entries or are called by the language itself.
ENTRY_NAMES = ["main", "__init__", "create_app", "handler", "app", "run", "setup", "configure"]
OWN_NAMES = ["__init__", "__str__", "__repr__", "__eq__", "__hash__"]


def dead_symbols(symbols: DataFrame, called: DataFrame, handlers: DataFrame, on: str = "name") -> DataFrame:
    """Symbols (name, kind) that nothing calls or serves, without entries, tests and private methods."""
    name = F.col("name")
    exempt = name.isin(ENTRY_NAMES + OWN_NAMES) | name.startswith("test_") | name.endswith("_test") | (name == "")
    private = (F.col("kind") == "method") & name.startswith("_") & ~name.startswith("__")
    return missing(missing(symbols.where(name.isNotNull() & ~exempt & ~private), called.select(on), on), handlers.select(on), on)


def find_file(files: DataFrame, wanted: str, order: str) -> DataFrame:
    """The file with a path, or else the first whose path ends so."""
    path = F.col("path")
    hit = files.withColumn("_p", F.when(path == wanted, 0).when(path.endswith(wanted), 1)).where("_p is not null")
    return hit.orderBy("_p", order).limit(1).drop("_p")


def file_tree(files: DataFrame) -> DataFrame:
    """path, depth, is_dir of every file and directory."""
    parts = F.split("path", "/")
    nodes = files.select("path").distinct().select(parts.alias("parts")).select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return nodes.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("parts")).alias("is_dir")).distinct()


def symbols_of(parsed: DataFrame) -> DataFrame:
    """file, name, kind, class_name, start_line, end_line, lines, weight: functions and methods of parsed files."""
    from graphloom.functions.text import complexity_weight

    base = parsed.select("file", "functions", "classes", complexity_weight(F.col("metadata.complexity")).alias("weight"))
    functions = base.select("file", "weight", F.explode("functions").alias("f")).select("file", "weight", "f.name", F.lit("function").alias("kind"), F.lit(None).cast("string").alias("class_name"), "f.start_line", "f.end_line")
    methods = (
        base.select("file", "weight", F.explode("classes").alias("c"))
        .select("file", "weight", F.col("c.name").alias("class_name"), F.explode("c.methods").alias("f"))
        .select("file", "weight", "f.name", F.lit("method").alias("kind"), "class_name", "f.start_line", "f.end_line")
    )
    start = F.coalesce("start_line", F.lit(1))
    return functions.unionByName(methods).withColumn("lines", F.greatest(F.lit(1), F.coalesce("end_line", start) - start + 1))
