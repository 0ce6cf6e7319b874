"""The analytics report of parsed files: named result tables, and one row of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.analysis import dead_symbols, symbols_of
from graphloom.operators.ranking import share, top_per_key


def language_distribution(parsed: DataFrame) -> DataFrame:
    rows = parsed.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum("metadata.lines").alias("lines"))
    return share(rows, "lines", "pct").orderBy(F.desc("lines"), "language")


def complexity_distribution(parsed: DataFrame) -> DataFrame:
    levels = parsed.sparkSession.createDataFrame([("low",), ("medium",), ("high",)], "level string")
    level = F.when(F.col("metadata.complexity").isin("medium", "high"), F.col("metadata.complexity")).otherwise("low")
    return levels.join(parsed.groupBy(level.alias("level")).agg(F.count("*").alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("files"))


def heatmap(parsed: DataFrame, most: int = 80) -> DataFrame:
    weight, lines = T.complexity_weight(F.col("metadata.complexity")), F.col("metadata.lines")
    rows = parsed.select("file", T.directory(F.col("file")).alias("directory"), lines.alias("lines"), weight.alias("score"), F.least(F.lit(1.0), weight * F.log10(lines + 10) / 30).alias("intensity"))
    return rows.orderBy(F.desc(F.col("score") * F.col("lines")), "file").limit(most)


def largest_symbol(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy(F.desc("lines"), "file", "start_line").limit(1)


def duplicates(symbols: DataFrame, least_lines: int = 4) -> DataFrame:
    """fingerprint, size, similarity and at most six members of symbols of one name, kind and length."""
    rows = symbols.where(F.col("lines") >= least_lines).withColumn("fingerprint", T.fingerprint(F.col("name"), F.col("kind"), F.col("lines")))
    sizes = rows.groupBy("fingerprint").agg(F.count("*").alias("size")).where("size >= 2")
    first = top_per_key(rows, ["fingerprint"], [F.col("file"), F.col("start_line")], 6).groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.concat_ws("::", "file", "name"))).alias("members"))
    return sizes.join(first, "fingerprint").withColumn("similarity", 0.72 + F.least(F.lit(0.25), 0.03 * F.col("size"))).orderBy(F.desc("size"), "fingerprint")


def resolved_once(wanted: DataFrame, owners: DataFrame, owner: str, keys: list[str] | None = None, but: str | None = None) -> DataFrame:
    """The rows of `wanted`, distinct, whose keys exactly one owner has (without what `but`, one of the keys, names), with this owner.

    The last key is a column of `owners`.  Of the owners of a key their number, the first and the last are enough, so
    the join gives no more rows than are wanted, however many owners a key has."""
    keys = keys or ["name"]
    ends = owners.select(keys[-1], owner).distinct().groupBy(keys[-1]).agg(F.count("*").alias("_n"), F.min(owner).alias("_a"), F.max(owner).alias("_b")).where("_n <= 2")
    met = wanted.select(*keys).distinct().join(ends, keys[-1])
    one = F.when(F.col("_n") == 1, F.col("_a"))
    if but:
        mine = F.col(but)
        one = F.when((F.col("_n") == 1) & ~F.col("_a").eqNullSafe(mine), F.col("_a")).when((F.col("_n") == 2) & (F.col("_a") == mine), F.col("_b")).when((F.col("_n") == 2) & (F.col("_b") == mine), F.col("_a"))
    return met.select(*keys, one.alias(owner)).where(F.col(owner).isNotNull())


def import_edges(parsed: DataFrame) -> DataFrame:
    """source, target of imports: `ext:` and the first part of outside modules, and files that exactly one path fits.

    An inner module a.b fits the paths that end in a/b with a suffix, in full or as a package."""
    rows = parsed.select("file", F.explode("imports").alias("i")).select("file", "i.module", "i.is_external")
    outside = rows.where("is_external").select(F.col("file").alias("source"), F.concat(F.lit("ext:"), F.split_part("module", F.lit("."), F.lit(1))).alias("target"))
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[^./]+$", ""), r"/(__init__|index)$", "")
    parts = F.split(stem, "/")
    # every end of a path is a key, so the suffix match is an equi-join
    ends = parsed.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))).alias("key"))
    wanted = rows.where("not is_external").select(F.col("file").alias("source"), F.regexp_replace(F.replace(F.regexp_replace("module", r"^[./]+", ""), F.lit("."), F.lit("/")), "/$", "").alias("key")).where("key <> ''").distinct()
    inside = resolved_once(wanted, ends, "file", ["source", "key"], "source").withColumnRenamed("file", "target")
    return outside.unionByName(inside.select("source", "target")).distinct()


def report(parsed: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report by name."""
    symbols = symbols_of(parsed)
    called = parsed.select(F.explode("calls.callee").alias("name"))
    handlers = parsed.select(F.explode("api_endpoints.handler").alias("name"))
    edges = import_edges(parsed)
    clusters = duplicates(symbols)
    counters = parsed.agg(F.count("*").alias("files"), F.sum("metadata.lines").alias("lines"), F.sum(F.size("functions") + F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["methods"]))).alias("functions"), F.sum(F.size("classes")).alias("classes"), F.sum(F.size("api_endpoints")).alias("endpoints"))
    repeated = clusters.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("duplicates"))
    return {
        "summary": counters.withColumn("k", F.lit(1)).join(repeated.withColumn("k", F.lit(1)), "k").drop("k"),
        "languages": language_distribution(parsed),
        "complexity": complexity_distribution(parsed),
        "heatmap": heatmap(parsed),
        "largest_symbol": largest_symbol(symbols),
        "duplicates": clusters.limit(12),
        "dead_code": dead_symbols(symbols, called, handlers).orderBy(F.desc("lines"), "file", "start_line").limit(20),
        "imports": edges.orderBy("source", "target").limit(60),
    }
