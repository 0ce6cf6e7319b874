"""Line spans, chunks of source text and incremental indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions.text import slice_lines
from graphloom.operators.ranking import diff, missing

#: Lines of a class that is one chunk; lines of a block outside of symbols that is worth a chunk.
WHOLE_CLASS, LEAST_BLOCK = 80, 3
PREAMBLE = r"^(import |from .+ import |#|//|/\*|\*|$)"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content of every line."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def uncovered(texts: DataFrame, spans: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start_line, end_line: the largest runs of lines in no span (key, start_line, end_line).

    Spans are looked at in order, with one behind the last line of each text: a run ends before a
    span that begins behind all ends so far.  Of a text only the number of its lines is needed."""
    ends = texts.select(key, (F.size(F.split(text, "\n")) + 1).alias("start_line"), F.lit(True).alias("_last")).withColumn("end_line", F.col("start_line"))
    taken = spans.where("end_line >= start_line").select(key, "start_line", "end_line", F.lit(False).alias("_last"))
    own = Window.partitionBy(key)
    reached = F.max("end_line").over(own.orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1))
    rows = ends.unionByName(taken).withColumn("_n", F.max(F.when(F.col("_last"), F.col("start_line") - 1)).over(own)).withColumn("_reached", F.greatest(F.coalesce(reached, F.lit(0)), F.lit(0)))
    runs = rows.select(key, (F.col("_reached") + 1).alias("start_line"), F.least(F.col("start_line") - 1, "_n").alias("end_line"))
    return runs.where("start_line <= end_line")


def meaningful(code: Column) -> Column:
    """Whether enough lines are neither blank nor imports nor comments."""
    return F.size(F.filter(F.split(code, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(PREAMBLE))) >= LEAST_BLOCK


def chunk_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def embedding_document(path: Column, language: Column, kind: Column, symbol: Column, imports: Column, code: Column) -> Column:
    """The text that is embedded: a head of fields, a blank line, the code."""
    head = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.concat_ws("\n", head("File", path), head("Language", language), head("Type", kind), head("Symbol", symbol), head("Imports", imports)), F.lit("\n\n"), code)


def semantic_chunks(parsed: DataFrame, sources: DataFrame, threshold: int = WHOLE_CLASS) -> DataFrame:
    """file, kind, symbol, start_line, end_line, code, chunk_id of parsed files with their sources (file, content).

    Functions; classes of at most `threshold` lines, or without methods, whole, and else their
    methods; and what lies outside of these, if it is more than imports and comments."""
    files = parsed.join(sources.where("content <> ''"), "file")
    functions = files.select("file", "content", F.explode("functions").alias("f")).select("file", "content", F.lit("function").alias("kind"), F.col("f.name").alias("symbol"), "f.start_line", "f.end_line")
    classes = files.select("file", "content", F.explode("classes").alias("c"))
    whole = (F.size("c.methods") == 0) | (F.col("c.end_line") - F.col("c.start_line") + 1 <= threshold)
    whole_classes = classes.where(whole).select("file", "content", F.lit("class").alias("kind"), F.col("c.name").alias("symbol"), "c.start_line", "c.end_line")
    methods = classes.where(~whole).select("file", "content", "c.name", F.explode("c.methods").alias("m"))
    methods = methods.select("file", "content", F.lit("method").alias("kind"), F.concat_ws(".", "name", "m.name").alias("symbol"), "m.start_line", "m.end_line")
    parts = functions.unionByName(whole_classes).unionByName(methods)
    parts = parts.withColumn("code", slice_lines(F.col("content"), F.col("start_line"), F.col("end_line"))).where((F.trim("code") != "") | (F.col("kind") == "class"))
    blocks = uncovered(files.select("file", F.col("content").alias("text")), parts, "file").join(files.select("file", "content"), "file")
    blocks = blocks.withColumn("code", slice_lines(F.col("content"), F.col("start_line"), F.col("end_line"))).where(meaningful(F.col("code")))
    blocks = blocks.select("file", F.lit("module").alias("kind"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", "code")
    chunks = parts.drop("content").unionByName(blocks)
    return chunks.withColumn("chunk_id", chunk_hash(F.col("file"), F.coalesce("symbol", F.lit("")), F.col("start_line"), F.col("code")))


def parsed_chunks(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """file, language, kind, symbol, start_line, end_line, content: one chunk for each function, for each method of a
    class, and for a class without methods; files without a source have empty ones."""
    shape = lambda kind, symbol, s: (F.lit(kind).alias("kind"), symbol.alias("symbol"), F.col(f"{s}.start_line").alias("start_line"), F.col(f"{s}.end_line").alias("end_line"))
    functions = parsed.select("file", "language", F.explode("functions").alias("f")).select("file", "language", *shape("function", F.col("f.name"), "f"))
    classes = parsed.select("file", "language", F.explode("classes").alias("c"))
    methods = classes.select("file", "language", "c", F.explode("c.methods").alias("m")).select("file", "language", *shape("method", F.concat_ws(".", "c.name", "m.name"), "m"))
    bare = classes.where(F.coalesce(F.size("c.methods"), F.lit(0)) <= 0).select("file", "language", *shape("class", F.col("c.name"), "c"))
    rows = functions.unionByName(methods).unionByName(bare).join(sources.select("file", F.col("content").alias("source")), "file", "left")
    return rows.withColumn("content", F.coalesce(slice_lines(F.col("source"), F.greatest("start_line", F.lit(1)), F.col("end_line")), F.lit(""))).drop("source")


def incremental(before: DataFrame, after: DataFrame, stored: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of stored vectors (chunk_id, file) to delete, and chunks to embed, between two manifests (file, sha256)."""
    status = diff(before, after, "file", "sha256")
    gone = stored.join(status.where("status in ('removed', 'changed')").select("file"), "file", "left_semi").select("chunk_id")
    kept = missing(stored.select("chunk_id"), gone, "chunk_id")
    return gone, missing(chunks, kept, "chunk_id")


def batches(rows: DataFrame, key: str, order: list[str], size: int = 64) -> DataFrame:
    """Adds `batch`: consecutive rows of a key, `size` at a time."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))
