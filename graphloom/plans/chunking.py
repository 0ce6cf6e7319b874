"""Chunks, spans, manifests and incremental indexing over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import chunks, ranking
from graphloom.plans.registry import Registry
from graphloom.session import stage, table

registry = query = Registry()


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def spans(spark, sf_dir):
    """Pseudo symbols: each line that starts with E or T is a span of one line."""
    rows = chunks.lines(documents(spark, sf_dir), "doc_id", "text").where(F.col("content").rlike("^[ET]"))
    return rows.select("doc_id", F.col("line").alias("start_line"), F.col("line").alias("end_line"))


SQL_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents"


@query("line_slice", "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS slice FROM documents")
def line_slice(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.slice_lines(F.col("text"), F.lit(2), F.lit(4))).alias("slice"))


@query("body_slice", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5('') ELSE md5(array_to_string(string_split(text, chr(10))[doc_id % 5:3], chr(10))) END AS body FROM documents")
def body_slice(spark, sf_dir):
    start = (F.col("doc_id") % 5).cast("int")
    return documents(spark, sf_dir).select("doc_id", F.md5(T.slice_lines(F.col("text"), start, F.lit(3))).alias("body"))


@query(
    "uncovered_ranges",
    f"""
    WITH l AS ({SQL_LINES}), u AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM l WHERE NOT regexp_matches(content, '^[ET]'))
    SELECT doc_id, min(line) AS start_line, max(line) AS end_line FROM u GROUP BY doc_id, island
    """,
)
def uncovered_ranges(spark, sf_dir):
    return chunks.uncovered(documents(spark, sf_dir), spans(spark, sf_dir), "doc_id").select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(
    "chunk_spans",
    f"""
    WITH l AS ({SQL_LINES})
    SELECT doc_id, 'symbol' AS kind, line AS start_line, line AS end_line FROM l WHERE regexp_matches(content, '^[ET]')
    UNION ALL SELECT doc_id, 'module', 1, len(string_split(text, chr(10))) FROM documents WHERE NOT regexp_matches(text, '(^|\\n)[ET]')
    """,
)
def chunk_spans(spark, sf_dir):
    found = spans(spark, sf_dir)
    whole = ranking.missing(documents(spark, sf_dir), found, "doc_id").select("doc_id", F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    rows = found.select("doc_id", F.lit("symbol").alias("kind"), "start_line", "end_line").unionByName(whole)
    return rows.select("doc_id", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(
    "meaningful_blocks",
    "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(import |from .+ import |#|//|/\\*|\\*|$)'))) >= 3 AS meaningful FROM documents",
)
def meaningful_blocks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", chunks.meaningful(F.col("text")).alias("meaningful"))


@query(
    "embedding_document",
    "SELECT doc_id, md5('File: ' || source || chr(10) || 'Language: ' || lang || chr(10) || 'Type: function' || chr(10) || 'Symbol: s' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || text) AS doc FROM documents",
)
def embedding_document(spark, sf_dir):
    symbol = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    doc = chunks.embedding_document(F.col("source"), F.col("lang"), F.lit("function"), symbol, F.lit(""), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(doc).alias("doc"))


@query("chunk_hash", "SELECT doc_id, sha256('repo|' || source || '|' || CAST(doc_id AS VARCHAR) || '|1|' || text) AS chunk_id FROM documents")
def chunk_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", chunks.chunk_hash(F.lit("repo"), F.col("source"), F.col("doc_id"), F.lit(1), F.col("text")).alias("chunk_id"))


CURRENT = "SELECT doc_id AS file, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0"
PRIOR = "SELECT doc_id AS file, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0"


def manifests(spark, sf_dir):
    """Two states of a manifest: some documents are removed, some added, some have another text."""
    docs = documents(spark, sf_dir)
    before = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return before, docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("file"), F.sha2(text, 256).alias("sha256"))


@query(
    "manifest_diff",
    f"""
    SELECT status, count(*) AS files FROM (
      SELECT CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status
      FROM ({PRIOR}) a FULL JOIN ({CURRENT}) b USING (file)) GROUP BY status
    """,
)
def manifest_diff(spark, sf_dir):
    return ranking.diff(*manifests(spark, sf_dir), "file", "sha256").groupBy("status").agg(F.count("*").alias("files"))


@query("incremental_anti_join", f"SELECT file, sha256(CAST(file AS VARCHAR) || '|' || h) AS chunk_id FROM ({CURRENT}) WHERE file NOT IN (SELECT file FROM ({PRIOR}) a JOIN ({CURRENT}) b USING (file) WHERE a.h = b.h)")
def incremental_anti_join(spark, sf_dir):
    before, after = (stage(m, "manifest") for m in manifests(spark, sf_dir))
    chunk_id = chunks.chunk_hash(F.col("file"), F.col("sha256")).alias("chunk_id")
    _, todo = chunks.incremental(before, after, before.select(chunk_id, "file"), after.select("file", chunk_id))
    return todo.select("file", "chunk_id")


@query("vector_upsert", "SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, coalesce(n.label, o.label) AS label FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0) o FULL JOIN (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label + 100 END AS label FROM embeddings WHERE vec_id % 2 = 0) n USING (vec_id)")
def vector_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 2 = 0").select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.col("label") + 100).alias("label"))
    return ranking.upsert(e.where("vec_id % 3 <> 0"), new, "vec_id")


@query("batch_assignment", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 64) AS BIGINT) AS batch FROM documents")
def batch_assignment(spark, sf_dir):
    return chunks.batches(documents(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "batch")


@query("coverage_gate", "SELECT source, count(l.doc_id) AS embedded, count(*) AS expected, count(l.doc_id) >= 0.8 * count(*) AS complete FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def coverage_gate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seen")).distinct()
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left").groupBy("source").agg(F.count("seen").alias("embedded"), F.count("*").alias("expected"))
    return rows.withColumn("complete", F.col("embedded") >= 0.8 * F.col("expected"))


@query("recover_job", "SELECT source, CASE WHEN count(l.doc_id) < count(*) THEN 'failed' ELSE 'completed' END AS stage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def recover_job(spark, sf_dir):
    return coverage_gate(spark, sf_dir).select("source", F.when(F.col("embedded") < F.col("expected"), "failed").otherwise("completed").alias("stage"))


@query("vector_ids", "SELECT vec_id FROM embeddings WHERE label = 3")
def vector_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id")


@query("vector_dims", "SELECT len(embedding) AS dims, count(*) AS vectors FROM embeddings GROUP BY len(embedding)")
def vector_dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count("*").alias("vectors"))


@query("token_stream", "SELECT conv_id, turn, i, substr(text, (i - 1) * 24 + 1, 24) AS piece FROM (SELECT *, unnest(generate_series(1, CAST(ceil(length(text) / 24.0) AS BIGINT))) AS i FROM conversations)")
def token_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.text_slices(F.col("text"), 24)).alias("i", "piece"))
    return rows.withColumn("i", (F.col("i") + 1).cast("long"))


@query("sse_frames", "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.event_frame(F.col("event_type"), F.col("props")).alias("frame"))


@query("sse_parse", "SELECT event_id, event_type AS event, props AS data FROM events")
def sse_parse(spark, sf_dir):
    frames = sse_frames(spark, sf_dir)
    part = lambda name: F.regexp_extract("frame", rf"(?m)^{name}: ?(.*)$", 1)
    return frames.select("event_id", part("event").alias("event"), part("data").alias("data"))
