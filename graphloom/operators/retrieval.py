"""Scores, merges, reranking and citations of retrieval hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.ranking import top_per_key

#: Weights of the two sides and what a hit of both gains.
VECTOR_WEIGHT, GRAPH_WEIGHT, BOTH = 0.55, 0.45, 0.15


def dependency_score(depth: Column) -> Column:
    return F.greatest(F.lit(0.4), 1 - 0.15 * depth)


def chain_score(depth: Column) -> Column:
    return F.greatest(F.lit(0.35), 0.9 - 0.08 * depth)


def merge_hits(vector: DataFrame, graph: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content, score, source of hits of both sides (keys, content, score), one row a key.

    Of several vector hits of a key the best counts; a graph hit that is there twice is still
    one hit.  The longer content stays."""
    side = lambda df, n: top_per_key(df, keys, [F.desc("score"), F.desc("content")]).select(*keys, F.col("content").alias(f"_c{n}"), F.col("score").alias(f"_s{n}"))
    both = side(vector, 1).join(side(graph, 2), keys, "full_outer")
    a, b = F.col("_s1") * VECTOR_WEIGHT, F.col("_s2") * GRAPH_WEIGHT
    hit = F.col("_s1").isNotNull() & F.col("_s2").isNotNull()
    score = F.when(hit, F.least(F.lit(1.0), a + b + BOTH)).otherwise(F.coalesce(a, b))
    source = F.when(hit, "hybrid").when(F.col("_s1").isNotNull(), "vector").otherwise("graph")
    content = F.when(hit & (F.length("_c2") > F.length("_c1")), F.col("_c2")).otherwise(F.coalesce("_c1", "_c2"))
    return both.select(*keys, content.alias("content"), score.alias("score"), source.alias("source"))


def rerank(hits: DataFrame, judged: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of hits (key, score) with judgements (key, judgement) where there are any."""
    rows = hits.join(judged, key, "left")
    score = F.least(F.lit(1.0), 0.4 * F.col("score") + 0.6 * F.coalesce("judgement", "score"))
    return rows.withColumn("score", score).drop("judgement").orderBy(F.desc("score"), key).limit(k)


def snippet(content: Column, most: int = 500) -> Column:
    text = F.trim(content)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def citation(content: Column, start: Column, end: Column, score: Column) -> list[Column]:
    """snippet, start_line, end_line, score as they are cited."""
    first = F.when(F.coalesce(start, F.lit(0)) == 0, 1).otherwise(start)
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    last = F.when(F.coalesce(end, F.lit(0)) == 0, first + F.greatest(F.lit(1), ends)).otherwise(end)
    return [snippet(content).alias("snippet"), first.alias("start_line"), last.alias("end_line"), F.round(score, 3).alias("score")]


def extractive(hits: DataFrame, n: int = 3, most: int = 240) -> DataFrame:
    """One row, answer and confidence, of the n best hits (path, content, score)."""
    top = hits.orderBy(F.desc("score"), "path").limit(n)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", F.substring(F.trim("content"), 1, most).alias("t"))))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["path"], F.lit(": "), x["t"])), "\n")
    return top.agg(text.alias("answer"), F.round(F.least(F.lit(0.75), F.avg("score")), 2).alias("confidence"))


def distinct_citations(rows: DataFrame, order: str) -> DataFrame:
    """Citations (file, snippet, start_line) of files, one for each file, start of the snippet and line."""
    keyed = rows.where(F.coalesce("file", F.lit("")) != "").withColumn("_k", F.substring("snippet", 1, 80))
    return top_per_key(keyed, ["file", "_k", "start_line"], [F.col(order)]).drop("_k")


def citations_to_hits(rows: DataFrame) -> DataFrame:
    """Hits of citations that have text, with defaults."""
    kept = rows.where(F.trim(F.coalesce("snippet", F.lit(""))) != "")
    return kept.withColumns({"source": F.coalesce("source", F.lit("agent")), "score": F.coalesce("score", F.lit(0.5)), "start_line": F.coalesce("start_line", F.lit(1))})


def history(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    return top_per_key(messages, [key], [F.desc(order)], n)


def prompt(messages: DataFrame, key: str, order: str, turns: int = 6, most: int = 500) -> DataFrame:
    """key, prompt: the last turns (role, text) of each conversation, cut and joined."""
    last = history(messages, key, order, turns)
    lines = F.array_sort(F.collect_list(F.struct(order, F.concat("role", F.lit(": "), F.substring("text", 1, most)).alias("line"))))
    return last.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def last_matching(messages: DataFrame, key: str, order: str, test: Column) -> DataFrame:
    """For each key the last row that passes a test, or else the last row."""
    return top_per_key(messages.withColumn("_t", F.when(test, 1).otherwise(0)), [key], [F.desc("_t"), F.desc(order)]).drop("_t")


def follow_ups(question: Column, name: Column, path: Column, repo: Column, cited: Column) -> Column:
    """At most five further questions about a name and a path, the repository and what was cited (name, path), none
    the question itself and none twice in whatever case."""
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    has_name, has_path = F.coalesce(name, F.lit("")) != "", F.coalesce(path, F.lit("")) != ""
    says = lambda *words: T.any_of(F.lower(question), list(words))
    own = F.array(
        F.when(has_name & has_path, F.concat(F.lit("Walk me through "), quoted(name), F.lit(" from "), quoted(path))),
        F.when(has_name & has_path, F.concat(F.lit("Where is "), quoted(name), F.lit(" called from?"))),
        F.when(~has_name & has_path, F.concat(F.lit("Which parts does "), quoted(path), F.lit(" define?"))),
        F.when(has_name & ~has_path, F.concat(F.lit("Say more about "), quoted(name))),
        F.when(~says("architecture"), "How is this repository built up?"),
        F.when(~says("endpoint", "api"), "Which endpoints does it offer?"),
        F.when(~says("depend"), F.concat(F.lit("What does "), quoted(repo), F.lit(" rest on?"))),
    )
    shown = F.transform(F.slice(cited, 1, 2), lambda c: F.when((c["name"] != "") & (c["path"] != ""), F.concat(F.lit("Show me the code of "), quoted(c["name"]), F.lit(" in "), quoted(c["path"]))))
    found = F.filter(F.concat(own, F.coalesce(shown, F.array().cast("array<string>")), F.array(F.lit("What should I read next?"))), lambda x: x.isNotNull() & (F.lower(x) != F.lower(F.trim(question))))
    once = F.aggregate(found, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.array_append(kept, x)))
    return F.slice(once, 1, 5)


def shaped_hits(rows: DataFrame) -> DataFrame:
    """Hits of stored vectors (id, document, score and metadata) as they are merged: names without text are null, what is missing is empty or 0."""
    optional = {"function_name": "function", "class_name": "class", "symbol": "symbol", "chunk_type": "type"}
    return rows.select(
        F.concat(F.lit("vector::"), F.col("id").cast("string")).alias("hit_id"), F.lit("vector").alias("source"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("document", F.lit("")).alias("content"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), *(T.or_null(F.col(c)).alias(n) for n, c in optional.items()), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("start_line", "end_line")),
    )
