"""Answers to questions over an indexed repository: hybrid retrieval, tools, plans.

The driver composes plans; every tool is a DataFrame with the columns of a hit (file, symbol,
start_line, content, score, source), so that one merge and one citation form serve all.
Language models are left out: plans, answers and scores have their offline forms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph, paths, retrieval, vectors

HIT = ["file", "symbol", "start_line", "content", "score"]


@dataclass
class Index:
    """nodes and edges of the graph, chunks (file, symbol, start_line, code, vector)."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    repo: str


def _one(index: Index, text: str) -> DataFrame:
    return index.nodes.sparkSession.createDataFrame([(text,)], "q string")


def search_code(index: Index, question: str, k: int = 8) -> DataFrame:
    (row,) = vectors.hashing_embedder(_one(index, question), "q", "v").collect()
    rows = index.chunks.withColumnRenamed("vector", "embedding").withColumn("vec_id", F.concat_ws("|", "file", "symbol", "start_line"))
    return vectors.nearest_to(rows, row.v, k).select("file", "symbol", "start_line", F.col("code").alias("content"), "score")


def _seeds(index: Index, symbols: list[str]) -> DataFrame:
    return index.nodes.where(F.col("name").isin(symbols) | F.col("qualified").isin(symbols)).select("id").distinct()


def analyze_dependency(index: Index, symbols: list[str], depth: int = 3) -> DataFrame:
    used = index.edges.where("type in ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS')")
    rows = paths.dependencies(used, _seeds(index, symbols), depth).join(index.nodes, F.col("node") == F.col("id"))
    content = F.concat_ws(" ", F.col("first_type"), "label", F.coalesce("name", "file", "id"))
    return rows.select("file", F.col("qualified").alias("symbol"), F.lit(1).alias("start_line"), content.alias("content"), F.greatest(F.lit(0.3), 1 - 0.15 * F.col("depth")).alias("score"))


def trace_calls(index: Index, symbols: list[str], depth: int = 4, chains: int = 3) -> DataFrame:
    from graphloom.operators.ranking import top_per_key

    found = top_per_key(paths.call_chains(index.edges, _seeds(index, symbols), depth).withColumn("way", F.array_join("nodes", " -> ")), ["seed"], [F.desc("depth"), F.col("way")], chains)
    rows = found.join(index.nodes, F.col("seed") == F.col("id"))
    return rows.select("file", F.col("qualified").alias("symbol"), F.lit(1).alias("start_line"), F.col("way").alias("content"), retrieval.chain_score(F.col("depth")).alias("score"))


def trace_request_flow(index: Index, route: str = "") -> DataFrame:
    """Calls from the endpoints whose id has the route, or else from the first five."""
    ends = index.nodes.where("label = 'ApiEndpoint'")
    hit = ends.where(F.contains(F.lower("id"), F.lit(route.lower()))) if route else ends
    if route and hit.isEmpty():
        hit = ends
    first = hit.orderBy("id").limit(5).select("id")
    rows = paths.call_chains(index.edges, first, 6).join(index.nodes, F.col("seed") == F.col("id"))
    return rows.select("file", F.col("id").alias("symbol"), F.lit(1).alias("start_line"), F.array_join("nodes", " -> ").alias("content"), retrieval.chain_score(F.col("depth")).alias("score"))


def generate_architecture(index: Index) -> DataFrame:
    files = index.nodes.where("label = 'File'").select(F.col("file").alias("path"))
    symbols = index.nodes.where("label in ('Function', 'Class')").select(F.col("file").alias("path"))
    rows = graph.layers(files, symbols)
    return rows.select(F.split_part("samples", F.lit(","), F.lit(1)).alias("file"), F.col("layer").alias("symbol"), F.lit(1).alias("start_line"), F.format_string("%s: %d files, %d symbols", "layer", "files", "symbols").alias("content"), F.lit(0.45).alias("score"))


def find_bug_patterns(index: Index, question: str, k: int = 50) -> DataFrame:
    rows = search_code(index, question, k).withColumn("bug", T.first_bug_pattern(F.col("content"))).where("bug is not null")
    return rows.select("file", F.col("bug").alias("symbol"), "start_line", "content", "score")


TOOLS: dict[str, Callable[[Index, str, list[str]], DataFrame]] = {
    "search_code": lambda i, q, s: search_code(i, q),
    "search_graph": lambda i, q, s: trace_calls(i, s),
    "analyze_dependency": lambda i, q, s: analyze_dependency(i, s),
    "generate_architecture": lambda i, q, s: generate_architecture(i),
    "explain_function": lambda i, q, s: search_code(i, q).unionByName(analyze_dependency(i, s)),
    "trace_request_flow": lambda i, q, s: trace_request_flow(i),
    "find_bug_patterns": lambda i, q, s: find_bug_patterns(i, q),
}


def read_question(index: Index, question: str) -> tuple[str, list[str], list[str]]:
    """Strategy, symbols and tools of a question."""
    row = _one(index, question).select(T.strategy(F.col("q")).alias("s"), T.symbol_candidates(F.col("q")).alias("c"), T.plan_tools(F.col("q")).alias("p")).first()
    return row.s, list(row.c), list(row.p)


def hybrid(index: Index, question: str, k: int = 5) -> DataFrame:
    """The k best hits of vector and graph search, merged."""
    strategy, symbols, _ = read_question(index, question)
    keys = ["file", "symbol", "start_line"]
    vector = search_code(index, question) if strategy != "graph" else None
    linked = analyze_dependency(index, symbols, 2).unionByName(trace_calls(index, symbols)) if strategy != "vector" else None
    none = index.nodes.sparkSession.createDataFrame([], "file string, symbol string, start_line int, content string, score double")
    filled = lambda df: (none if df is None else df).na.fill("", ["file", "symbol"])
    merged = retrieval.merge_hits(filled(vector), filled(linked), keys)
    return merged.orderBy(F.desc("score"), *keys).limit(k)


def meta_answer(repo: str, question: str) -> str | None:
    """What the name of the repository itself answers."""
    owner, _, name = repo.partition("/")
    q = question.lower()
    if not (owner and name):
        return None
    about = any(w in q for w in ("repo", "repository"))
    if about and any(w in q for w in ("owner", "owns")):
        return f"{repo} belongs to {owner}."
    if about and any(w in q for w in ("what is th", "what repo", "which repo", " name")):
        return f"This is {name}, of {owner} ({repo})."
    return None


def answer(index: Index, question: str) -> dict:
    """answer, confidence, tools, citations (a DataFrame) and further questions: plan, run the tools, cite."""
    if (meta := meta_answer(index.repo, question)) is not None:
        return {"answer": meta, "confidence": 0.98, "tools": [], "citations": None, "next": []}
    _, symbols, tools = read_question(index, question)
    found = None
    for tool in dict.fromkeys(tools):
        rows = TOOLS[tool](index, question, symbols).select(*HIT)
        found = rows if found is None else found.unionByName(rows)
    hits = retrieval.distinct_citations(found.select("file", F.col("content").alias("snippet"), "start_line", "symbol", "score").withColumn("ord", -F.col("score")), "ord")
    (row,) = retrieval.extractive(hits.select(F.col("file").alias("path"), F.col("snippet").alias("content"), "score")).collect()
    best = hits.orderBy(F.desc("score"), "file").select("file", "symbol").first()
    more = _one(index, question).select(retrieval.follow_ups(F.col("q"), F.lit(best.symbol if best else None), F.lit(best.file if best else None), F.lit(index.repo), F.array().cast("array<struct<name:string,path:string>>")).alias("n")).first().n
    cited = hits.select("file", "symbol", *retrieval.citation(F.col("snippet"), F.col("start_line"), F.lit(0), F.col("score")))
    return {"answer": row.answer or "Nothing was found.", "confidence": row.confidence or 0.0, "tools": tools, "citations": cited, "next": more}
