"""Search, merging, citations, planning and memory over embeddings, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import ranking, retrieval, vectors
from graphloom.plans.registry import Registry
from graphloom.session import table

registry = query = Registry()

COSINE = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query("vector_topk", f"SELECT e.vec_id, round(greatest(0, {COSINE.format(a='e.embedding', b='q.embedding')}), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {COSINE.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 8")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    (row,) = e.where("vec_id = 7").select("embedding").limit(1).collect()
    return vectors.nearest_to(e, row.embedding, 8).select("vec_id", F.round("score", 4).alias("score"))


@query(
    "vector_topk_per_query",
    f"""
    SELECT query_id, vec_id, round(s, 4) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, greatest(0, {COSINE.format(a='e.embedding', b='q.embedding')}) AS s FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON e.vec_id <> q.vec_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 8
    """,
)
def vector_topk_per_query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest_per_query(e, e.where("vec_id % 20 = 0"), 8).withColumn("score", F.round("score", 4))


@query("graph_hit_scores", "SELECT event_id, round(greatest(0.4, 1 - 0.15 * d), 4) AS dependency, round(greatest(0.35, 0.9 - 0.08 * d), 4) AS chain FROM (SELECT event_id, 1 + user_id % 9 AS d FROM events)")
def graph_hit_scores(spark, sf_dir):
    d = F.col("user_id") % 9 + 1
    return table(spark, sf_dir, "events").select("event_id", F.round(retrieval.dependency_score(d), 4).alias("dependency"), F.round(retrieval.chain_score(d), 4).alias("chain"))


def sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    score = lambda n: ((F.col("n_chars") * n) % 100) / 100.0
    vector = d.where("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("content"), score(7).alias("score"))
    graph = d.where("doc_id % 2 = 0").select("doc_id", F.concat("source", "lang").alias("content"), score(3).alias("score"))
    return vector, graph


HYBRID = """
    SELECT coalesce(v.doc_id, g.doc_id) AS doc_id, CASE WHEN v.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN g.c ELSE coalesce(v.c, g.c) END AS content,
           CASE WHEN v.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN least(1.0, v.s * 0.55 + g.s * 0.45 + 0.15) ELSE coalesce(v.s * 0.55, g.s * 0.45) END AS score,
           CASE WHEN g.doc_id IS NULL THEN 'vector' WHEN v.doc_id IS NULL THEN 'graph' ELSE 'hybrid' END AS source
    FROM (SELECT doc_id, source AS c, (n_chars * 7 % 100) / 100.0::DOUBLE AS s FROM documents WHERE doc_id % 3 <> 0) v
    FULL JOIN (SELECT doc_id, source || lang AS c, (n_chars * 3 % 100) / 100.0::DOUBLE AS s FROM documents WHERE doc_id % 2 = 0) g ON v.doc_id = g.doc_id
"""


@query("hybrid_merge", f"SELECT doc_id, content, round(CAST(score AS DOUBLE), 4) AS score, source FROM ({HYBRID})")
def hybrid_merge(spark, sf_dir):
    return retrieval.merge_hits(*sides(spark, sf_dir), ["doc_id"]).withColumn("score", F.round("score", 4))


@query("rerank_blend", "SELECT doc_id, round(least(1.0, 0.4 * s + 0.6 * coalesce(CAST(quality AS DOUBLE), s)), 4) AS score FROM (SELECT doc_id, CAST(n_chars % 100 AS DOUBLE) / 100 AS s FROM documents) LEFT JOIN labels USING (doc_id) ORDER BY least(1.0, 0.4 * s + 0.6 * coalesce(CAST(quality AS DOUBLE), s)) DESC, doc_id LIMIT 50")
def rerank_blend(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("score"))
    judged = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("judgement"))
    return retrieval.rerank(hits, judged, "doc_id", 50).withColumn("score", F.round("score", 4))


@query(
    "citations",
    """
    SELECT doc_id, md5(CASE WHEN length(trim(text)) > 500 THEN substr(trim(text), 1, 500) || '…' ELSE trim(text) END) AS snippet, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 4 END AS start_line,
           CASE WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 4 END + greatest(1, length(text) - length(replace(text, chr(10), ''))) AS end_line, round(CAST(n_chars AS DOUBLE) / 20000, 3) AS score FROM documents
    """,
)
def citations(spark, sf_dir):
    cited = retrieval.citation(F.col("text"), F.col("doc_id") % 4, F.lit(0), F.col("n_chars") / 20000)
    return table(spark, sf_dir, "documents").select("doc_id", *cited).withColumn("snippet", F.md5("snippet"))


@query(
    "extractive_answer",
    """
    SELECT md5(string_agg('- ' || source || ': ' || substr(trim(text), 1, 240), chr(10) ORDER BY s DESC, source)) AS answer, round(least(0.75, avg(s)), 2) AS confidence
    FROM (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS source, text, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS s FROM documents ORDER BY s DESC, source LIMIT 3)
    """,
)
def extractive_answer(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), (F.col("n_chars") % 1000 / 1000.0).alias("score"))
    return retrieval.extractive(hits).withColumn("answer", F.md5("answer"))


@query("citation_dedupe", "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, substr(text, 1, 80), lang ORDER BY doc_id) = 1")
def citation_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.col("text").alias("snippet"), F.col("lang").alias("start_line"))
    return retrieval.distinct_citations(rows, "doc_id").select("doc_id", F.col("file").alias("source"), F.col("start_line").alias("lang"))


@query("citations_to_hits", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS score, 1 AS start_line FROM documents WHERE doc_id % 5 <> 0 AND trim(text) <> ''")
def citations_to_hits(spark, sf_dir):
    keep = lambda test, value: F.when(test, value)
    rows = table(spark, sf_dir, "documents").select("doc_id", keep(F.col("doc_id") % 2 != 0, F.col("source")).alias("source"), keep(F.col("doc_id") % 3 != 0, 0.9).alias("score"), F.lit(None).cast("int").alias("start_line"), keep(F.col("doc_id") % 5 != 0, F.col("text")).alias("snippet"))
    return retrieval.citations_to_hits(rows).select("doc_id", "source", "score", "start_line")


def has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def sql_count(*words: str) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


GRAPH_COUNT = sql_count("call chain", "calls", "dependency", "dependencies", "imports", "extends", "implements", "architecture", "layer", "relationship", "who calls", "what calls")
CONTENT_COUNT = sql_count("where is", "how does", "explain", "what is", "show me", "find", "configured", "implementation")
#: Turns as questions: few turns have words of questions, so every turn asks something.
QUESTION = """CASE turn % 6 WHEN 0 THEN 'Explain the call chain of `Page.load`, and what calls it: ' WHEN 1 THEN 'How does the project handle import of user_name? ' WHEN 2 THEN 'Which layer depends on OrderStore? ' WHEN 3 THEN 'Show me where is the BUG in the api route: ' WHEN 4 THEN 'what does it do' ELSE '' END || text"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(QUESTION).alias("text"))


@query("intent_heuristic", f"SELECT conv_id, turn, CASE WHEN g > c AND g >= 2 THEN 'graph' WHEN c > g AND c >= 2 THEN 'vector' ELSE 'hybrid' END AS strategy FROM (SELECT conv_id, turn, {GRAPH_COUNT} AS g, {CONTENT_COUNT} AS c FROM (SELECT conv_id, turn, {QUESTION} AS text FROM conversations))")
def intent_heuristic(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", T.strategy(F.col("text")).alias("strategy"))


#: All names of a question: capitalised words, back-ticked names, snake case; the first of each.
NAMES = f"""
    SELECT conv_id, turn, q, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS names
    FROM (SELECT conv_id, turn, lower(text) AS q, regexp_extract_all(text, '(^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)', 2) || regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_.]*)`', 1) || list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[a-z_][a-z0-9_]*_[a-z0-9_]+')) AS a
      FROM (SELECT conv_id, turn, {QUESTION} AS text FROM conversations))
"""


@query(
    "heuristic_plan",
    f"""
    SELECT conv_id, turn, array_to_string((CASE WHEN len(s) < 2 THEN ['search_graph'] || s WHEN NOT list_contains(s, 'search_code') THEN s || ['search_code'] ELSE s END)[1:6], ',') AS tools
    FROM (SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN ['search_code'] ELSE s END AS s FROM (SELECT conv_id, turn,
      CASE WHEN {has("how does this project", "how does the project", "how this project", "how it work", "what is this project", "what does this project", "project work", "overview", "how does this repo", "how does this app")} THEN ['generate_architecture', 'trace_request_flow', 'search_code'] ELSE [] END
      || CASE WHEN {has("architecture", "layer", "structure")} THEN ['generate_architecture'] ELSE [] END
      || CASE WHEN {has("call chain", "request flow", "endpoint", "route", "api")} THEN ['trace_request_flow'] ELSE [] END
      || CASE WHEN {has("depend", "import", "uses")} AND len(names) > 0 THEN ['analyze_dependency'] ELSE [] END
      || CASE WHEN {has("bug", "issue", "smell", "vulnerability", "anti-pattern")} THEN ['find_bug_patterns'] ELSE [] END
      || CASE WHEN {has("explain", "how does", "what does")} AND len(names) > 0 THEN ['explain_function'] ELSE [] END AS s FROM ({NAMES})))
    """,
)
def heuristic_plan(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", F.array_join(T.plan_tools(F.col("text")), ",").alias("tools"))


@query("symbol_candidates", f"SELECT conv_id, turn, array_to_string(names[1:8], ',') AS symbols FROM ({NAMES})")
def symbol_candidates(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", F.array_join(T.symbol_candidates(F.col("text")), ",").alias("symbols"))


#: Texts with one of the suspect forms each.
CODE = """CASE doc_id % 6 WHEN 0 THEN 'try: x' || chr(10) || 'except :' || chr(10) WHEN 1 THEN 'except ValueError as e:  pass ' WHEN 2 THEN 'catch (Error e) {{ }}' WHEN 3 THEN 'passing except: pass ' ELSE '' END || replace(text, 'token = ', 'secret = ') || CASE WHEN doc_id % 7 = 0 THEN ' todo ' ELSE '' END""".replace("{{", "{").replace("}}", "}")


@query(
    "bug_patterns",
    f"""
    SELECT doc_id, CASE WHEN regexp_matches(text, 'except\\s*:\\s*\\n') THEN 'bare_except' WHEN regexp_matches(text, 'except[^:\\n]+:\\s*pass($|[^A-Za-z0-9_])') THEN 'swallowed_exception' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(TODO|FIXME|HACK|XXX)($|[^A-Za-z0-9_])') THEN 'todo_fixme'
      WHEN regexp_matches(text, '(?i)(api[_-]?key|password|secret)\\s*=\\s*[''"][^''"]+[''"]') THEN 'hardcoded_secret' WHEN regexp_matches(text, 'catch\\s*\\([^)]*\\)\\s*[{{]\\s*[}}]') THEN 'empty_catch' END AS pattern FROM (SELECT doc_id, {CODE} AS text FROM documents)
    """,
)
def bug_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(CODE.replace("chr(10)", "char(10)")).alias("text"))
    return rows.select("doc_id", T.first_bug_pattern(F.col("text")).alias("pattern"))


@query("conversation_last_n", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def conversation_last_n(spark, sf_dir):
    return retrieval.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query("prompt_assembly", "SELECT conv_id, md5(string_agg(role || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn)) AS prompt FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id")
def prompt_assembly(spark, sf_dir):
    return retrieval.prompt(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("prompt", F.md5("prompt"))


@query("reasoning_summary", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 1 ELSE 0 END DESC, turn DESC) = 1")
def reasoning_summary(spark, sf_dir):
    rows = retrieval.last_matching(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant")
    return rows.select("conv_id", "turn")


@query(
    "follow_ups",
    """
    SELECT doc_id, array_to_string(list_filter([CASE WHEN n AND p THEN 'Walk me through `' || lang || '` from `' || source || '`' END, CASE WHEN n AND p THEN 'Where is `' || lang || '` called from?' END, CASE WHEN p AND NOT n THEN 'Which parts does `' || source || '` define?' END,
      CASE WHEN n AND NOT p THEN 'Say more about `' || lang || '`' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 <> 0 THEN 'How is this repository built up?' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 NOT IN (1, 2) THEN 'Which endpoints does it offer?' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 <> 3 THEN 'What does `r` rest on?' END,
      'Show me the code of `' || lang || '` in `' || source || '`', 'What should I read next?'], lambda x: x IS NOT NULL AND NOT (doc_id % 5 = 0 AND starts_with(x, 'Walk')))[1:5], '|') AS questions
    FROM (SELECT *, doc_id % 3 <> 0 AS n, doc_id % 4 <> 0 AS p FROM documents)
    """,
)
def follow_ups(spark, sf_dir):
    """Languages as names and sources as paths, now and then missing; every fifth question was asked already, others have words of the questions."""
    name, path = F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    word = F.element_at(F.array(*map(F.lit, ["ARCHITECTURE?", "an endpoint", "the Api", "Dependencies", "", "", ""])), (F.col("doc_id") % 7 + 1).cast("int"))
    asked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("walk me through `"), "lang", F.lit("` from `"), "source", F.lit("` "))).otherwise(word)
    cited = F.array(F.struct(F.col("lang").alias("name"), F.col("source").alias("path")), F.struct(F.col("lang").alias("name"), F.lit("").alias("path")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(retrieval.follow_ups(asked, name, path, F.lit("r"), cited), "|").alias("questions"))


@query(
    "vector_hits",
    """
    SELECT 'vector::' || doc_id AS hit_id, 'vector' AS source, CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS file, text AS content, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE doc_id / 10000 END::DOUBLE AS score, CASE WHEN doc_id % 3 <> 0 THEN lang END AS function_name,
      CAST(NULL AS VARCHAR) AS class_name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE trim(lang) END AS symbol, 'function' AS chunk_type, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS INTEGER) AS start_line, CAST(n_chars AS INTEGER) AS end_line FROM documents
    """,
)
def vector_hits(spark, sf_dir):
    """Documents as stored vectors whose metadata is blank or missing now and then."""
    n = F.col("doc_id")
    return retrieval.shaped_hits(table(spark, sf_dir, "documents").select(
        n.alias("id"), F.col("text").alias("document"), F.when(n % 4 != 0, n / 10000).alias("score"), F.when(n % 6 != 0, F.col("source")).alias("file"), F.when(n % 3 == 0, "  ").otherwise(F.col("lang")).alias("function"), F.lit("").alias("class"),
        F.when(n % 5 != 0, F.concat(F.lit(" "), "lang", F.lit(" "))).alias("symbol"), F.lit("function").alias("type"), F.when(n % 2 == 0, n).alias("start_line"), F.col("n_chars").alias("end_line"),
    ))


@query(
    "json_repair",
    "SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE props END AS json, CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events",
)
def json_repair(spark, sf_dir):
    """Properties of events within fences, prose and broken objects."""
    n, props = F.col("event_id"), F.col("props")
    answer = (
        F.when(n % 5 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n % 5 == 2, F.concat(F.lit("Here you are: "), props, F.lit(' and {"z": 0}.'))).when(n % 5 == 3, "Nothing.")
        .when(n % 5 == 4, F.concat(F.lit("{broken "), props, F.lit("}"))).otherwise(props)
    )
    found = T.repaired_json(answer)
    return table(spark, sf_dir, "events").select("event_id", found.alias("json"), F.get_json_object(found, "$.k").cast("int").alias("k"))


@query(
    "answer_references",
    """
    SELECT doc_id, md5(trim(text, ' ') || CASE WHEN contains(text, source) OR contains(text, 'x') THEN '' ELSE chr(10) || chr(10) || '**Files referenced:** `' || source || '`, `x`' END || CASE WHEN doc_id % 2 = 0 OR contains(text, lang || '_') THEN '' ELSE chr(10) || chr(10) || '**Functions referenced:** `' || lang || '_`' END) AS answer FROM documents WHERE trim(text, ' ') <> ''
    """,
)
def answer_references(spark, sf_dir):
    """Documents as answers that name their source or not."""
    names = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("lang", F.lit("_"))))
    answer = T.with_references(F.col("text"), F.array(F.col("source"), F.lit("x")), names)
    return table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", F.md5(answer).alias("answer"))


@query(
    "compact_numbers",
    """
    WITH o AS (SELECT o_orderkey, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 100000 END AS v FROM orders),
    p AS (SELECT *, CASE WHEN abs(v) >= 999950000000 THEN 4 WHEN abs(v) >= 999950000 THEN 3 WHEN abs(v) >= 999950 THEN 2 WHEN abs(v) >= 999.95 THEN 1 ELSE 0 END AS k FROM o), r AS (SELECT *, round(v / pow(1000.0, k), 1) AS s FROM p)
    SELECT o_orderkey, CASE WHEN s = round(s) THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE printf('%.1f', s) END || ['', 'K', 'M', 'B', 'T'][k + 1] AS price FROM r
    """,
)
def compact_numbers(spark, sf_dir):
    scale = F.element_at(F.array(F.lit(0.001), F.lit(1.0), F.lit(1000.0), F.lit(100000.0)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.compact(F.col("o_totalprice").cast("double") * scale).alias("price"))


@query("name_initials", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || 'C' AS initials FROM customer")
def name_initials(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.initials(F.concat_ws("/ ", "c_mktsegment", "c_name")).alias("initials"))


@query("evidence_blocks", "SELECT source, md5(string_agg(substr(text, 1, 600), chr(10) ORDER BY doc_id)) AS block FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4) GROUP BY source")
def evidence_blocks(spark, sf_dir):
    top = ranking.top_per_key(table(spark, sf_dir, "documents"), ["source"], [F.col("doc_id")], 4)
    lines = F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 600).alias("t"))))
    return top.groupBy("source").agg(F.md5(F.array_join(F.transform(lines, lambda x: x["t"]), "\n")).alias("block"))


@query("context_blocks", "SELECT doc_id, md5('[' || CAST(doc_id AS VARCHAR) || '] ' || source || chr(10) || substr(text, 1, 1200)) AS block FROM documents")
def context_blocks(spark, sf_dir):
    block = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "source", F.lit("\n"), F.substring("text", 1, 1200))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(block).alias("block"))


@query("meta_slug", "SELECT page_id, split_part(slug, '__', 1) AS owner, split_part(slug, '__', 2) AS name, replace(slug, '__', '/') AS repo FROM (SELECT page_id, replace(regexp_extract(url, '://([^/]*/[a-z]+)', 1), '/', '__') AS slug FROM pages)")
def meta_slug(spark, sf_dir):
    slug = F.replace(F.regexp_extract("url", "://([^/]*/[a-z]+)", 1), F.lit("/"), F.lit("__"))
    rows = table(spark, sf_dir, "pages").select("page_id", slug.alias("slug"))
    return rows.select("page_id", F.split_part("slug", F.lit("__"), F.lit(1)).alias("owner"), F.split_part("slug", F.lit("__"), F.lit(2)).alias("name"), F.replace("slug", F.lit("__"), F.lit("/")).alias("repo"))
