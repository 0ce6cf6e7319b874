"""Orders as source files: the analytics report, chunks and the graph of a whole repository.

An order is a file, its lines are functions named after parts, every tenth order has a class
with one method, every seventh an endpoint; functions call functions named after suppliers,
and files import a library and the file of the next order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import chunks, graph, report
from graphloom.plans.registry import Registry
from graphloom.session import stage, table

registry = query = Registry()

SYMBOL = "struct<name:string,start_line:int,end_line:int>"


def _orders(spark, sf_dir, *more) -> DataFrame:
    """Orders that have lines, with the fields of parsed files, and what `more` gathers from their lines."""
    n = F.col("l_linenumber") * 10
    end = n + (F.col("l_quantity") % 8).cast("int")
    name = F.concat(F.lit("part_"), (F.col("l_partkey") % 97).cast("string"))
    function = F.struct(name.alias("name"), n.cast("int").alias("start_line"), end.cast("int").alias("end_line"))
    call = F.struct(name.alias("caller"), F.concat(F.lit("part_"), (F.col("l_suppkey") % 97).cast("string")).alias("callee"), F.lit(None).cast("string").alias("receiver"))
    gathered = (F.array_sort(F.collect_list(function)).alias("functions"), F.array_sort(F.collect_list(call)).alias("calls"), F.max(end).cast("int").alias("lines"))
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*gathered, *more)
    key = F.col("o_orderkey").cast("string")
    path = F.concat(F.lit("src/p"), F.substring("o_orderpriority", 1, 1), F.lit("/o"), key, F.lit(".py"))
    none = F.array().cast("array<string>")
    a_class = F.struct(
        F.concat(F.lit("C"), key).alias("name"), F.array(F.struct(F.concat(F.lit("m_"), (F.col("o_custkey") % 13).cast("string")).alias("name"), F.lit(2).alias("start_line"), F.lit(6).alias("end_line"))).alias("methods"),
        none.alias("bases"), none.alias("implements"), F.lit(1).alias("start_line"), F.lit(6).alias("end_line"),
    )
    endpoint = F.struct(F.concat(F.lit("/r"), key).alias("route"), F.lit("GET").alias("method"), F.concat(F.lit("part_"), (F.col("o_orderkey") % 97).cast("string")).alias("handler"))
    outside = F.struct(F.concat(F.lit("lib"), (F.col("o_custkey") % 50).cast("string"), F.lit(".api")).alias("module"), none.alias("names"), F.lit(True).alias("is_external"))
    inside = F.struct(F.concat(F.lit("src.p1.o"), (F.col("o_orderkey") + 1).cast("string")).alias("module"), none.alias("names"), F.lit(False).alias("is_external"))
    size = F.size("functions")
    some = lambda test, x: F.filter(F.array(x), lambda _: test)
    return table(spark, sf_dir, "orders").join(by, "o_orderkey").withColumns({
        "file": path, "language": F.col("o_orderstatus"), "classes": some(F.col("o_orderkey") % 10 == 0, a_class),
        "imports": F.array(outside, inside), "api_endpoints": some(F.col("o_orderkey") % 7 == 0, endpoint),
        "metadata": F.struct(F.when(size <= 2, "low").when(size <= 4, "medium").otherwise("high").alias("complexity"), F.col("lines")),
    })


FIELDS = ("file", "language", "functions", "classes", "imports", "api_endpoints", "calls", "metadata")


def parsed_orders(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).select(*FIELDS)


#: Files (file, language, complexity, lines), functions and methods as SQL.
SQL = """
    WITH l AS (SELECT l_orderkey AS k, 'part_' || CAST(l_partkey % 97 AS VARCHAR) AS name, 'part_' || CAST(l_suppkey % 97 AS VARCHAR) AS callee, CAST(l_linenumber * 10 AS INTEGER) AS a, CAST(l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 8 AS INTEGER) AS b FROM lineitem),
    p AS (SELECT o_orderkey AS k, 'src/p' || substr(o_orderpriority, 1, 1) || '/o' || CAST(o_orderkey AS VARCHAR) || '.py' AS file, o_orderstatus AS language, o_custkey, CASE WHEN count(*) <= 2 THEN 'low' WHEN count(*) <= 4 THEN 'medium' ELSE 'high' END AS complexity, max(b) AS lines, count(*) AS n FROM orders JOIN l ON l.k = o_orderkey GROUP BY ALL),
    f AS (SELECT file, name, 'function' AS kind, a, b, callee FROM l JOIN p USING (k)),
    m AS (SELECT file, 'C' || CAST(k AS VARCHAR) AS class, 'm_' || CAST(o_custkey % 13 AS VARCHAR) AS name, 2 AS a, 6 AS b FROM p WHERE k % 10 = 0),
    s AS (SELECT file, name, kind, a, b, b - a + 1 AS lines FROM f UNION ALL SELECT file, name, 'method', a, b, 5 FROM m)
"""
CLUSTERS = "SELECT substr(sha1(regexp_replace(name, '[^a-z0-9]', '', 'g') || '|' || kind || ':' || CAST(lines AS VARCHAR)), 1, 12) AS fingerprint, count(*) AS size FROM s WHERE lines >= 4 GROUP BY 1 HAVING count(*) >= 2"


@query("report_summary", SQL + f"SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, (SELECT count(*) FROM s) AS functions, (SELECT count(*) FROM m) AS classes, count(*) FILTER (WHERE k % 7 = 0) AS endpoints, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM ({CLUSTERS})) AS duplicates FROM p")
def report_summary(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["summary"]


@query("report_languages", SQL + "SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(100.0 * sum(lines) / sum(sum(lines)) OVER (), 1) AS pct FROM p GROUP BY language")
def report_languages(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["languages"]


@query("report_complexity", SQL + "SELECT level, count(k) AS files FROM (VALUES ('low'), ('medium'), ('high')) v(level) LEFT JOIN p ON complexity = level GROUP BY level")
def report_complexity(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["complexity"]


WEIGHT = "CASE complexity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END"


@query("report_heatmap", SQL + f"SELECT file, regexp_extract(file, '^(.*)/', 1) AS directory, lines, w AS score, round(least(1.0, w * log10(lines + 10) / 30), 6) AS intensity FROM (SELECT *, {WEIGHT} AS w FROM p) ORDER BY w * lines DESC, file LIMIT 80")
def report_heatmap(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["heatmap"].withColumn("intensity", F.round("intensity", 6))


@query("report_largest", SQL + "SELECT file, name, kind, lines FROM s ORDER BY lines DESC, file, a, name LIMIT 1")
def report_largest(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["largest_symbol"].select("file", "name", "kind", "lines")


@query("report_duplicates", SQL + f"SELECT fingerprint, size, CAST(round(0.72 + least(0.25, 0.03 * size), 4) AS DOUBLE) AS similarity FROM ({CLUSTERS}) ORDER BY size DESC, fingerprint LIMIT 12")
def report_duplicates(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["duplicates"].select("fingerprint", "size", F.round("similarity", 4).alias("similarity"))


@query("report_dead_code", SQL + "SELECT file, name, kind, lines FROM s WHERE name NOT IN (SELECT callee FROM f) AND name NOT IN (SELECT 'part_' || CAST(k % 97 AS VARCHAR) FROM p WHERE k % 7 = 0) ORDER BY lines DESC, file, a LIMIT 20")
def report_dead_code(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["dead_code"].select("file", "name", "kind", "lines")


@query("report_imports", SQL + "SELECT source, target FROM (SELECT file AS source, 'ext:lib' || CAST(o_custkey % 50 AS VARCHAR) AS target FROM p UNION SELECT a.file, b.file FROM p a JOIN p b ON b.file = 'src/p1/o' || CAST(a.k + 1 AS VARCHAR) || '.py') ORDER BY source, target LIMIT 60")
def report_imports(spark, sf_dir):
    return report.report(parsed_orders(spark, sf_dir))["imports"]


def sources(parsed: DataFrame) -> DataFrame:
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.col("metadata.lines")), lambda i: F.concat(F.lit("x = "), i.cast("string"))), "\n")
    return parsed.select("file", content.alias("content"))


@query(
    "code_chunks",
    SQL
    + """
    , c AS (SELECT file, 'function' AS kind, name AS symbol, a, b FROM f UNION ALL SELECT file, 'class', class, 1, 6 FROM m),
    free AS (SELECT file, i FROM (SELECT file, unnest(generate_series(1, lines)) AS i FROM p) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file = x.file AND x.i BETWEEN c.a AND c.b)),
    runs AS (SELECT file, min(i) AS a, max(i) AS b FROM (SELECT file, i, i - row_number() OVER (PARTITION BY file ORDER BY i) AS g FROM free) GROUP BY file, g)
    SELECT file, kind, symbol, a AS start_line, b AS end_line FROM c UNION ALL SELECT file, 'module', NULL, a, b FROM runs WHERE b - a + 1 >= 3
    """,
)
def code_chunks(spark, sf_dir):
    parsed = stage(parsed_orders(spark, sf_dir), "parsed")
    return chunks.semantic_chunks(parsed, sources(parsed)).select("file", "kind", "symbol", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def linked_files(spark, sf_dir) -> DataFrame:
    """The same files with imported names, receivers, bases, interfaces and tables.

    Two imports bind a name, of which the later one counts; every fourth call goes to a method of a class, every
    fourth to an imported name, every fourth has itself as the receiver."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ten = key - key % 10
    calls = F.collect_list(F.struct(
        text("part_", F.col("l_partkey") % 97).alias("caller"),
        F.when(F.col("l_suppkey") % 4 == 0, text("m_", F.col("l_suppkey") % 13)).when(F.col("l_suppkey") % 4 == 1, text("ext_", F.col("l_suppkey") % 50)).otherwise(text("part_", F.col("l_suppkey") % 97)).alias("callee"),
        F.when(F.col("l_suppkey") % 4 == 0, text("C", F.col("l_orderkey") - F.col("l_orderkey") % 10)).when(F.col("l_suppkey") % 4 == 2, "self").alias("receiver"),
    )).alias("linked")
    names = lambda *x: F.array(*x).cast("array<string>")
    name = lambda n: text("ext_", n % 50)
    module = lambda m, n, e: F.struct(m.alias("module"), n.alias("names"), F.lit(e).alias("is_external"))
    imports = F.array(
        module(text("lib", cust % 50, ".api"), names(name(cust), name(cust + 1)), True), module(text("lib", cust % 20, ".core"), names(name(cust)), True),
        module(text("src.p1.o", key + 1), names(text("C", ten), F.lit("nosuch")), False), module(text("lib", (cust + 3) % 50, ".api"), names(F.lit("nothing")), False),
    )
    with_bases = F.transform("classes", lambda c: c.withField("bases", names(text("C", key - 10), F.lit("Outer"))).withField("implements", names(text("C", key - 20))))
    files = _orders(spark, sf_dir, calls).where("file is not null")
    return files.withColumns({"imports": imports, "classes": with_bases, "calls": F.col("linked")}).select("o_orderkey", *FIELDS)


def linked_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Linked files and their sources."""
    parsed = stage(linked_files(spark, sf_dir), "linked", freed=True)
    key = F.col("o_orderkey")
    tab = text("tab_", key % 30)
    line = (
        lambda i: F.when((i == 1) & (key % 10 == 0), text("class C", key, "(Base):"))
        .when((i == 2) & (key % 20 == 0), text('__tablename__ = "', tab, '"'))
        .when((i == 4) & (key % 10 == 0), text("self.save(C", key, ", ", tab, ")"))
        .when((i % 20 == 0) & (key % 20 == 0), text("db.query(", tab, ")"))
        .when((i % 10 == 0) & (key % 20 == 0), text("db.add(", tab, ")"))
        .otherwise(text("x = ", i))
    )
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.col("metadata.lines")), line), "\n")
    return parsed.drop("o_orderkey"), parsed.select("file", content.alias("content"))


#: Symbols, tables and libraries of the linked files.
LINKED = (
    SQL
    + """
    , g AS (SELECT DISTINCT file, name, 'Function::r::' || file || '::' || name AS id FROM f),
    c AS (SELECT file, class, 'Class::r::' || file || '::' || class AS id FROM m), d AS (SELECT file, class, name, 'Method::r::' || file || '::' || class || '::' || name AS id FROM m),
    sym AS (SELECT id, name, name AS qualified, file, 'Function' AS kind FROM g UNION ALL SELECT id, class, class, file, 'Class' FROM c UNION ALL SELECT id, name, class || '.' || name, file, 'Method' FROM d),
    libs AS (SELECT DISTINCT 'lib' || CAST(o_custkey % 50 AS VARCHAR) || '.api' AS module FROM p UNION SELECT DISTINCT 'lib' || CAST(o_custkey % 20 AS VARCHAR) || '.core' FROM p),
    tabs AS (SELECT file, 'tab_' || CAST(k % 30 AS VARCHAR) AS t FROM p WHERE k % 20 = 0 AND lines >= 2 UNION ALL SELECT file, 'c' || CAST(k AS VARCHAR) FROM p WHERE k % 10 = 0)
"""
)


@query(
    "graph_build_nodes",
    LINKED
    + """
    SELECT 'Repository::r' AS id, 'Repository' AS label, 'r' AS name, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS qualified, 'r' AS repo_id
    UNION ALL SELECT 'File::r::' || file, 'File', NULL, file, NULL, 'r' FROM p UNION ALL SELECT id, kind, name, file, qualified, 'r' FROM sym
    UNION ALL SELECT 'ApiEndpoint::r::GET::/r' || CAST(k AS VARCHAR), 'ApiEndpoint', NULL, file, NULL, 'r' FROM p WHERE k % 7 = 0
    UNION ALL SELECT 'DatabaseTable::' || t, 'DatabaseTable', t, max(file), NULL, 'r' FROM tabs GROUP BY t UNION ALL SELECT 'ExternalLibrary::' || module, 'ExternalLibrary', module, NULL, NULL, NULL FROM libs
    """,
)
def graph_build_nodes(spark, sf_dir):
    return graph.build(*linked_orders(spark, sf_dir), "r")[0]


@query(
    "graph_build_edges",
    LINKED
    + """
    , lined AS (SELECT l_orderkey AS k, p.file, o_custkey, 'part_' || CAST(l_partkey % 97 AS VARCHAR) AS caller, l_suppkey % 4 AS w, l_suppkey AS n FROM lineitem JOIN p ON p.k = l_orderkey),
    ali AS (SELECT file, 'ext_' || CAST(o_custkey % 50 AS VARCHAR) AS name, 'lib' || CAST(o_custkey % 20 AS VARCHAR) || '.core' AS module FROM p UNION ALL SELECT file, 'ext_' || CAST((o_custkey + 1) % 50 AS VARCHAR), 'lib' || CAST(o_custkey % 50 AS VARCHAR) || '.api' FROM p),
    refs AS (
      SELECT 'Function::r::' || file || '::' || caller AS src, 'CALLS' AS type, file, CASE w WHEN 0 THEN 'C' || CAST(k - k % 10 AS VARCHAR) END AS receiver,
        CASE w WHEN 0 THEN 'm_' || CAST(n % 13 AS VARCHAR) WHEN 1 THEN 'ext_' || CAST(n % 50 AS VARCHAR) ELSE 'part_' || CAST(n % 97 AS VARCHAR) END AS name FROM lined
      UNION SELECT 'ApiEndpoint::r::GET::/r' || CAST(k AS VARCHAR), 'CALLS', file, NULL, 'part_' || CAST(k % 97 AS VARCHAR) FROM p WHERE k % 7 = 0
      UNION SELECT 'Class::r::' || file || '::C' || CAST(k AS VARCHAR), 'EXTENDS', file, NULL, 'C' || CAST(k - 10 AS VARCHAR) FROM p WHERE k % 10 = 0
      UNION SELECT 'Class::r::' || file || '::C' || CAST(k AS VARCHAR), 'IMPLEMENTS', file, NULL, 'C' || CAST(k - 20 AS VARCHAR) FROM p WHERE k % 10 = 0
      UNION SELECT 'File::r::' || file, 'IMPORTS', file, NULL, 'C' || CAST(k - k % 10 AS VARCHAR) FROM p),
    found AS (SELECT DISTINCT refs.src, refs.type, coalesce(q.id, h.id, a.id, CASE WHEN refs.type = 'CALLS' THEN 'ExternalLibrary::' || ali.module END) AS dst FROM refs
      LEFT JOIN (SELECT qualified, min(id) AS id FROM sym GROUP BY 1) q ON q.qualified = refs.receiver || '.' || refs.name
      LEFT JOIN (SELECT file, name, arg_min(id, (CASE kind WHEN 'Method' THEN 0 ELSE 1 END, id)) AS id FROM sym GROUP BY 1, 2) h ON h.file = refs.file AND h.name = refs.name
      LEFT JOIN (SELECT name, arg_min(id, (CASE kind WHEN 'Method' THEN 0 ELSE 1 END, id)) AS id FROM sym GROUP BY 1) a ON a.name = refs.name
      LEFT JOIN ali ON ali.file = refs.file AND ali.name = refs.name),
    body AS (SELECT f.file, 'Function::r::' || f.file || '::' || f.name AS id, unnest(generate_series(a, b)) AS i FROM f WHERE EXISTS (SELECT 1 FROM p WHERE p.file = f.file AND k % 20 = 0)),
    acc AS (SELECT body.id, CASE WHEN i % 20 = 0 THEN 'READS_FROM' ELSE 'WRITES_TO' END AS type, 'DatabaseTable::tab_' || CAST(k % 30 AS VARCHAR) AS dst FROM body JOIN p ON p.file = body.file WHERE i % 10 = 0 AND i <= lines
      UNION SELECT d.id, 'WRITES_TO', 'DatabaseTable::' || t FROM d JOIN p ON p.file = d.file JOIN tabs ON tabs.file = d.file WHERE lines >= 4
      UNION SELECT c.id, 'WRITES_TO', 'DatabaseTable::c' || CAST(k AS VARCHAR) FROM c JOIN p ON p.file = c.file)
    SELECT 'Repository::r' AS src, 'DEFINES' AS type, 'File::r::' || file AS dst FROM p UNION ALL SELECT 'File::r::' || file, 'DEFINES', id FROM g UNION ALL SELECT 'File::r::' || file, 'DEFINES', id FROM c
    UNION ALL SELECT 'Class::r::' || file || '::' || class, 'DEFINES', id FROM d UNION ALL SELECT 'File::r::' || file, 'DEFINES', 'ApiEndpoint::r::GET::/r' || CAST(k AS VARCHAR) FROM p WHERE k % 7 = 0
    UNION ALL SELECT 'File::r::' || file, 'DEFINES', 'DatabaseTable::' || t FROM tabs
    UNION ALL SELECT DISTINCT * FROM (SELECT 'File::r::' || file, 'IMPORTS', 'ExternalLibrary::lib' || CAST(unnest([o_custkey % 50, (o_custkey + 3) % 50]) AS VARCHAR) || '.api' FROM p
      UNION ALL SELECT 'File::r::' || file, 'IMPORTS', 'ExternalLibrary::lib' || CAST(o_custkey % 20 AS VARCHAR) || '.core' FROM p) t(src, type, dst) WHERE replace(dst, 'ExternalLibrary::', '') IN (SELECT module FROM libs)
    UNION ALL SELECT * FROM found WHERE dst IS NOT NULL UNION ALL SELECT * FROM acc
    """,
)
def graph_build_edges(spark, sf_dir):
    """All kinds of edges: names of classes and their methods, of imports and of libraries, tables by file."""
    return graph.build(*linked_orders(spark, sf_dir), "r")[1]


@query(
    "imports_context",
    SQL
    + """
    SELECT file, 'from lib' || CAST(o_custkey % 50 AS VARCHAR) || '.api import ext_' || CAST(o_custkey % 50 AS VARCHAR) || ', ext_' || CAST((o_custkey + 1) % 50 AS VARCHAR) || chr(10) || 'from lib' || CAST(o_custkey % 20 AS VARCHAR) || '.core import ext_' || CAST(o_custkey % 50 AS VARCHAR) || chr(10)
      || 'from src.p1.o' || CAST(k + 1 AS VARCHAR) || ' import C' || CAST(k - k % 10 AS VARCHAR) || ', nosuch' || chr(10) || 'from lib' || CAST((o_custkey + 3) % 50 AS VARCHAR) || '.api import nothing' AS context FROM p
    """,
)
def imports_context(spark, sf_dir):
    return linked_orders(spark, sf_dir)[0].select("file", T.imports_text(F.col("imports")).alias("context"))


@query(
    "parsed_chunks",
    SQL
    + """
    , c AS (SELECT file, language, 'function' AS kind, name AS symbol, a, b FROM f JOIN p USING (file) UNION ALL SELECT m.file, language, CASE WHEN k % 20 = 0 THEN 'method' ELSE 'class' END, CASE WHEN k % 20 = 0 THEN class || '.' || name ELSE class END, CASE WHEN k % 20 = 0 THEN 2 ELSE 1 END, 6 FROM m JOIN p USING (file))
    SELECT c.file, c.language, kind, symbol, a AS start_line, b AS end_line, coalesce((SELECT string_agg('x = ' || i, chr(10) ORDER BY i) FROM (SELECT unnest(range(a, least(b, lines) + 1)) AS i)), '') AS content FROM c JOIN p ON p.file = c.file
    """,
)
def parsed_chunks(spark, sf_dir):
    """Every second class has no methods."""
    parsed = stage(parsed_orders(spark, sf_dir), "parsed")
    # the number of an order stands at the end of its file's name
    key = F.regexp_extract("file", r"(\d+)\.py$", 1).cast("long")
    bare = F.transform("classes", lambda c: c.withField("methods", F.filter(c["methods"], lambda _: key % 20 == 0)))
    return chunks.parsed_chunks(parsed.withColumn("classes", bare), sources(parsed))
