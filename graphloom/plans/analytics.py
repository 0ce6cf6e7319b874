"""Reports over documents, parts, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import ranking
from graphloom.operators.analysis import dead_symbols, file_tree, find_file
from graphloom.operators.diagrams import circle
from graphloom.operators.vectors import flat_metadata
from graphloom.plans.registry import Registry
from graphloom.session import table
from graphloom.sources.cache import still_valid
from graphloom.sources.repository import owner_and_name

registry = query = Registry()

LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END END"
LABEL = f"CASE WHEN {LINES} <= 5 THEN 'low' WHEN {LINES} <= 12 THEN 'medium' ELSE 'high' END"
WEIGHT = f"CASE WHEN {LINES} <= 5 THEN 3 WHEN {LINES} <= 12 THEN 8 ELSE 15 END"
LINES = LINES.replace("suffix(", "ends_with(")
LABEL, WEIGHT = LABEL.replace("suffix(", "ends_with("), WEIGHT.replace("suffix(", "ends_with(")


def measured(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.line_count(F.col("text")).alias("lines"))
    label = T.complexity_label(F.col("lines"))
    return docs.withColumn("complexity", label).withColumn("weight", T.complexity_weight(F.col("complexity")))


@query(
    "language_distribution",
    """
    SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars,
           round(100.0 * sum(n_chars) / sum(sum(n_chars)) OVER (), 1) AS pct
    FROM documents GROUP BY lang
    """,
)
def language_distribution(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    return ranking.share(by, "chars", "pct")


@query("primary_language", "SELECT lang, files FROM (SELECT lang, count(*) AS files FROM documents GROUP BY lang) ORDER BY files DESC, lang LIMIT 1")
def primary_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lang").limit(1)


@query("line_count", f"SELECT doc_id, CAST({LINES} AS BIGINT) AS lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("lines"))


@query(
    "complexity_histogram",
    f"""
    SELECT v.level, count(d.label) AS files FROM (VALUES ('low'), ('medium'), ('high')) v(level)
    LEFT JOIN (SELECT {LABEL} AS label FROM documents) d ON d.label = v.level GROUP BY v.level
    """,
)
def complexity_histogram(spark, sf_dir):
    levels = spark.createDataFrame([("low",), ("medium",), ("high",)], "level string")
    counts = measured(spark, sf_dir).groupBy(F.col("complexity").alias("level")).agg(F.count("*").alias("n"))
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("files"))


@query(
    "heatmap_top80",
    f"""
    SELECT doc_id, source, CAST(w * l AS BIGINT) AS heat, round(least(1.0, w * log10(l + 10) / 30), 6) AS intensity
    FROM (SELECT doc_id, source, {WEIGHT} AS w, {LINES} AS l FROM documents) ORDER BY heat DESC, doc_id LIMIT 80
    """,
)
def heatmap_top80(spark, sf_dir):
    w, lines = F.col("weight"), F.col("lines")
    cells = measured(spark, sf_dir).select("doc_id", "source", (w * lines).cast("long").alias("heat"), F.round(F.least(F.lit(1.0), w * F.log10(lines + 10) / 30), 6).alias("intensity"))
    return cells.orderBy(F.desc("heat"), "doc_id").limit(80)


@query(
    "most_complex_per_source",
    f"""
    SELECT source, doc_id, heat FROM (SELECT source, doc_id, CAST({WEIGHT} * greatest({LINES}, 1) AS BIGINT) AS heat FROM documents)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY heat DESC, doc_id) = 1
    """,
)
def most_complex_per_source(spark, sf_dir):
    rows = measured(spark, sf_dir).select("source", "doc_id", (F.col("weight") * F.greatest("lines", F.lit(1))).cast("long").alias("heat"))
    return ranking.top_per_key(rows, ["source"], [F.desc("heat"), F.col("doc_id")])


@query("largest_symbol", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def largest_symbol(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(1)


FINGERPRINT = "substr(sha1(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '|' || 'part' || ':' || CAST(p_size AS VARCHAR)), 1, 12)"


@query("fingerprint", f"SELECT p_partkey, {FINGERPRINT} AS fingerprint FROM part")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.fingerprint(F.col("p_name"), F.lit("part"), F.col("p_size")).alias("fingerprint"))


@query(
    "duplicate_clusters",
    """
    WITH f AS (SELECT doc_id, md5(lower(text)) AS fp FROM documents),
    r AS (SELECT *, count(*) OVER (PARTITION BY fp) AS size, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS n FROM f)
    SELECT fp, size, round(0.72 + least(0.25, 0.03 * size), 4) AS similarity, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members
    FROM r WHERE size >= 2 AND n <= 6 GROUP BY fp, size
    """,
)
def duplicate_clusters(spark, sf_dir):
    prints = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text")).alias("fp"))
    return ranking.clusters(prints, "fp", "doc_id")


@query("dead_nodes_anti_join", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def dead_nodes_anti_join(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ranking.missing(table(spark, sf_dir, "orders").select("o_orderkey"), seen, "o_orderkey")


@query(
    "dead_code",
    """
    SELECT o_orderkey, o_orderpriority AS name FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AND o_orderstatus <> 'F'
    """,
)
def dead_code(spark, sf_dir):
    """Orders without lines, as symbols without callers; orders of one status, as handlers, are exempt."""
    symbols = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.lit("function").alias("kind"), "o_orderstatus")
    called = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return dead_symbols(symbols, called, symbols.where("o_orderstatus = 'F'").select("key"), on="key").select("o_orderkey", "name")


@query(
    "summary_counters",
    """
    SELECT count(*) AS files, count(*) FILTER (WHERE lang = 'en') AS functions, count(DISTINCT source) AS classes,
           CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)) AS BIGINT) AS duplicates
    FROM documents
    """,
)
def summary_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    copies = docs.groupBy(F.md5("text")).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("duplicates"))
    totals = docs.agg(F.count("*").alias("files"), F.count_if(F.col("lang") == "en").alias("functions"), F.count_distinct("source").alias("classes"))
    return totals.withColumn("k", F.lit(1)).join(copies.withColumn("k", F.lit(1)), "k").drop("k")


@query(
    "flatten_symbols",
    """
    SELECT conv_id, turn, role, CAST(greatest(1, length(text)) AS BIGINT) AS lines FROM conversations
    """,
)
def flatten_symbols(spark, sf_dir):
    """Turns nested by conversation and flattened again."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))).alias("turns"))
    return nested.select("conv_id", F.inline("turns")).select("conv_id", "turn", "role", F.greatest(F.lit(1), "n").cast("long").alias("lines"))


@query(
    "dashboard_totals",
    "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(l.doc_id) AS indexed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
)
def dashboard_totals(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seen")).distinct()
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count("seen").alias("indexed"))


URL_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))


@query(
    "ext_language",
    f"""
    SELECT page_id, suffix, coalesce(CASE suffix WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.md' THEN NULL END, 'Other') AS language, suffix IN ('.py', '.js', '.md') AS code
    FROM (SELECT page_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM (SELECT page_id, replace(replace({URL_PATH}, '.html', '.py'), '/en/', '/en.js/') AS path FROM pages))
    """,
)
def ext_language(spark, sf_dir):
    rows = paths(spark, sf_dir).withColumn("path", F.expr("replace(replace(path, '.html', '.py'), '/en/', '/en.js/')"))
    return rows.select("page_id", T.suffix(F.col("path")).alias("suffix"), T.language(F.col("path")).alias("language"), T.is_code(F.col("path")).alias("code"))


@query(
    "scan_filter",
    f"""
    SELECT page_id, path FROM (SELECT page_id, replace(replace({URL_PATH}, '.html', '.py'), '/de/', '/dist/') AS path FROM pages)
    WHERE path LIKE '%.py' AND path NOT LIKE '%/dist/%'
    """,
)
def scan_filter(spark, sf_dir):
    rows = paths(spark, sf_dir).withColumn("path", F.expr("replace(replace(path, '.html', '.py'), '/de/', '/dist/')"))
    return rows.where(T.is_code(F.col("path")) & ~T.in_ignored_dir(F.col("path"))).select("page_id", "path")


@query("grammar_choice", f"SELECT page_id, CASE WHEN {URL_PATH} LIKE '%.html' THEN 'typescript' WHEN page_id % 2 = 0 THEN 'cpp' ELSE 'python' END AS grammar FROM pages")
def grammar_choice(spark, sf_dir):
    label = F.when(F.col("page_id") % 2 == 0, "C++").otherwise("Unknown")
    rows = paths(spark, sf_dir).withColumn("path", F.expr("replace(path, '.html', '.ts')"))
    return rows.select("page_id", T.grammar(F.col("path"), label).alias("grammar"))


@query("url_parse", "SELECT page_id, regexp_extract(url, '^(?:https?://)?(?:www\\.)?([A-Za-z0-9.-]+)/([A-Za-z0-9_.-]+)', 1) AS owner, regexp_extract(url, '^(?:https?://)?(?:www\\.)?([A-Za-z0-9.-]+)/([A-Za-z0-9_.-]+)', 2) AS name FROM pages")
def url_parse(spark, sf_dir):
    form = r"^(?:https?://)?(?:www\.)?([A-Za-z0-9.-]+)/([A-Za-z0-9_.-]+)"
    return table(spark, sf_dir, "pages").select("page_id", *owner_and_name(F.col("url"), form))


@query("basename", f"SELECT page_id, regexp_extract({URL_PATH}, '([^/]*)$', 1) AS base FROM pages")
def basename(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", T.basename(F.col("path")).alias("base"))


@query("find_file_suffix", f"SELECT page_id, {URL_PATH} AS path FROM pages WHERE {URL_PATH} LIKE '%.html' ORDER BY page_id LIMIT 1")
def find_file_suffix(spark, sf_dir):
    return find_file(paths(spark, sf_dir).select("page_id", "path"), ".html", "page_id")


@query(
    "path_tree",
    f"""
    WITH p AS (SELECT DISTINCT string_split(trim({URL_PATH}, '/'), '/') AS parts FROM pages),
    e AS (SELECT parts, unnest(generate_series(1, len(parts))) AS depth FROM p)
    SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, depth < len(parts) AS is_dir FROM e
    """,
)
def path_tree(spark, sf_dir):
    return file_tree(paths(spark, sf_dir).select(F.trim(F.col("path"), F.lit("/")).alias("path")))


@query("external_import_flag", "SELECT page_id, NOT (contains(url, 'example.com') OR starts_with(url, 'https://www')) AS external FROM pages")
def external_import_flag(spark, sf_dir):
    """Urls as modules: those of the host example.com, or with the project's own start, are internal."""
    module = F.when(F.col("url").startswith("https://www"), F.concat(F.lit("src."), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.is_external(module, F.lit("example.com")).alias("external"))


@query("cache_keys", "SELECT p_partkey, 'part' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ':' || replace(p_brand, '#', '_') END || ':' || CAST(p_size AS VARCHAR) AS key FROM part")
def cache_keys(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.expr("replace(p_brand, '#', ':')"))
    return table(spark, sf_dir, "part").select("p_partkey", T.cache_key(F.lit("part"), brand, F.col("p_size").cast("string")).alias("key"))


@query("ttl_cache_valid", "SELECT event_id, ts + INTERVAL 300 SECOND > TIMESTAMP '2024-01-15 12:00:00' AS valid FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'")
def ttl_cache_valid(spark, sf_dir):
    now = F.expr("timestamp_ntz '2024-01-15 12:00:00'")
    return table(spark, sf_dir, "events").where(F.col("ts") <= now).select("event_id", still_valid(F.col("ts"), 300, now).alias("valid"))


@query(
    "sanitize_labels",
    """
    SELECT p_partkey, substr(CASE WHEN regexp_matches(c, '^[0-9]') THEN 'n_' || c ELSE c END, 1, 48) AS slug, '"' || substr(replace(p_name, '"', ''''), 1, 120) || '"' AS quoted,
           substr(c, 1, 40) AS method, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS hyphened
    FROM (SELECT *, regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS c FROM part)
    """,
)
def sanitize_labels(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.diagram_id(name).alias("slug"), T.diagram_quote(name).alias("quoted"), T.diagram_method(name).alias("method"), T.slugify(name).alias("hyphened"))


@query("circular_layout", "SELECT n_nationkey, round(0.5 + 0.38 * cos(2 * pi() * i / n - pi() / 2), 6) AS x, round(0.5 + 0.38 * sin(2 * pi() * i / n - pi() / 2), 6) AS y FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)")
def circular_layout(spark, sf_dir):
    return circle(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@query(
    "flatten_metadata",
    "SELECT p_partkey, p_brand || ',' || p_type AS tags, coalesce(nullif(p_name, ''), '') AS name FROM part",
)
def flatten_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags"), F.col("p_name").alias("name"))
    return flat_metadata(rows, ["name"], "tags").select("p_partkey", "tags", "name")


@query(
    "job_report",
    """
    SELECT o_orderstatus, count(*) AS jobs, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus
    """,
)
def job_report(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("references", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def references(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(ranking.sorted_text(F.col("lang")).alias("langs"))


