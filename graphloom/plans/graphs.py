"""Graph building and graph queries over regions, orders, events and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions import text as T
from graphloom.operators import diagrams, graph, paths, ranking, report
from graphloom.plans.registry import Registry
from graphloom.session import stage, table

registry = query = Registry()


def star_edges(spark, sf_dir, orders: bool = False) -> DataFrame:
    """Region to nation to customer and supplier, and to orders, by ids of label and key."""
    edge = lambda name, src, src_key, kind, dst, dst_key: table(spark, sf_dir, name).select(graph.node_id(src, F.col(src_key)).alias("src"), F.lit(kind).alias("type"), graph.node_id(dst, F.col(dst_key)).alias("dst"))
    parts = [edge("nation", "Region", "n_regionkey", "DEFINES", "Nation", "n_nationkey"), edge("customer", "Nation", "c_nationkey", "DEFINES", "Customer", "c_custkey"), edge("supplier", "Nation", "s_nationkey", "IMPORTS", "Supplier", "s_suppkey")]
    if orders:
        parts.append(edge("orders", "Customer", "o_custkey", "CALLS", "Order", "o_orderkey"))
    return reduce(DataFrame.unionByName, parts)


def star_nodes(spark, sf_dir) -> DataFrame:
    node = lambda name, label, key, title: table(spark, sf_dir, name).select(graph.node_id(label, F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"))
    return reduce(DataFrame.unionByName, [node("region", "Region", "r_regionkey", "r_name"), node("nation", "Nation", "n_nationkey", "n_name"), node("customer", "Customer", "c_custkey", "c_name"), node("supplier", "Supplier", "s_suppkey", "s_name")])


STAR_NODES = " UNION ALL ".join(f"SELECT '{label}::' || CAST({key} AS VARCHAR) AS id, '{label}' AS label, {name} AS name FROM {t}" for t, label, key, name in (("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name")))
STAR_EDGES = """SELECT 'Region::' || n_regionkey AS src, 'DEFINES' AS type, 'Nation::' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'Nation::' || c_nationkey, 'DEFINES', 'Customer::' || c_custkey FROM customer UNION ALL SELECT 'Nation::' || s_nationkey, 'IMPORTS', 'Supplier::' || s_suppkey FROM supplier"""


def event_edges(spark, sf_dir) -> DataFrame:
    """Which type of event follows which, of one user: a small graph with cycles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lit("CALLS").alias("type"), F.lead("event_type").over(w).alias("dst"))
    return rows.where("dst is not null").distinct()


EVENT_EDGES = "SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"
#: Edges of a chain at most.
CHAIN = 6
TRAILS = f"""
    WITH RECURSIVE e AS ({EVENT_EDGES}),
    t AS (SELECT src AS seed, dst AS node, 1 AS depth, [src || '>' || dst] AS used, src || '>' || dst AS path FROM e
      UNION ALL SELECT t.seed, e.dst, t.depth + 1, list_append(t.used, e.src || '>' || e.dst), t.path || '>' || e.dst FROM t JOIN e ON t.node = e.src
      WHERE t.depth < {{depth}} AND NOT list_contains(t.used, e.src || '>' || e.dst))
"""


@query("graph_stats", f"SELECT label, count(*) AS n FROM ({STAR_NODES}) GROUP BY label")
def graph_stats(spark, sf_dir):
    return graph.label_counts(star_nodes(spark, sf_dir))


@query("find_dependencies", TRAILS.format(depth=3) + "SELECT DISTINCT seed, node, depth, 'CALLS' AS first_type FROM t")
def find_dependencies(spark, sf_dir):
    edges = stage(event_edges(spark, sf_dir), "events")
    return paths.dependencies(edges, edges.select(F.col("src").alias("id")).distinct(), 3)


@query("call_chain", TRAILS.format(depth=CHAIN) + "SELECT seed, depth, path AS nodes FROM t")
def call_chain(spark, sf_dir):
    edges = stage(event_edges(spark, sf_dir), "events")
    chains = paths.call_chains(edges, edges.select(F.col("src").alias("id")).distinct(), CHAIN)
    return chains.select("seed", "depth", F.array_join("nodes", ">").alias("nodes"))


@query(
    "dependencies_of_regions",
    f"""
    WITH e AS ({STAR_EDGES}) SELECT seed, node, depth, first_type FROM (
      SELECT src AS seed, dst AS node, 1 AS depth, type AS first_type FROM e WHERE src LIKE 'Region%'
      UNION SELECT a.src, b.dst, 2, a.type FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'Region%')
    """,
)
def dependencies_of_regions(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(graph.node_id("Region", F.col("r_regionkey")).alias("id"))
    return paths.dependencies(star_edges(spark, sf_dir), seeds, 3)


@query(
    "dependency_distances",
    f"""
    WITH RECURSIVE e AS ({STAR_EDGES} UNION ALL SELECT 'Customer::' || o_custkey, 'CALLS', 'Order::' || o_orderkey FROM orders UNION ALL SELECT 'Order::' || o_orderkey, 'CALLS', 'Customer::' || o_custkey FROM orders),
    t AS (SELECT 'Region::' || r_regionkey AS seed, 'Region::' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT t.seed, e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node WHERE t.depth < 6)
    SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY seed, node
    """,
)
def dependency_distances(spark, sf_dir):
    """How far orders, customers and suppliers are from regions; orders lead back to customers."""
    edges = star_edges(spark, sf_dir, orders=True)
    back = edges.where("dst like 'Order::%'").select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"))
    seeds = table(spark, sf_dir, "region").select(graph.node_id("Region", F.col("r_regionkey")).alias("id"))
    return paths.distances(edges.unionByName(back), seeds, 6)


@query("request_flow", TRAILS.format(depth=CHAIN) + "SELECT seed, depth, nodes FROM (SELECT seed, depth, path AS nodes, row_number() OVER (PARTITION BY seed ORDER BY depth DESC, path) AS n FROM t) WHERE n <= 2")
def request_flow(spark, sf_dir):
    """The two longest chains of each start."""
    return ranking.top_per_key(call_chain(spark, sf_dir), ["seed"], [F.desc("depth"), F.col("nodes")], 2)


@query(
    "import_depth",
    f"""
    WITH RECURSIVE e AS ({EVENT_EDGES}),
    t AS (SELECT src AS seed, dst AS node, [src, dst] AS nodes FROM e WHERE src <> dst
      UNION ALL SELECT t.seed, e.dst, list_append(t.nodes, e.dst) FROM t JOIN e ON t.node = e.src WHERE len(t.nodes) < 5 AND NOT list_contains(t.nodes, e.dst))
    SELECT seed, CAST(max(len(nodes)) AS INTEGER) AS depth FROM t GROUP BY seed
    UNION ALL SELECT 'Region::' || r_regionkey, 4 FROM region r WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = r_regionkey)
    """,
)
def import_depth(spark, sf_dir):
    """Of regions down to orders, and of the events that follow each other, in cycles."""
    edges = star_edges(spark, sf_dir, orders=True).select("src", "dst").unionByName(event_edges(spark, sf_dir).select("src", "dst"))
    return paths.longest(edges, 5).where("seed like 'Region%' or seed not like '%::%'")


@query("node_merge", "SELECT 'User::' || user_id AS id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_value FROM events GROUP BY user_id")
def node_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(graph.node_id("User", F.col("user_id")).alias("id"), F.col("event_type").alias("last_type"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_value"), F.col("event_id").alias("ord"))
    return graph.merge_nodes(rows, "ord")


@query("edge_merge", "SELECT 'User::' || user_id AS src, 'CALLS' AS type, 'Type::' || event_type AS dst, min(event_id) AS ord FROM events WHERE user_id % 3 <> 0 GROUP BY user_id, event_type")
def edge_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user, kind = graph.node_id("User", F.col("user_id")), graph.node_id("Type", F.col("event_type"))
    edges = events.select(user.alias("src"), F.lit("CALLS").alias("type"), kind.alias("dst"), F.col("event_id").alias("ord"))
    nodes = events.where("user_id % 3 <> 0").select(user.alias("id")).unionByName(events.select(kind.alias("id")))
    return graph.merge_edges(edges, nodes, "ord")


@query("delete_repository", f"SELECT e.src, e.dst FROM ({STAR_EDGES}) e WHERE e.src <> 'Region::1' AND NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1 AND (e.src = 'Nation::' || n_nationkey OR e.dst = 'Nation::' || n_nationkey))")
def delete_repository(spark, sf_dir):
    """Region 1 and its nations are one repository; its edges go with it."""
    nations = table(spark, sf_dir, "nation").select(graph.node_id("Nation", F.col("n_nationkey")).alias("id"), F.col("n_regionkey").cast("string").alias("repo_id"))
    regions = table(spark, sf_dir, "region").select(graph.node_id("Region", F.col("r_regionkey")).alias("id"), F.col("r_regionkey").cast("string").alias("repo_id"))
    _, edges, _ = graph.delete_repository(nations.unionByName(regions), star_edges(spark, sf_dir), "1")
    return edges.select("src", "dst")


LAYER = "CASE WHEN contains(p, 'route') OR contains(p, 'controller') OR contains(p, 'handler') OR contains(p, 'api/') THEN 'presentation' WHEN contains(p, 'service') OR contains(p, 'usecase') OR contains(p, 'domain') THEN 'business' WHEN contains(p, 'model') OR contains(p, 'repository') OR contains(p, 'db') OR contains(p, 'schema') OR contains(p, 'migration') THEN 'data' WHEN contains(p, 'util') OR contains(p, 'helper') OR contains(p, 'config') THEN 'infrastructure' ELSE 'other' END"
PAGE_PATH = "replace(replace(replace(replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/en/', '/api/'), '/de/', '/services/'), '/fr/', '/db/'), '/es/', '/util/')"


def page_files(spark, sf_dir):
    """Pages as files whose paths have words of layers."""
    path = F.expr("replace(replace(replace(replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/en/', '/api/'), '/de/', '/services/'), '/fr/', '/db/'), '/es/', '/util/')")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")


@query(
    "architecture_layers",
    f"""
    WITH f AS (SELECT path AS p, sum(n) AS n FROM (SELECT {PAGE_PATH} AS path, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n FROM pages) GROUP BY path),
    l AS (SELECT p, n, {LAYER.replace('p,', 'lower(p),')} AS layer FROM f)
    SELECT layer, count(*) AS files, CAST(sum(n) AS BIGINT) AS symbols, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT p FROM l b WHERE b.layer = l.layer ORDER BY p LIMIT 5)) AS samples FROM l GROUP BY layer
    """,
)
def architecture_layers(spark, sf_dir):
    files = page_files(spark, sf_dir)
    links = files.select("path", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("symbol"))
    return graph.layers(files, links)


@query(
    "cross_layer_calls",
    """
    SELECT s.s_suppkey AS supplier, a.n_name AS source_file, c.n_name AS target_file, CASE WHEN s.s_suppkey % 2 = 0 THEN 'business' ELSE 'data' END AS source_layer, CASE WHEN c.n_nationkey % 2 = 0 THEN 'business' ELSE 'data' END AS target_layer
    FROM supplier s JOIN nation a ON a.n_nationkey = s.s_nationkey JOIN nation c ON c.n_regionkey = a.n_regionkey WHERE s.s_suppkey % 2 <> c.n_nationkey % 2
    """,
)
def cross_layer_calls(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    side = lambda odd: F.when(odd % 2 == 0, "service/").otherwise("model/")
    a, c = nation.alias("a"), nation.alias("c")
    calls = table(spark, sf_dir, "supplier").join(a, F.col("s_nationkey") == F.col("a.n_nationkey")).join(c, F.col("c.n_regionkey") == F.col("a.n_regionkey"))
    calls = calls.select(F.col("s_suppkey").alias("supplier"), F.concat(side(F.col("s_suppkey")), "a.n_name").alias("source_file"), F.concat(side(F.col("c.n_nationkey")), "c.n_name").alias("target_file"))
    return graph.cross_layer(calls).select("supplier", T.basename(F.col("source_file")).alias("source_file"), T.basename(F.col("target_file")).alias("target_file"), "source_layer", "target_layer")


@query("architecture_union", "SELECT 'layer' AS type, n_name AS source, CAST(NULL AS VARCHAR) AS target FROM nation UNION ALL SELECT * FROM (SELECT 'call', s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey ORDER BY s_suppkey LIMIT 20)")
def architecture_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    calls = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).orderBy("s_suppkey").limit(20)
    calls = calls.select(F.lit("call").alias("type"), F.col("s_name").alias("source"), F.col("n_name").alias("target"))
    return nation.select(F.lit("layer").alias("type"), F.col("n_name").alias("source")).unionByName(calls, allowMissingColumns=True)


@query("resolve_symbol", f"SELECT id FROM ({STAR_NODES}) WHERE name = '7' OR id LIKE '%::7' ORDER BY CASE WHEN name = '7' THEN 0 ELSE 1 END, id LIMIT 1")
def resolve_symbol(spark, sf_dir):
    return graph.resolve_id(star_nodes(spark, sf_dir), "7")


@query(
    "symbol_resolution",
    """
    WITH s AS (SELECT p_partkey AS id, p_brand AS name, p_type AS file, p_type || '.' || p_brand AS qualified, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS kind FROM part),
    r AS (SELECT p_partkey AS ref_id, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'elsewhere' END AS file, CASE WHEN p_partkey % 5 = 0 THEN p_type || '.' || p_brand END AS wanted FROM part)
    SELECT ref_id, coalesce(
      (SELECT min(CAST(id AS VARCHAR)) FROM s WHERE s.qualified = r.wanted),
      (SELECT arg_min(CAST(id AS VARCHAR), (kind, CAST(id AS VARCHAR))) FROM s WHERE s.file = r.file AND s.name = r.name),
      (SELECT arg_min(CAST(id AS VARCHAR), (kind, CAST(id AS VARCHAR))) FROM s WHERE s.name = r.name)) AS target FROM r
    """,
)
def symbol_resolution(spark, sf_dir):
    """Brands as names in files of types; every fifth reference names its class, every second its own file."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "Method").otherwise("Function").alias("kind")
    symbols = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("name"), F.concat_ws(".", "p_type", "p_brand").alias("qualified"), F.col("p_type").alias("file"), kind)
    refs = part.select(
        F.col("p_partkey").alias("ref_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("elsewhere").alias("file"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).alias("receiver"), F.col("p_brand").alias("name"),
    )
    return graph.resolve(refs, symbols)


@query("search_symbols", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue')")
def search_symbols(spark, sf_dir):
    terms = spark.createDataFrame([("RING",), ("Blue",)], "term string")
    return graph.search_symbols(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")), terms)


@query(
    "query_terms",
    """
    SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(w[1:6], ',') ELSE substr(text, 1, 64) END AS terms
    FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(text, '[`''"?,.!()]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2) AS w FROM conversations)
    """,
)
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(graph.query_terms(F.col("text")), ",").alias("terms"))


@query("list_endpoints", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 50")
def list_endpoints(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").orderBy("url", "page_id").limit(50)


@query("list_tables", "SELECT n_name FROM nation ORDER BY n_name LIMIT 30")
def list_tables(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").limit(30)


LINKS = """SELECT regexp_extract(url, '://([^/?#]*)', 1) AS source, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages"""


def page_imports(spark, sf_dir):
    """Hosts that link to paths; of every third link the target is a library."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return rows.withColumn("target_label", F.when(F.length("target") % 3 == 0, "ExternalLibrary").otherwise("File"))


GROUP = "CASE WHEN k = 'ExternalLibrary' THEN 'external' WHEN regexp_matches(lower(p), 'route|controller|api/|handler') THEN 'api' WHEN contains(lower(p), 'service') THEN 'service' WHEN regexp_matches(lower(p), 'util|helper|config') THEN 'util' ELSE 'core' END"


@query(
    "import_graph_groups",
    f"""
    WITH l AS (SELECT source, {{target}} AS target, CASE WHEN length(target) % 3 = 0 THEN 'ExternalLibrary' ELSE 'File' END AS kind FROM ({LINKS}) WHERE source <> '' AND target <> ''),
    n AS (SELECT 'file:' || source AS id, source AS p, 'File' AS k FROM l UNION ALL SELECT CASE WHEN kind = 'File' THEN 'file:' ELSE 'lib:' END || target, target, kind FROM l)
    SELECT id, regexp_extract(p, '([^/]*)$', 1) AS label, {GROUP} AS "group" FROM (SELECT id, p, max(k) AS k FROM n GROUP BY id, p)
    """.replace("{target}", "CASE length(target) % 5 WHEN 1 THEN '/api' || target WHEN 2 THEN '/service' || target WHEN 3 THEN '/util' || target ELSE target END"),
)
def import_graph_groups(spark, sf_dir):
    """Hosts and link targets; many targets lie in folders that name a group."""
    n = F.length("target") % 5
    folder = F.when(n == 1, "/api").when(n == 2, "/service").when(n == 3, "/util").otherwise("")
    nodes, _ = graph.import_graph(page_imports(spark, sf_dir).where("target <> ''").withColumn("target", F.concat(folder, "target")))
    return nodes.select("id", "label", "group")


@query("import_edges", f"SELECT source, target, CAST(count(*) AS BIGINT) AS links FROM (SELECT 'file:' || source AS source, CASE WHEN length(target) % 3 = 0 THEN 'lib:' ELSE 'file:' END || target AS target FROM ({LINKS}) WHERE target <> '') GROUP BY ALL")
def import_edges(spark, sf_dir):
    _, edges = graph.import_graph(page_imports(spark, sf_dir))
    return edges.groupBy("source", "target").agg(F.count("*").alias("links"))


OWNED = "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_suppkey - s_suppkey % 3 + 1 END"


@query("import_resolution_unique", f"SELECT l.name AS target, min(s_suppkey) AS owner FROM (SELECT DISTINCT l_suppkey AS name FROM lineitem) l JOIN (SELECT s_suppkey, {OWNED} AS name FROM supplier) s USING (name) GROUP BY l.name HAVING count(*) = 1")
def import_resolution_unique(spark, sf_dir):
    """Suppliers of lines as names, of which two suppliers of three share one: those that only one supplier owns."""
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name"))
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"), F.expr(OWNED).alias("name"))
    return report.resolved_once(wanted, owners, "owner").select(F.col("name").alias("target"), "owner")


@query("vis_graph_first60", f"SELECT substr(md5(source), 1, 10) AS source, substr(md5(target), 1, 10) AS target FROM (SELECT DISTINCT source, target FROM ({LINKS}) ORDER BY source, target LIMIT 60)")
def vis_graph_first60(spark, sf_dir):
    first = page_imports(spark, sf_dir).select("source", "target").distinct().orderBy("source", "target").limit(60)
    return first.select(F.substring(F.md5("source"), 1, 10).alias("source"), F.substring(F.md5("target"), 1, 10).alias("target"))


@query("class_structure", "SELECT n.n_name, coalesce(m.members, '') AS members FROM nation n LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS members FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) <= 8) GROUP BY s_nationkey) m ON m.s_nationkey = n.n_nationkey")
def class_structure(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    rows = graph.members(nation, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_name"), "key", "s_name")
    return rows.join(nation, "key").select("n_name", "members")


@query("table_detection", "SELECT DISTINCT doc_id AS file, unnest(regexp_extract_all(replace(text, 'token = ', '__tablename__ = '), '__tablename__\\s*=\\s*[''\"]([^''\"]+)[''\"]', 1)) AS \"table\" FROM documents")
def table_detection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.expr("replace(text, 'token = ', '__tablename__ = ')").alias("content"))
    return graph.database_tables(rows)


BODY = "replace(replace(text, 'token = ', '.get('), '.com', '.save(')"


@query(
    "db_access_theta",
    f"SELECT DISTINCT 'd' || doc_id AS src, kind AS type, 'DatabaseTable::the' AS dst FROM (SELECT doc_id, unnest(CASE WHEN regexp_matches(b, '\\.get\\s*\\(') THEN ['READS_FROM'] ELSE [] END || CASE WHEN regexp_matches(b, '\\.save\\s*\\(') THEN ['WRITES_TO'] ELSE [] END) AS kind FROM (SELECT doc_id, {BODY} AS b FROM documents) WHERE contains(lower(b), 'the'))",
)
def db_access_theta(spark, sf_dir):
    """Texts as bodies: secrets read and addresses write a table named `the`."""
    bodies = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("file"), F.expr(BODY).alias("body"))
    return graph.database_access(bodies, bodies.select("file", F.lit("the").alias("table")))


@query("degree_top48", f"WITH e AS ({STAR_EDGES}), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT n.id, coalesce(degree, 0) AS degree FROM ({STAR_NODES}) n LEFT JOIN d USING (id) ORDER BY degree DESC, n.id LIMIT 48")
def degree_top48(spark, sf_dir):
    return diagrams.top_by_degree(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


@query("induced_edges", f"WITH e AS ({STAR_EDGES}), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), t AS (SELECT n.id FROM ({STAR_NODES}) n LEFT JOIN d USING (id) ORDER BY coalesce(degree, 0) DESC, n.id LIMIT 48) SELECT src, type, dst FROM e WHERE src IN (FROM t) AND dst IN (FROM t)")
def induced_edges(spark, sf_dir):
    return diagrams.induced(star_edges(spark, sf_dir), degree_top48(spark, sf_dir))


@query("system_architecture", "SELECT n_name, tier, CASE tier WHEN 'api' THEN 0.28 ELSE 0.5 END::DOUBLE AS x, round(row_number() OVER (PARTITION BY tier ORDER BY n_name) / (count(*) OVER (PARTITION BY tier) + 1), 6) AS y FROM (SELECT n_name, CASE WHEN n_regionkey % 2 = 0 THEN 'api' ELSE 'service' END AS tier FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 5)")
def system_architecture(spark, sf_dir):
    nation = ranking.top_per_key(table(spark, sf_dir, "nation"), ["n_regionkey"], [F.col("n_name")], 5)
    tier = F.when(F.col("n_regionkey") % 2 == 0, "api").otherwise("service").alias("tier")
    return diagrams.columns(nation.select("n_name", tier), "tier", "n_name")
