"""A property graph of nodes (id, label, ...) and edges (src, type, dst) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.functions import text as T
from graphloom.operators.ranking import missing, top_per_key
from graphloom.session import stage


def node_id(label: str | Column, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(label) if isinstance(label, str) else label, *(p.cast("string") for p in parts))


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row for each id; of each property the last value that is not null."""
    properties = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in properties))


def merge_edges(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """One row for each (src, type, dst), the first, where both ends are nodes."""
    first = top_per_key(edges, ["src", "type", "dst"], [F.col(order)])
    ids = nodes.select("id").distinct()
    return first.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def delete_repository(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without a repository, and the number of nodes that go, as a row."""
    gone = nodes.where(F.col("repo_id") == repo).select("id")
    left = missing(missing(edges, gone.withColumnRenamed("id", "src"), "src"), gone.withColumnRenamed("id", "dst"), "dst").select(*edges.columns)
    return nodes.where(F.col("repo_id").isNull() | (F.col("repo_id") != repo)), left, gone.agg(F.count("*").alias("deleted"))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def layers(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """layer, files, symbols, samples (five paths): files (path) with the symbols (path) that they define."""
    counts = symbols.groupBy("path").agg(F.count("*").alias("n"))
    rows = files.select("path").distinct().join(counts, "path", "left").withColumn("layer", T.layer(F.col("path")))
    samples = top_per_key(rows, ["layer"], [F.col("path")], 5).groupBy("layer").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("samples"))
    return rows.groupBy("layer").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols")).join(samples, "layer")


def cross_layer(calls: DataFrame) -> DataFrame:
    """Calls (source, source_file, target, target_file) between different layers, with these."""
    rows = calls.withColumn("source_layer", T.call_layer(F.col("source_file"))).withColumn("target_layer", T.call_layer(F.col("target_file")))
    return rows.where("source_layer <> target_layer")


def import_graph(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, path, label, group) and edges (source, target) of imports (source, target, target_label)."""
    edges = imports.where("source <> '' and target <> ''")
    to = F.when(F.col("target_label") == "ExternalLibrary", "lib:").otherwise("file:")
    sides = edges.select(F.concat(F.lit("file:"), "source").alias("id"), F.col("source").alias("path"), F.lit("File").alias("kind"))
    sides = sides.unionByName(edges.select(F.concat(to, "target").alias("id"), F.col("target").alias("path"), F.col("target_label").alias("kind")))
    nodes = sides.groupBy("id", "path").agg(F.max("kind").alias("kind"))
    nodes = nodes.select("id", "path", T.basename(F.col("path")).alias("label"), T.path_group(F.col("path"), F.col("kind")).alias("group"))
    return nodes, edges.select(F.concat(F.lit("file:"), "source").alias("source"), F.concat(to, "target").alias("target"))


def search_symbols(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct nodes (id, name) whose name has one of a few terms (term), in any case."""
    words = [r.term for r in terms.select("term").distinct().orderBy("term").limit(6).collect()]
    return nodes.where(T.any_of(F.lower("name"), [w.lower() for w in words])) if words else nodes.limit(0)


def query_terms(question: Column) -> Column:
    """At most six words of more than two characters; of none the first 64 characters."""
    words = F.slice(F.filter(F.split(F.regexp_replace(question, r"[`'\"?,.!()]", " "), r"\s+"), lambda w: F.length(w) > 2), 1, 6)
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.substring(question, 1, 64)))


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, target: the best symbol (id, name, qualified, file, kind) for each reference (ref_id, file, receiver, name).

    A qualified name first, then a method and a function of the same file, then any method, then
    any symbol of that name; ties by id.  A name that very many symbols have is looked up once."""
    names = refs.withColumn("wanted", F.when(F.coalesce("receiver", F.lit("")) != "", F.concat_ws(".", "receiver", "name")))
    s = symbols.select(F.col("id").alias("target"), F.col("name").alias("s_name"), "qualified", F.col("file").alias("s_file"), "kind")
    by_qualified = top_per_key(s.where("qualified is not null"), ["qualified"], [F.col("target")]).select("qualified", "target")
    exact = names.where("wanted is not null").join(by_qualified, F.col("wanted") == F.col("qualified")).select("ref_id", "target", F.lit(1).alias("rank"))
    kind_rank = F.when(F.col("kind") == "Method", 0).otherwise(1)
    in_file = top_per_key(s, ["s_file", "s_name"], [kind_rank, F.col("target")])
    same = names.join(in_file, (F.col("file") == F.col("s_file")) & (F.col("name") == F.col("s_name"))).select("ref_id", "target", F.lit(2).alias("rank"))
    anywhere = top_per_key(s, ["s_name"], [kind_rank, F.col("target")])
    other = names.join(anywhere, F.col("name") == F.col("s_name")).select("ref_id", "target", F.lit(3).alias("rank"))
    found = exact.unionByName(same).unionByName(other)
    return top_per_key(found, ["ref_id"], [F.col("rank"), F.col("target")]).select("ref_id", "target")


def import_aliases(parsed: DataFrame) -> DataFrame:
    """file, name, module: what names stand for in a file that imports them, and the last part of a module that
    names are taken from; of several imports of a name the last one counts."""
    imports = parsed.select("file", F.posexplode("imports").alias("at", "i")).where(F.size("i.names") > 0)
    bound = F.concat(F.col("i.names"), F.array(F.substring_index("i.module", ".", -1)))
    rows = imports.select("file", "at", F.col("i.module").alias("module"), F.posexplode(bound).alias("place", "name"))
    return rows.groupBy("file", "name").agg(F.max_by("module", F.struct("at", "place")).alias("module"))


def one_symbol(symbols: DataFrame, keys: list[str], to: str) -> DataFrame:
    """keys, `to`: the best symbol (id, kind, ...) for each key, a method before others, ties by id."""
    method_first = [F.when(F.col("kind") == "Method", 0).otherwise(1), F.col("id")]
    return top_per_key(symbols.where(" and ".join(f"{k} is not null" for k in keys)), keys, method_first).select(*keys, F.col("id").alias(to))


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """A left join with a table of one row a key, for tables that can be read several times. The `most` frequent keys are found beforehand
    and broadcast, so that one key of very many rows does not meet in one task; all others are dealt out by key."""
    frequent = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)
    frequent = stage(frequent.join(lookup, key, "left").drop("n").withColumn("_known", F.lit(True)), "frequent", freed=True)
    near = rows.join(F.broadcast(frequent), key, "left")  # at most `most` rows
    far = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").where(F.col(key).isNotNull()).join(lookup, key, "left")
    return near.where(F.col("_known").isNotNull() | F.col(key).isNull()).drop("_known").unionByName(far)


def elsewhere(refs: DataFrame, symbols: DataFrame, libraries: DataFrame) -> DataFrame:
    """References (receiver, name, module, target, ...) with their targets over all files, as in `targets`; those that have one of their own file have it in `target`."""
    rows = looked_up(refs, one_symbol(symbols, ["name"], "_n"), "name")
    methods = rows.where("receiver <> ''").withColumn("qualified", F.concat_ws(".", "receiver", "name"))
    methods = methods.join(one_symbol(symbols, ["qualified"], "_q"), "qualified", "left").drop("qualified")
    rows = methods.unionByName(rows.where("coalesce(receiver, '') = ''").withColumn("_q", F.lit(None).cast("string")))
    rows = rows.withColumn("target", F.coalesce("_q", "target", "_n")).withColumn("module", F.when(F.col("target").isNull(), F.col("module")))
    rows = rows.join(libraries.groupBy("module").agg(F.min("id").alias("_l")), "module", "left")
    return rows.withColumn("target", F.coalesce("target", "_l")).select(*refs.columns)


def targets(refs: DataFrame, symbols: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """References (file, receiver, name, module, ...) with `target`, what each of them stands for, or null.

    A method of the class that the receiver names, then any symbol that is called receiver.name, then a symbol of that
    name, of the same file first, then the library (id, module) that the name comes from.  Every lookup has one row for a
    key, so a name that very many symbols have makes no more rows than there are references.  Without libraries, receivers and modules don't count."""
    rows = refs.join(one_symbol(symbols, ["file", "name"], "target"), ["file", "name"], "left")
    if libraries is None:
        return rows.join(one_symbol(symbols, ["name"], "_n"), "name", "left").select(*refs.columns, F.coalesce("target", "_n").alias("target"))
    return elsewhere(rows, symbols, libraries).select(*refs.columns, "target")


def resolve_targets(refs: DataFrame, symbols: DataFrame, libraries: DataFrame) -> DataFrame:
    """ref_id, target: what each reference (ref_id, file, receiver, name, module) stands for, by `targets`."""
    return targets(refs, symbols, libraries).where("target is not null").select("ref_id", "target")


def resolve_id(nodes: DataFrame, wanted: str) -> DataFrame:
    """The id of a symbol by name, qualified name or the end of an id, one row at most."""
    rank = F.when(F.col("name") == wanted, 0).when(F.col("id").endswith("::" + wanted), 1)
    return nodes.withColumn("_r", rank).where("_r is not null").orderBy("_r", "id").limit(1).select("id")


def members(owners: DataFrame, parts: DataFrame, owner: str, part: str, most: int = 8) -> DataFrame:
    """owner and its first parts in order, joined; owners without parts have none."""
    first = top_per_key(parts.select(owner, part).distinct(), [owner], [F.col(part)], most)
    lists = first.groupBy(owner).agg(F.array_join(F.sort_array(F.collect_list(part)), ",").alias("members"))
    return owners.select(owner).join(lists, owner, "left").withColumn("members", F.coalesce("members", F.lit("")))


NAMED = r"""__tablename__\s*=\s*['"]([^'"]+)['"]"""
MODEL = r"(?m)class\s+(\w+)\s*\([^)]*(?:Model|Base|SQLModel|Document)[^)]*\)"


def named_tables(sources: DataFrame) -> DataFrame:
    """file, table: tables that source files (file, content) name."""
    return sources.select("file", F.explode(F.regexp_extract_all("content", F.lit(NAMED), F.lit(1))).alias("table")).distinct()


def model_classes(sources: DataFrame) -> DataFrame:
    """file, name, table: classes of models, with tables called after them that the file does not name itself."""
    classes = sources.select("file", F.explode(F.regexp_extract_all("content", F.lit(MODEL), F.lit(1))).alias("name")).distinct()
    return classes.withColumn("table", T.snake_case(F.col("name"))).join(named_tables(sources), ["file", "table"], "left_anti").select("file", "name", "table")


def database_tables(sources: DataFrame) -> DataFrame:
    """file, table: tables that source files (file, content) define, by name or by a model class."""
    return named_tables(sources).unionByName(model_classes(sources).select("file", "table")).distinct()


# Forms of code that reads and that writes a database.
READS = r"(?i)\.query\s*\(|\bSELECT\b|\.execute\s*\(|\.find(One|Many|Unique)?\s*\(|\.get\s*\("
WRITES = r"(?i)\.add\s*\(|\.delete\s*\(|\.commit\s*\(|\.insert\s*\(|\.update\s*\(|\bINSERT\b|\bUPDATE\b|\.save\s*\("


def database_access(bodies: DataFrame, tables: DataFrame) -> DataFrame:
    """src, type, dst: symbols (id, file, body) that read or write the tables of their file."""
    hits = bodies.join(tables, "file").where(F.contains(F.lower("body"), F.lower("table")))
    kinds = F.array_compact(F.array(F.when(F.col("body").rlike(READS), "READS_FROM"), F.when(F.col("body").rlike(WRITES), "WRITES_TO")))
    return hits.select(F.col("id").alias("src"), F.explode(kinds).alias("type"), node_id("DatabaseTable", F.col("table")).alias("dst")).distinct()


def declared(parsed: DataFrame) -> list[DataFrame]:
    """label, file, class, name of what parsed files declare: functions, classes and methods, each in a table of its own."""
    none = F.lit(None).cast("string")
    shape = lambda rows, label, class_, name: rows.select(F.lit(label).alias("label"), "file", class_.alias("class"), name.alias("name"))
    functions = shape(parsed.select("file", F.explode("functions.name").alias("name")), "Function", none, F.col("name"))
    classes = shape(parsed.select("file", F.explode("classes.name").alias("name")), "Class", none, F.col("name"))
    methods = parsed.select("file", F.explode("classes").alias("c")).select("file", F.col("c.name").alias("class"), F.explode("c.methods.name").alias("name"))
    return [functions, classes, shape(methods, "Method", F.col("class"), F.col("name"))]


def with_ids(symbols: DataFrame, repo: str) -> DataFrame:
    """Declared symbols (label, file, class, name) with their ids and qualified names."""
    parts = [F.col(c) for c in ("file", "class", "name")]
    return symbols.select(F.col("label").alias("kind"), *parts, node_id(F.col("label"), F.lit(repo), *parts).alias("id"), F.concat_ws(".", "class", "name").alias("qualified"))


def symbol_nodes(symbols: DataFrame, repo: str) -> DataFrame:
    """Nodes of declared symbols (label, file, class, name), one row an id: where parts of names give one id, the longest file and class count."""
    rows = with_ids(symbols, repo).groupBy("id", F.col("kind").alias("label")).agg(F.max(F.struct("file", "class", "name", "qualified")).alias("s"))
    return rows.select("id", "label", "s.name", "s.file", "s.qualified", F.lit(repo).alias("repo_id"))


def references(rows: DataFrame, kind: str, src: Column, name: Column, receiver: Column | None = None, module: Column | None = None) -> DataFrame:
    """file, src, type, receiver, name, module: references from nodes to names, as `targets` takes them."""
    none = F.lit(None).cast("string")
    columns = [F.lit(kind).alias("type"), (none if receiver is None else receiver).alias("receiver"), name.alias("name"), (none if module is None else module).alias("module")]
    return rows.select("file", src.alias("src"), *columns).where("name <> ''")


def bases(parsed: DataFrame, repo: str) -> DataFrame:
    """References from classes to what they extend and implement."""
    c = parsed.select("file", F.explode("classes").alias("s"))
    class_id = node_id("Class", F.lit(repo), F.col("file"), F.col("s.name"))
    of = lambda part, kind: references(c.select("file", "s", F.explode(f"s.{part}").alias("base")), kind, class_id, F.col("base"))
    return of("bases", "EXTENDS").unionByName(of("implements", "IMPLEMENTS"))


def derivations(parsed: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Of the graph that `build` makes of parsed files (file, functions, classes): classes, what they extend and implement, and these edges.

    Functions and methods take part if a class names one of their names as its base; mostly these are few, and then nothing is dealt out for all others."""
    refs = bases(parsed, repo)
    functions, classes, methods = declared(parsed)
    others = functions.unionByName(methods)
    named = stage(others.select("name").distinct().join(refs.select("name").distinct(), "name", "left_semi"), "named", freed=True)
    symbols = classes.unionByName(others.join(named, "name", "left_semi").select(*classes.columns)).distinct()
    found = targets(refs, with_ids(symbols, repo)).where("target is not null")
    return symbol_nodes(symbols, repo), found.select("src", "type", F.col("target").alias("dst")).distinct()


ENTRY = "array<struct<what:string,class:string,name:string,src:string,caller:string,receiver:string,module:string,at:struct<i:int,place:int>>>"


def located(parsed: DataFrame, repo: str) -> DataFrame:
    """what, file, class, name, src, receiver, module, target: symbols (what: their label), libraries (what: ExternalLibrary) and references (what: the
    type of their edge) of parsed files, each once. References have the node that they come from, the symbol of their own file that they stand for, or else null, and the module
    that a called name is imported from, or a name that the file does not import as a library too. Files are dealt out once, whole; all lookups stay within them."""
    r, none = F.lit(repo), F.lit(None).cast("string")
    file = F.col("file")

    def entry(what, name, class_=none, src=none, caller=none, receiver=none, module=none, at=None):
        place = F.lit(None).cast("struct<i:int,place:int>") if at is None else F.struct(*at)
        return F.struct(F.lit(what), class_, name, src, caller, receiver, module, place)

    def each(column, make):
        return F.coalesce(F.transform(column, make).cast(ENTRY), F.array().cast(ENTRY))

    def nested(column, make):
        return F.coalesce(F.flatten(F.transform(column, lambda x: make(x))), F.array().cast(ENTRY))

    class_id = lambda c: node_id("Class", r, file, c["name"])
    bound = lambda i: F.when(F.size(i["names"]) > 0, F.concat(i["names"], F.array(F.substring_index(i["module"], ".", -1))))
    aliases = F.transform("imports", lambda i, n: F.coalesce(F.transform(bound(i), lambda name, k: entry("alias", name, module=i["module"], at=(n.cast("int"), k.cast("int")))).cast(ENTRY), F.array().cast(ENTRY)))
    entries = F.concat(
        each("functions", lambda f: entry("Function", f["name"])), each("classes", lambda c: entry("Class", c["name"])), nested("classes", lambda c: each(c["methods"], lambda m: entry("Method", m["name"], c["name"]))),
        F.coalesce(F.flatten(aliases), F.array().cast(ENTRY)), nested("classes", lambda c: each(c["bases"], lambda b: entry("EXTENDS", b, src=class_id(c)))), nested("classes", lambda c: each(c["implements"], lambda b: entry("IMPLEMENTS", b, src=class_id(c)))),
        each(F.filter("imports", lambda i: i["is_external"]), lambda i: entry("ExternalLibrary", i["module"])),
        nested("imports", lambda i: each(F.when(~i["is_external"], i["names"]), lambda n: entry("IMPORTS", n, src=node_id("File", r, file), module=i["module"]))),
        each("api_endpoints", lambda e: entry("CALLS", e["handler"], src=node_id("ApiEndpoint", r, F.upper(e["method"]), e["route"]))),
        each(F.filter("calls", lambda c: c["caller"].isNotNull()), lambda c: entry("CALLS", c["callee"], caller=c["caller"], receiver=F.when(~c["receiver"].isin("self", "this", "cls"), c["receiver"]))),
    )
    # lines of code are not dealt out
    named = lambda x: F.struct(x["name"].alias("name"))
    functions = F.transform("functions", named).alias("functions")
    classes = F.transform("classes", lambda c: F.struct(c["name"].alias("name"), F.transform(c["methods"], named).alias("methods"), c["bases"].alias("bases"), c["implements"].alias("implements"))).alias("classes")
    rows = parsed.select("file", functions, classes, "imports", "api_endpoints", "calls").repartition("file").select("file", F.inline(entries))
    is_symbol = F.col("what").isin("Function", "Class", "Method")
    symbol = F.struct(F.when(F.col("what") == "Method", 0).otherwise(1).alias("r"), node_id(F.col("what"), r, file, F.col("class"), F.col("name")).alias("id"))
    best = F.min(F.when(is_symbol & F.col("name").isNotNull(), symbol))
    rows = rows.withColumn("src", F.coalesce("src", F.when(F.col("caller").isNotNull(), best.over(Window.partitionBy("file", F.coalesce("caller", "name")))["id"])))
    same = Window.partitionBy("file", "name")
    imported = F.max(F.when(F.col("what") == "alias", F.struct("at", "module"))).over(same)["module"]
    rows = rows.withColumn("target", best.over(same)["id"]).withColumn("module", F.when(F.col("caller").isNotNull(), imported).otherwise(F.col("module")))
    is_library = F.col("what") == "ExternalLibrary"
    held = F.max(is_library).over(Window.partitionBy("file", F.when(is_library, F.col("name")).when(F.col("what") == "IMPORTS", F.col("module"))))
    rows = rows.withColumn("module", F.when(~((F.col("what") == "IMPORTS") & held), F.col("module")))
    rows = rows.where(is_symbol | is_library | (F.col("what") != "alias") & (F.col("name") != "") & F.col("src").isNotNull())
    return rows.select("what", "file", "class", "name", "src", "receiver", "module", F.when(~(is_symbol | is_library), F.col("target")).alias("target")).distinct()


def build(parsed: DataFrame, sources: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed files with their sources (file, content); names are resolved over all files."""
    r = F.lit(repo)
    none = F.lit(None).cast("string")
    repo_id, file_id = node_id("Repository", r), node_id("File", r, F.col("file"))
    library_id, table_id = node_id("ExternalLibrary", F.col("module")), node_id("DatabaseTable", F.col("table"))
    endpoint_id = node_id("ApiEndpoint", r, F.upper("s.method"), F.col("s.route"))
    files = parsed.select("file").distinct()
    # read for every kind of lookup
    rows = stage(located(parsed, repo), "located", freed=True)
    symbols = rows.where(F.col("what").isin("Function", "Class", "Method")).select(F.col("what").alias("label"), "file", "class", "name")
    e = parsed.select("file", F.explode("api_endpoints").alias("s"))
    models = model_classes(sources)
    defined = stage(named_tables(sources).withColumn("name", none).unionByName(models), "tables", freed=True)
    tables, models = defined.select("file", "table").distinct(), defined.where("name is not null")
    imported = rows.where("what = 'ExternalLibrary'").select("file", F.col("name").alias("module"))
    libraries = stage(imported.select("module").distinct().select(library_id.alias("id"), "module"), "libraries", freed=True)

    node = lambda df, label, id_, name, file, repo_: df.select(id_.alias("id"), F.lit(label).alias("label"), name.alias("name"), file.alias("file"), none.alias("qualified"), repo_.alias("repo_id"))
    nodes = symbol_nodes(symbols, repo)
    for part in (
        node(parsed.limit(1), "Repository", repo_id, r, none, r), node(files, "File", file_id, none, F.col("file"), r),
        node(e.groupBy(endpoint_id.alias("id")).agg(F.max("file").alias("file")), "ApiEndpoint", F.col("id"), none, F.col("file"), r),
        node(tables.groupBy("table").agg(F.max("file").alias("file")), "DatabaseTable", table_id, F.col("table"), F.col("file"), r),
        node(libraries, "ExternalLibrary", F.col("id"), F.col("module"), none, none),
    ):
        nodes = nodes.unionByName(part)

    # what is defined is a node, and so is what defines it
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    ids = with_ids(symbols, repo)
    edges = edge(files, repo_id, "DEFINES", file_id)
    owner = F.when(F.col("kind") == "Method", node_id("Class", r, F.col("file"), F.col("class"))).otherwise(file_id)
    edges = edges.unionByName(edge(ids, owner, "DEFINES", F.col("id"))).unionByName(edge(e, file_id, "DEFINES", endpoint_id).distinct())
    edges = edges.unionByName(edge(tables.join(files, "file", "left_semi"), file_id, "DEFINES", table_id))

    # references of all kinds are resolved together
    refs = rows.where(F.col("what").isin("EXTENDS", "IMPLEMENTS", "IMPORTS", "CALLS")).select("src", F.col("what").alias("type"), "receiver", "name", "module", "target")
    found = elsewhere(refs, ids, libraries).where("target is not null").select("src", "type", F.col("target").alias("dst"))
    edges = edges.unionByName(found.distinct()).unionByName(edge(imported, file_id, "IMPORTS", library_id))

    classes = symbols.where("label = 'Class'").select("file", "name")
    models = models.join(classes, ["file", "name"], "left_semi")
    edges = edges.unionByName(edge(models, node_id("Class", r, F.col("file"), F.col("name")), "WRITES_TO", node_id("DatabaseTable", F.col("table"))))
    # texts that name no table are left behind before files are dealt out
    texts = parsed.select("file", "functions", "classes").join(sources.where(F.col("content").rlike(NAMED) | F.col("content").rlike(MODEL)), "file")
    lines = lambda rows, *parts: rows.select("file", node_id(*parts).alias("id"), T.slice_lines(F.col("content"), F.col("s.start_line"), F.col("s.end_line")).alias("body"))
    bodies = lines(texts.select("file", "content", F.explode("functions").alias("s")), "Function", r, F.col("file"), F.col("s.name"))
    methods = texts.select("file", "content", F.explode("classes").alias("c")).select("file", "content", F.col("c.name").alias("class"), F.explode("c.methods").alias("s"))
    bodies = bodies.unionByName(lines(methods, "Method", r, F.col("file"), F.col("class"), F.col("s.name")))
    return nodes, edges.unionByName(database_access(bodies, tables))
