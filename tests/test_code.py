"""Source trees end to end: scan, parse, chunks, graph, reports."""

import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import analysis, chunks, diagrams, graph, parse, paths, ranking
from graphloom.session import stage
from graphloom.sources import cache, repository

API = '''"""Shop."""
import os
from shop.db import Order, helper

LIMIT = 5
NAMES = ["a"]

@app.get("/orders/{id}")
async def read_order(id: int, q: str = "") -> Order:
    """One order."""
    if id > LIMIT and q or not q:
        return Store().load(id)
    return helper(id)


class Store(Base):
    size: int = 3

    def load(self, key):
        return self._open(key)

    @staticmethod
    def _open(key):
        for x in range(3):
            pass
        return session.query(Order)
'''
DB = '''class Order(Model):
    __tablename__ = "orders"

    def save(self):
        session.add(orders)

def helper(x):
    return x

def unused(x):
    return x
'''
SERVER = """import express, { Router as R } from 'express'
import { load } from './load'
// class NotReal {}
const app = express()
app.get('/health', (req, res) => { res.send("ok { ") })
export class Server extends Base implements Runs {
  private port: number = 3;
  async start(port: number, name = 'x'): Promise<void> {
    if (port && name) { this.listen(port) }
  }
}
export function run(a: string, b) { return load(a) }
const arrow = async (x) => { return run(x) }
"""
GO = """package main

type Server struct {
}

func (s *Server) Start(port int) error {
  return nil
}

func main() {
}
"""


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"shop/api.py": API, "shop/db.py": DB, "web/server.ts": SERVER, "main.go": GO, "broken.py": "def x(:\n  pass\n", "node_modules/a.js": "x", "notes.txt": "x", "README.md": "# x\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return repository.scan(spark, str(root)).persist()


@pytest.fixture(scope="module")
def parsed(tree):
    return parse.parse(tree, "shop").persist()


def test_scan(tree):
    assert sorted(r.path for r in tree.collect()) == ["README.md", "broken.py", "main.go", "shop/api.py", "shop/db.py", "web/server.ts"]
    row = repository.scan_result(tree).first()
    assert row.files == 6 and row.languages == {"Go": 1, "Other": 1, "Python": 3, "TypeScript": 1}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/src/main.py", "x = 1")
        z.writestr("top/b.py", "y")
    (tmp_path / "bad.zip").write_bytes(b"no")
    rows = {(r.path, r.error) for r in repository.unpack(spark, str(tmp_path)).collect()}
    assert rows == {("src/main.py", None), ("b.py", None), (None, "not an archive")}
    assert {r.error for r in repository.unpack(spark, str(tmp_path), most=3).collect()} == {"too large", "not an archive"}


def test_python(parsed):
    r = parsed.where("file = 'shop/api.py'").first()
    (f,) = r.functions
    assert (f.name, f.return_type, f.docstring, f.start_line, f.end_line) == ("read_order", "Order", "One order.", 9, 13)
    assert [(p.name, p.type) for p in f.parameters] == [("id", "int"), ("q", "str")]
    (c,) = r.classes
    assert (c.name, c.bases, c.attributes, [m.name for m in c.methods]) == ("Store", ["Base"], ["size"], ["load", "_open"])
    assert [(i.module, i.names, i.is_external) for i in r.imports] == [("os", ["os"], True), ("shop.db", ["Order", "helper"], False)]
    assert [(e.route, e.method, e.handler) for e in r.api_endpoints] == [("/orders/{id}", "GET", "read_order")]
    calls = {(x.caller, x.callee, x.receiver) for x in r.calls}
    assert {("read_order", "helper", None), ("read_order", "load", "Store()"), ("load", "_open", "self"), ("_open", "query", "session")} <= calls
    assert r.metadata.symbol_count == 4 and r.metadata.lines == 26 and r.metadata.complexity == "low"


def test_scripts_and_others(parsed):
    r = parsed.where("file = 'web/server.ts'").first()
    assert [f.name for f in r.functions] == ["run", "arrow"] and [p.name for p in r.functions[0].parameters] == ["a", "b"]
    (c,) = r.classes
    assert (c.name, c.bases, c.implements, [m.name for m in c.methods], c.attributes) == ("Server", ["Base"], ["Runs"], ["start"], ["port"])
    assert (c.methods[0].start_line, c.methods[0].end_line) == (8, 10)
    assert [(i.module, i.is_external) for i in r.imports] == [("express", True), ("./load", False)]
    assert [(e.route, e.method, e.handler) for e in r.api_endpoints] == [("/health", "GET", "<anonymous>")]
    assert {("run", "load", None), ("arrow", "run", None), ("start", "listen", "this")} <= {(x.caller, x.callee, x.receiver) for x in r.calls}
    g = parsed.where("file = 'main.go'").first()
    assert [f.name for f in g.functions] == ["Start", "main"] and [c.name for c in g.classes] == ["Server"]
    b = parsed.where("file = 'broken.py'").first()
    assert b.parse_error.startswith("SyntaxError") and [f.name for f in b.functions] == ["x"]
    assert parse.summary(parsed).first().files == 6


def test_odd_sources(spark):
    rows = [("a.py", None), ("b.py", ""), ("c.js", "class {"), ("d.ts", "const x = ("), ("e.java", "class A { void f() {"), ("f.py", "x = 1\x00"), ("g.rb", "def a\n  1\nend\n"), (None, "x")]
    df = spark.createDataFrame([(p, "Other", t) for p, t in rows], "path string, language string, content string")
    assert parse.parse(df.where("path is not null")).count() == 7
    assert parse.parse(df.limit(0)).count() == 0


def test_chunks(tree, parsed):
    sources = tree.select(F.col("path").alias("file"), "content")
    small = {(r.file, r.kind, r.symbol) for r in chunks.semantic_chunks(parsed, sources).collect()}
    assert ("shop/api.py", "class", "Store") in small and ("shop/api.py", "function", "read_order") in small
    large = {(r.file, r.kind, r.symbol) for r in chunks.semantic_chunks(parsed, sources, threshold=2).collect()}
    assert ("shop/api.py", "method", "Store.load") in large and ("shop/api.py", "class", "Store") not in large
    ids = chunks.semantic_chunks(parsed, sources)
    assert ids.select("chunk_id").distinct().count() == ids.count()


def test_incremental(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, sha256 string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file string, sha256 string")
    assert {(r.file, r.status) for r in ranking.diff(before, after, "file", "sha256").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")}
    stored = spark.createDataFrame([("a1", "a"), ("b1", "b"), ("c1", "c")], "chunk_id string, file string")
    gone, todo = chunks.incremental(before, after, stored, spark.createDataFrame([("a1",), ("b2",), ("d1",)], "chunk_id string"))
    assert {r.chunk_id for r in gone.collect()} == {"b1", "c1"} and {r.chunk_id for r in todo.collect()} == {"b2", "d1"}


def test_graph(tree, parsed):
    nodes, edges = graph.build(parsed, tree.select(F.col("path").alias("file"), "content"), "me/shop")
    nodes, edges = nodes.persist(), edges.persist()
    assert nodes.count() == nodes.select("id").distinct().count()
    e = {(r.src.split("::")[-1], r.type, r.dst.split("::")[-1]) for r in edges.collect()}
    assert {("read_order", "CALLS", "helper"), ("load", "CALLS", "_open"), ("/orders/{id}", "CALLS", "read_order"), ("api.py", "IMPORTS", "os"), ("shop/api.py", "IMPORTS", "Order")} & e
    assert ("read_order", "CALLS", "helper") in e and ("load", "CALLS", "_open") in e and ("/orders/{id}", "CALLS", "read_order") in e
    assert ("shop/api.py", "IMPORTS", "os") in e and ("shop/api.py", "IMPORTS", "Order") in e and ("Order", "DEFINES", "save") in e and ("save", "WRITES_TO", "orders") in e
    labels = {r.label: r.n for r in graph.label_counts(nodes).collect()}
    assert labels["Repository"] == 1 and labels["File"] == 6 and labels["DatabaseTable"] >= 1 and labels["ExternalLibrary"] == 2
    start = nodes.where("name = 'read_order'").select("id")
    assert {r.node.split("::")[-1] for r in paths.dependencies(edges.where("type = 'CALLS'"), start).collect()} >= {"helper"}
    dead = analysis.dead_symbols(analysis.symbols_of(parsed), parsed.select(F.explode("calls.callee").alias("name")), parsed.select(F.explode("api_endpoints.handler").alias("name")))
    names = {r.name for r in dead.collect()}
    assert "unused" in names and not names & {"helper", "read_order", "_open", "run", "main"}


SHAPE = "file string, functions array<struct<name:string,start_line:int,end_line:int>>, classes array<struct<name:string,methods:array<struct<name:string,start_line:int,end_line:int>>,bases:array<string>,implements:array<string>,start_line:int,end_line:int>>, imports array<struct<module:string,names:array<string>,is_external:boolean>>, api_endpoints array<struct<route:string,method:string,handler:string>>, calls array<struct<caller:string,callee:string,receiver:string>>"


def test_references_together(spark):
    """Both files that have a route call their own handler; and the plan of the edges, which the driver holds, looks names of all kinds up at once."""
    row = lambda file: (file, [("get", 1, 2)], [], [], [("/r", "get", "get")], [("get", "get", "self")])
    parsed = spark.createDataFrame([row("a.py"), row("b.py"), ("c.py", None, None, None, None, None)], SHAPE)
    edges = graph.build(parsed, spark.createDataFrame([("a.py", "x"), ("d.py", "__tablename__ = 't'")], "file string, content string"), "r")[1]
    got = {(r.src, r.type, r.dst) for r in edges.where("type = 'CALLS'").collect()}
    f = "Function::r::{}.py::get".format
    assert got == {("ApiEndpoint::r::GET::/r", "CALLS", f("a")), ("ApiEndpoint::r::GET::/r", "CALLS", f("b")), (f("a"), "CALLS", f("a")), (f("b"), "CALLS", f("b"))}
    assert edges.where("dst = 'DatabaseTable::t'").count() == 0  # d.py was not parsed
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 30 and plan.count("Window ") <= 12


def test_located(spark):
    """Within a file: the first method of a caller's or a called name, the last import of a name, and each file by itself; what is missing stands for nothing."""
    one = lambda module, outside, *names: (module, list(names), outside)
    rows = [
        ("a.py", [("f", 1, 2), ("f", 3, 4)], [("K", [("f", 1, 2)], ["K", "f"], None)], [one("x", True, "g"), one("y", True, "g"), one("y", False, "z"), one("w", False, "z")], None, [("f", "g", "self"), ("f", "g", "this"), ("lost", "g", None), (None, "g", None), ("K", "K", "R"), ("f", "", None)]),
        ("b.py", None, None, None, [("/r", "get", "f")], [("f", "f", None)]),
    ]
    shape = SHAPE.replace(",start_line:int,end_line:int>>, imports", ">>, imports")
    got = {tuple(r)[:1] + tuple(r)[2:] for r in graph.located(spark.createDataFrame(rows, shape), "r").where("what not in ('Function', 'Class', 'Method')").collect()}
    f, k = "Method::r::a.py::K::f", "Class::r::a.py::K"
    assert got == {
        ("ExternalLibrary", None, "x", None, None, None, None), ("ExternalLibrary", None, "y", None, None, None, None), ("EXTENDS", None, "K", k, None, None, k), ("EXTENDS", None, "f", k, None, None, f),
        ("IMPORTS", None, "z", "File::r::a.py", None, None, None), ("IMPORTS", None, "z", "File::r::a.py", None, "w", None), ("CALLS", None, "g", f, None, "y", None), ("CALLS", None, "K", k, "R", None, k),
        ("CALLS", None, "f", "ApiEndpoint::r::GET::/r", None, None, None),
    }


def test_looked_up(spark):
    """Frequent keys, all others and no key have the same result as a left join."""
    rows = spark.createDataFrame([(i, f"k{i % 7 if i % 2 else i}" if i % 5 else None) for i in range(60)], "i int, k string")
    lookup = spark.createDataFrame([(f"k{i}", i) for i in range(0, 60, 3)], "k string, v int")
    plain = sorted(tuple(r) for r in rows.join(lookup, "k", "left").select("i", "v").collect())
    assert all(sorted(tuple(r) for r in graph.looked_up(rows, lookup, "k", most).select("i", "v").collect()) == plain for most in (1, 3, 1000))


def test_artifacts_and_cache(spark, parsed, tmp_path):
    cache.write_artifact(parsed, str(tmp_path / "a"), "job1", "me", "shop")
    back = cache.resolve(cache.read_artifact(spark, str(tmp_path / "a")), "me/shop")
    assert back.count() == parsed.count() and back.where("file = 'shop/api.py'").first().classes[0].name == "Store"
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert cache.cached(spark, str(tmp_path / "c"), make, 300).count() == 3
    assert len(made) == 1 and cache.cached(spark, str(tmp_path / "c"), make, 0).count() == 3 and len(made) == 2
    assert cache.read_manifest(spark, str(tmp_path / "m")).count() == 0
    cache.write_manifest(spark.createDataFrame([("r", "a", "1")], "repo_id string, path string, sha256 string"), str(tmp_path / "m"))
    cache.write_manifest(spark.createDataFrame([("s", "b", "2")], "repo_id string, path string, sha256 string"), str(tmp_path / "m"))
    assert cache.read_manifest(spark, str(tmp_path / "m")).count() == 2


def test_trails_against_search(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "c")]
    want = set()

    def go(path, used, depth):
        for e in edges:
            if e[0] == path[-1] and e not in used and depth < 4:
                want.add((path[0], ">".join([*path, e[1]]), depth + 1))
                go([*path, e[1]], used | {e}, depth + 1)

    for n in "abcd":
        go([n], frozenset(), 0)
    df = spark.createDataFrame([(a, "CALLS", b) for a, b in edges], "src string, type string, dst string")
    rows = paths.call_chains(df, df.select(F.col("src").alias("id")).distinct(), 4).collect()
    assert {(r.seed, ">".join(r.nodes), r.depth) for r in rows} == want and len(rows) == len(want)


def test_diagrams(spark):
    nodes = spark.createDataFrame([("a/b", "A (x)"), ("c", "C")], "id string, label string")
    edges = spark.createDataFrame([("a/b", "c", "calls")], "src string, dst string, label string")
    text = diagrams.flowchart(nodes, edges).first().text
    assert text.startswith("flowchart LR\n") and 'a_b["A (x)"]' in text and "a_b -->|calls| c" in text
    classes = spark.createDataFrame([("Store", ["load", "save"])], "name string, methods array<string>")
    assert "+load()" in diagrams.class_diagram(classes, spark.createDataFrame([("Store", "Base", "EXTENDS")], "source string, target string, type string")).first().text
    chains = spark.createDataFrame([(1, ["a", "b", "c"])], "ord int, nodes array<string>")
    assert diagrams.sequence(chains).first().text.split("\n")[1:] == ["    a->>b: calls", "    b->>c: calls"]


def test_scalars(spark):
    df = spark.createDataFrame([("APIModel", "https://github.com/me/repo.git", "How does `a.b` work in UserService? explain my_name")], "n string, u string, q string")
    r = df.select(T.snake_case(F.col("n")).alias("s"), *repository.owner_and_name(F.col("u")), T.symbol_candidates(F.col("q")).alias("c"), T.plan_tools(F.col("q")).alias("p"), T.strategy(F.col("q")).alias("g")).first()
    assert r.s == "a_p_i_model" and (r.owner, r.name) == ("me", "repo") and r.c == ["How", "UserService", "a.b", "my_name"] and r.g == "vector" and r.p == ["search_graph", "explain_function"] or r.p[-1] == "search_code"


def test_report(parsed):
    from graphloom.operators import report

    tables = {k: v.collect() for k, v in report.report(parsed).items()}
    (s,) = tables["summary"]
    assert s.files == 6 and s.classes == 4 and s.endpoints == 2
    assert abs(sum(r.pct for r in tables["languages"]) - 100) < 0.3 and sum(r.files for r in tables["complexity"]) == 6
    assert ("shop/api.py", "shop/db.py") in {(r.source, r.target) for r in tables["imports"]} and ("shop/api.py", "ext:os") in {(r.source, r.target) for r in tables["imports"]}
    assert "unused" in {r.name for r in tables["dead_code"]} and tables["heatmap"][0].intensity <= 1


def test_assistant(spark, tree, parsed):
    from graphloom.operators import assistant, vectors

    sources = tree.select(F.col("path").alias("file"), "content")
    nodes, edges = graph.build(parsed, sources, "me/shop")
    found = chunks.semantic_chunks(parsed, sources)
    index = assistant.Index(stage(nodes, "nodes"), stage(edges, "edges"), stage(vectors.hashing_embedder(found, "code", "vector"), "chunks"), "me/shop")
    assert assistant.answer(index, "Who owns this repo?")["answer"].startswith("me/shop belongs to me")
    out = assistant.answer(index, "explain `read_order` and its api route")
    assert out["tools"][0] == "trace_request_flow" and out["citations"].count() > 0 and 0 <= out["confidence"] <= 0.75 and out["next"]
    hits = assistant.hybrid(index, "what calls `helper`, and the dependency of `read_order`").collect()
    assert hits and all(0 <= h.score <= 1 for h in hits)
    for tool, run in assistant.TOOLS.items():
        assert set(assistant.HIT) <= set(run(index, "bug in load", ["read_order"]).columns), tool


def test_aliases_and_targets(spark):
    """The last import of a name counts; a method of the receiver's class comes before a symbol of the whole name, a name and a library."""
    one = lambda module, *names: {"module": module, "names": list(names), "is_external": True}
    parsed = spark.createDataFrame([("a.py", [one("x.y", "f", "g"), one("z", "f"), one("w.f", "h"), one("plain")]), ("b.py", []), ("c.py", None)], "file string, imports array<struct<module:string,names:array<string>,is_external:boolean>>")
    aliases = {(r.file, r.name): r.module for r in graph.import_aliases(parsed).collect()}
    assert aliases == {("a.py", "f"): "w.f", ("a.py", "g"): "x.y", ("a.py", "y"): "x.y", ("a.py", "z"): "z", ("a.py", "h"): "w.f"}
    symbols = [("m1", "run", "Job.run", "j.py", "Method"), ("m2", "run", "Task.run", "a.py", "Method"), ("f1", "run", "run", "b.py", "Function"), ("q1", "run", "Job.run", "a.py", "Function"), ("q2", "go", "pkg.go", "b.py", "Function")]
    symbols = spark.createDataFrame(symbols, "id string, name string, qualified string, file string, kind string")
    refs = [(1, "b.py", "Job", "run", "z"), (2, "b.py", "pkg", "go", None), (3, "b.py", "unknown", "run", "z"), (4, "q.py", None, "run", None), (5, "q.py", None, "f", "w.f"), (6, "q.py", "", "f", "not known"), (7, "q.py", None, None, None)]
    refs = spark.createDataFrame(refs, "ref_id long, file string, receiver string, name string, module string")
    libraries = spark.createDataFrame([("lib:w.f", "w.f"), ("lib:z", "z")], "id string, module string")
    got = {r.ref_id: r.target for r in graph.resolve_targets(refs, symbols, libraries).collect()}
    assert got == {1: "m1", 2: "q2", 3: "f1", 4: "m1", 5: "lib:w.f"}


def test_model_classes(spark):
    """A model class writes to the table that is called after it, unless the file names this table itself."""
    sources = spark.createDataFrame([("a.py", "class BigOrder(Base):\n  pass\nclass Item(Model):\n  __tablename__ = 'item'\n"), ("b.py", ""), ("c.py", None)], "file string, content string")
    assert [tuple(r) for r in graph.model_classes(sources).collect()] == [("a.py", "BigOrder", "big_order")]
    assert {tuple(r) for r in graph.database_tables(sources).collect()} == {("a.py", "big_order"), ("a.py", "item")}
