"""Views of small graphs: limits, tiers that are missing, nothing at all; and small texts."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from graphloom.operators import diagrams, graph, views
from graphloom.plans import catalogue
from graphloom.session import shared_dir

LAYERS, CROSSING, ENDPOINTS, TABLES = "layer string, files int, samples string", "source string, target string, source_layer string, target_layer string", "method string, route string, handler string, file string", "name string, file string"


def system(spark, layers=(), crossing=(), endpoints=(), tables=()):
    frames = [spark.createDataFrame(list(rows), shape) for rows, shape in ((layers, LAYERS), (crossing, CROSSING), (endpoints, ENDPOINTS), (tables, TABLES))]
    nodes, edges = views.system_view(*frames)
    return {r.id: r for r in nodes.collect()}, {r.id: r for r in edges.collect()}


def test_system(spark):
    layers = [("presentation", 3, "web/App.tsx,b/c.py,d.py,e.py"), ("business", 1, ""), ("other", 9, "x")]
    crossing = [("a", "b", "presentation", "business"), ("a", "c", "presentation", "business"), ("b", "b", "business", "business"), ("c", "d", "business", "data")]
    ends = [("get", f"/r{i}", None, None) for i in range(9)]
    nodes, edges = system(spark, layers, crossing, ends, [("t", "f.py")])
    assert set(nodes) == {"tier_frontend", "tier_presentation", "tier_business", "db_0", *(f"ep_{i}" for i in range(6))}
    assert nodes["tier_presentation"].description == "3 files · App.tsx, c.py, d.py" and nodes["tier_business"].description == "1 files · no samples"
    assert nodes["ep_5"].label == "GET /r5" and nodes["ep_5"].y == 0.77 and nodes["ep_5"].file == ""
    # no data tier: no edges to tables, and no crossing into it
    assert set(edges) == {*(f"ep-tier-{i}" for i in range(6)), "flow-frontend-presentation", "flow-presentation-business", "cross-0"}
    assert edges["cross-0"].label == "a → b"
    nodes, edges = system(spark, [("data", 2, "m.py")], tables=[("t", None)])
    assert edges["db-tier-0"].source == "tier_data" and nodes["db_0"].file == ""
    assert system(spark) == ({}, {})


def test_dependencies(spark):
    nodes = spark.createDataFrame([(f"n{i:02d}", "core" if i % 2 else None) for i in range(60)], "id string, group string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i // 2:02d}") for i in range(1, 60)], "src string, dst string")
    placed, kept, told = views.drawn_dependencies(nodes, edges)
    at = {r.id: (r.x, r.y) for r in placed.collect()}
    assert len(at) == 48 and told.first().truncated and {r.src for r in kept.collect()} | {r.dst for r in kept.collect()} <= set(at)
    assert len(set(at.values())) == 4 * 8 and max(y for _, y in at.values()) == 0.92 * 720  # the canvas ends
    placed, kept, told = views.drawn_dependencies(nodes.limit(0), edges)
    assert placed.count() == 0 and kept.count() == 0 and not told.first().truncated


def test_class_relations(spark):
    nodes = spark.createDataFrame([("1", "Class", "A"), ("2", "Class", None), ("3", "Function", "f")], "id string, label string, name string")
    edges = spark.createDataFrame([("1", "EXTENDS", "2"), ("1", "IMPLEMENTS", "3"), ("1", "CALLS", "2"), ("3", "EXTENDS", "1"), ("1", "EXTENDS", "9")], "src string, type string, dst string")
    assert [tuple(r) for r in views.class_relations(nodes, edges).collect()] == [("A", "", "EXTENDS"), ("A", "f", "IMPLEMENTS")]
    classes = spark.createDataFrame([(f"C{i:02d}", ["m"] * 9) for i in range(30)], "name string, methods array<string>")
    ties = spark.createDataFrame([(f"C{i:02d}", "B", "USES") for i in range(30)], "source string, target string, type string")
    text = diagrams.class_diagram(classes, ties).first().text
    assert text.count("class C") == 20 and text.count("+m()") == 120 and text.count("-->") == 25


def test_derivations(spark):
    """They are what the whole graph has of classes: bases of the same file first, functions and methods as bases, names that stand for nothing."""
    shape = "file string, functions array<struct<name:string,start_line:int,end_line:int>>, classes array<struct<name:string,methods:array<struct<name:string,start_line:int,end_line:int>>,bases:array<string>,implements:array<string>>>, imports array<struct<module:string,names:array<string>,is_external:boolean>>, api_endpoints array<struct<route:string,method:string,handler:string>>, calls array<struct<caller:string,callee:string,receiver:string>>"
    a_class = lambda name, bases, implements, *methods: (name, [(m, 1, 2) for m in methods], bases, implements)
    rows = [
        ("a.py", [("make", 1, 2), ("other", 1, 2)], [a_class("A", ["B", "B"], ["make", "run"]), a_class("B", ["nothing", ""], None, "run")], [], [], []),
        ("b.py", [("make", 1, 2)], [a_class("B", ["A"], ["A"], "A"), a_class("C", ["B"], ["make"])], [], [], []), ("c.py", None, None, None, None, None),
    ]
    parsed = spark.createDataFrame(rows, shape)
    nodes, edges = graph.derivations(parsed.select("file", "functions", "classes"), "r")
    all_nodes, all_edges = graph.build(parsed, spark.createDataFrame([], "file string, content string"), "r")
    of = lambda df: sorted(tuple(r) for r in df.where("type in ('EXTENDS', 'IMPLEMENTS')").select("src", "type", "dst").collect())
    assert of(edges) == of(all_edges) and len(of(edges)) == 7
    show = lambda n, e: [tuple(r) for r in views.class_relations(n, e).collect()]
    assert show(nodes, edges) == show(all_nodes, all_edges) and ("B", "A", "EXTENDS") in show(nodes, edges)
    assert "other" not in {r.name for r in nodes.collect()}


def test_class_relations_stage_little(spark, sf):
    """The query writes the classes and names that it needs, not the graph of all files."""
    held = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = held()
    assert catalogue.QUERIES["class_relations"](spark, sf).count() == 60
    assert held() - before < 0.5 * sum(Path(sf, f"{t}.parquet").stat().st_size for t in ("orders", "lineitem"))


def test_report_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    text = views.report_text("me/shop", none("label string, n long"), none("ord int, name string, n long"), none("ord int, title string, text string")).first().text
    assert text.startswith("# Diagrams of `me/shop`\n\nDrawn from 0 nodes")


def test_repaired_json(spark):
    from graphloom.functions import text as T

    cases = {
        '{"a": 1}': '{"a": 1}', '```json\n{"a": "}"}\n```': '{"a": "}"}', "```\n[1, 2]\n```": "[1, 2]", 'Sure: {"a": {"b": "\\"}"}} and {"c": 2}': '{"a": {"b": "\\"}"}}', "no json": None, "": None,
        "{broken": None, 'a {"x": "{"} b': '{"x": "{"}', '} {"k": []} {': '{"k": []}', "set {x} is not, {\"y\": 1} is": '{"y": 1}',
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, None)], "i int, t string").select("i", T.repaired_json(F.col("t")).alias("j"), F.try_parse_json(T.repaired_json(F.col("t"))).cast("string").alias("v")).collect()
    got = {r.i: r.j for r in rows}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] is None
    assert all((r.j is None) == (r.v is None) for r in rows) and json.loads(got[3]) == {"a": {"b": '"}'}}


def test_small_texts(spark):
    from graphloom.functions import text as T

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    compact = lambda n: one(T.compact(F.lit(n).cast("double")))
    assert [compact(n) for n in (0, 7, 999, 1000, 12_500, 999_949, 999_950, 1_000_000, 2_340_000_000, 7.2e12, -1500, 3.14159)] == ["0", "7", "999", "1K", "12.5K", "999.9K", "1M", "1M", "2.3B", "7.2T", "-1.5K", "3.1"]
    assert [one(T.initials(F.lit(n))) for n in ("ada lovelace", "me/my-shop", "  x ", "", "a_b c")] == ["AL", "MM", "X", "", "AB"]
    imports = F.array(*(F.struct(F.lit(m).alias("module"), F.array(*map(F.lit, n)).cast("array<string>").alias("names")) for m, n in (("os", ["path", "sep"]), ("sys", ["*"]), ("", ["x"]), ("y", []))))
    assert one(T.imports_text(imports)) == "from os import path, sep\nimport sys\nimport x\nfrom y import "
    assert one(T.imports_text(F.lit(None).cast("array<struct<module:string,names:array<string>>>"))) == ""
    files, names = F.array(F.lit("a.py"), F.lit("b.py")), F.array(F.lit("f"))
    assert one(T.with_references(F.lit(" See a.py. "), files, names)) == "See a.py.\n\n**Functions referenced:** `f`"
    assert one(T.with_references(F.lit("Yes"), files, F.array().cast("array<string>"))) == "Yes\n\n**Files referenced:** `a.py`, `b.py`" and one(T.with_references(F.lit("  "), files, names)) == ""
