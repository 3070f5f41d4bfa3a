"""Texts, sheets and counts of result graphs on small tables."""

import datetime
import re

import pytest
from test_graph import graph, q, rows

from loomgraph.functions import text
from loomgraph.operators import result
from loomgraph.plans import compiler, counting
from loomgraph.sources import files, schema, sexpr
from pyspark.sql import functions as F


def test_times_names_and_terms(spark):
    times = [datetime.datetime(2024, 1, 31, 10, 20, 30), datetime.datetime(1999, 12, 31, 23, 59, 59, 1200), None]
    titles = ["A, b-c:  d_e", " é! x ", "", None, "..."]
    got = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(text.iso_time(F.col("t"))).collect()
    assert [r[0] for r in got] == [t and t.isoformat() for t in times]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(text.file_name(F.col("t"), F.lit(7))).collect()
    assert [r[0] for r in got] == [None if t is None else "-".join(re.sub(r"[^\w\s]", "", t).split()) + "-7" for t in titles]
    swapped = spark.createDataFrame([("GO:0005575",), (None,)], "t string").select(text.term_id(F.col("t")), text.term_name(text.term_id(F.col("t"))))
    assert [tuple(r) for r in swapped.collect()] == [("go_0005575", "GO:0005575"), (None, None)]


def test_a_hub_gets_pages_and_every_line_once(spark):
    nodes = spark.createDataFrame([("a 1", "hub"), ("a 2", None), *[(f"b {i}", f"n{i}") for i in range(200)]], "id string, name string")
    edges = spark.createDataFrame([("e", "a 1", f"b {i}") for i in range(200)] * 2 + [("e", "a 2", "b 7"), ("e", "a 3", "c 1")], "label string, source string, target string")
    got = result.source_texts(result.source_summaries(nodes, edges, text.description(["name"])), page=10).collect()
    hub = [r for r in got if r.source == "a 1"]
    assert len(hub) == len({r.page for r in hub}) <= 20 and max(r.text.count("\n") for r in hub) < 40
    lines = [x for r in hub for x in r.text.split("\n")]
    assert lines.count("Source Node (1): Name: hub") == 1
    assert sorted(x for x in lines if not x.startswith("Source")) == sorted(f"e -> Target Node (b {i}): Name: n{i}" for i in range(200))
    assert sorted((r.page, r.text) for r in got if r.source != "a 1") == [(0, "Source Node (2): \ne -> Target Node (b 7): Name: n7"), (0, "Source Node (3): \ne -> Target Node (c 1): ")]
    assert result.source_texts(result.source_summaries(nodes.limit(0), edges.limit(0), text.description(["name"]))).count() == 0


def test_lines_of_texts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(result, "TASK_LINES", 100)
    nodes = spark.createDataFrame([(f"b {i}", f"n{i}") for i in range(600)], "id string, name string")
    edges = spark.createDataFrame([("e", f"a {i % 3}", f"b {i}") for i in range(600)] * 2, "label string, source string, target string")
    about = result.source_summaries(nodes, edges, text.description(["name"]))
    for rows, tasks in ((None, 12), (2000, 20)):
        got = result.source_texts(about, page=10, rows=rows)
        assert got._jdf.queryExecution().executedPlan().toString().count(f", {tasks}), REPARTITION_BY_NUM") >= 2
        assert sum(r.text.count("e -> ") for r in got.collect()) == 600


def test_sheets(spark, tmp_path):
    long = "x" * 40
    nodes = spark.createDataFrame([("g", "a", "2 a nodes"), ("b 1", "b", "one"), ("x 1", long, "x")], "id string, type string, name string")
    members = spark.createDataFrame([("g", "a 1"), ("g", "a 2"), ("g", "a 3")], "parent string, child string")
    grouped = spark.createDataFrame([("a 1", "first"), ("a 2", None)], "id string, name string")
    sheets = files.node_sheets(nodes, members, grouped)
    want = [("a", "g", "a", "a 1", "first"), ("a", "g", "a", "a 2", "a 2"), ("a", "g", "a", "a 3", "a 3"), ("b", "b 1", "b", None, "one"), (long[:31], "x 1", long, None, "x")]
    assert rows(sheets) == sorted(want, key=str)
    edges = spark.createDataFrame([("a_e_b", "e", "g", "b 1"), ("a_e_c", "e", "g", "c 9"), ("x", "f", "x 1", "b 1")], "edge_id string, label string, source string, target string")
    assert rows(files.edge_sheets(nodes, edges).select("sheet", "source", "target")) == sorted([("a-relationship-b", "g", "b 1"), ("a-relationship-c", "g", "c 9"), (long[:31], "x 1", "b 1")], key=str)
    files.write_workbook(sheets, str(tmp_path / "book"))
    assert rows(spark.read.csv(str(tmp_path / "book"), header=True).select("id", "member").where("sheet = 'a'")) == [("g", "a 1"), ("g", "a 2"), ("g", "a 3")]


def test_graphs_that_hold_nothing(spark, tmp_path):
    gone = files.read_graph_json(spark, str(tmp_path / "nowhere"))
    (tmp_path / "g.json").write_text('{"nodes": [], "edges": []}')
    empty = files.read_graph_json(spark, str(tmp_path / "g.json"))
    (tmp_path / "h.json").write_text('{"nodes": [{"data": {"id": "a"}}], "edges": []}')
    half = files.read_graph_json(spark, str(tmp_path / "h.json"))
    assert [f.count() for f in (*gone, *empty, *half)] == [0, 0, 0, 0, 1, 0]
    assert gone[0].columns == ["id", "type", "name"] and empty[1].columns == half[1].columns == ["edge_id", "label", "source", "target"]


def test_values_as_expressions(spark):
    v = spark.createDataFrame([(1, "a b", True, 2.5, ["x", 'q"'], {"k": 1}), (2, "sym", None, None, None, None), (3, 'a"\\(', False, 0.0, [], {})], "id long, t string, b boolean, f double, l array<string>, m map<string,int>")
    got = {}
    for r in sexpr.property_lines(v, "n").collect():
        got.setdefault(r.id, []).append(r.line)
    assert got[1] == ['(t (n 1) "a b")', "(b (n 1) true)", "(f (n 1) 2.5)", r'(l (n 1) "[\"x\",\"q\\\"\"]")', r'(m (n 1) "{\"k\":1}")']
    assert got[2] == ["(t (n 2) sym)"]
    assert got[3] == [r'(t (n 3) "a\"\\(")', "(b (n 3) false)", "(f (n 3) 0.0)", '(l (n 3) "[]")', '(m (n 3) "{}")']
    shown = v.select(*[sexpr.value_text(F.col(f.name), f.dataType) for f in v.schema]).collect()
    assert tuple(shown[1]) == ("2", "sym", *['"null"'] * 4)


def test_schemas_of_sources(spark):
    node = {"represented_as": "node", "properties": {"name": "str"}}
    edge = lambda a, b: {"represented_as": "edge", "source": a, "target": b, "input_label": "e"}
    schemas = {"One": schema.GraphSchema.of({"a": node, "b": node, "c": node, "x": edge("a", "b"), "y": edge("a", "z")}), "two": schema.GraphSchema.of({"d": node, "a": node}), "three": schema.GraphSchema.of({"a": node, "b": node, "x": edge("a", "b")})}
    got = lambda *w: tuple(rows(f) for f in schema.of_sources(spark, schemas, w))
    assert got("ONE", "nowhere") == ([("a",), ("b",)], [("a", "e", "b"), ("a", "e", "z")])
    assert got("two") == ([("a",), ("d",)], [])
    assert got("all") == ([("a",), ("b",), ("d",)], [("a", "e", "b"), ("a", "e", "z")])
    assert got() == got("nowhere") == ([], [])


def test_form_inputs(spark):
    v = spark.range(300).selectExpr("id", "concat('n', id) AS name", "CAST(id % 3 AS string) AS kind", "id % 2 = 0 AS even", "id / 2 AS half", "array(id) AS list", "CAST(NULL AS string) AS none", "CAST(id % 60 AS string) AS sixty")
    got = schema.form_inputs(v, 50).collect()
    assert sorted((r.name, r.input, r.option or "") for r in got) == sorted([("name", "input", ""), *[("kind", "combobox", x) for x in "012"], ("even", "combobox", "true"), ("even", "combobox", "false"), ("half", "number", ""), ("none", "input", ""), ("sixty", "input", "")])
    assert sorted(r.name for r in schema.form_inputs(v.limit(0)).collect()) == ["even", "half", "kind", "name", "none", "sixty"]
    assert schema.form_inputs(v.select("id", "half")).count() == 1


PATTERNS = {
    "chain": q([("x", "a"), ("y", "b"), ("z", "a")], [("e", "x", "y"), ("e", "z", "y")]),
    "cycle": q([("x", "a"), ("y", "b")], [("e", "x", "y"), ("f", "x", "y")]),
    "apart": q([("x", "a"), ("y", "b"), ("z", "a", "2")], [("e", "x", "y")]),
    "half empty": q([("x", "a"), ("y", "b"), ("z", "a", "77")], [("e", "x", "y")]),
    "nodes": q([("x", "a"), ("y", "a")]),
}


@pytest.mark.parametrize("name", PATTERNS)
def test_occurrences(spark, name):
    query = PATTERNS[name]
    small = graph(spark, {"a": [(1, "x"), (2, "y"), (3, None)], "b": [1, 2]}, {("a", "e", "b"): [(1, 1), (1, 2), (2, 2), (9, 1), (3, 2)], ("a", "f", "b"): [(1, 1), (3, 2)]})
    found = compiler.bindings(small, query).collect()
    want = {}
    for t in {n.type for n in query.nodes}:
        want["node", t] = len({r[f"{n.node_id}__id"] for r in found for n in query.nodes if n.type == t})
    for t in {e.name for e in query.edges}:
        want["edge", t] = len(found) * sum(e.name == t for e in query.edges)
    assert {(r.kind, r.label): int(r["count"]) for r in counting.occurrence_counts(small, query).collect()} == want
    assert int(counting.match_count(small, query).first()[0]) == len(found)
