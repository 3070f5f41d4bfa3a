"""Answers to requests: graph, counts, cap, reuse and export."""

import pytest
from test_graph import graph, q, rows

from loomgraph.operators import result
from loomgraph.plans import compiler
from loomgraph.plans.answer import answer
from loomgraph.sources.catalog import GraphCatalog


@pytest.fixture
def small(spark):
    return graph(spark, {"a": [(1, "x"), (2, "y"), (3, None)], "b": [1, 2]}, {("a", "e", "b"): [(1, 1), (1, 2), (2, 2), (9, 1)], ("a", "f", "b"): [(1, 1), (3, 2)]})


REQUESTS = {
    "edge": q([("x", "a"), ("y", "b")], [("e", "x", "y")]),
    "cycle": q([("x", "a"), ("y", "b")], [("e", "x", "y"), ("f", "x", "y")]),
    "anchored": q([("x", "a", "2"), ("y", "b")], [("e", "x", "y")]),
    "node": q([("x", "a")]),
    "nothing": q([("x", "a", "77"), ("y", "b")], [("e", "x", "y")]),
}


@pytest.mark.parametrize("name", REQUESTS)
def test_answers(spark, small, tmp_path, name):
    query = REQUESTS[name]
    found = compiler.bindings(small, query)
    got = answer(small, query.request(), str(tmp_path))
    assert rows(got.nodes) == rows(result.shape_nodes(found, query))
    assert rows(got.edges) == (rows(result.shape_edges(found, query)) if query.edges else [])
    assert rows(got.totals) == rows(result.total_counts(found, query)) and rows(got.labels) == rows(result.label_counts(found, query))


def test_equal_requests_share_results_and_caps_dont_touch_counts(spark, small, tmp_path, monkeypatch):
    first = answer(small, REQUESTS["edge"].request(), str(tmp_path))
    monkeypatch.setattr(compiler, "bindings", lambda *a, **k: pytest.fail("computed again"))
    again = answer(small, q([("there", "b"), ("here", "a")], [("e", "here", "there")]).request(), str(tmp_path))
    assert again.fingerprint == first.fingerprint and rows(again.edges) == rows(first.edges)
    monkeypatch.undo()
    capped = answer(small, REQUESTS["edge"].request(), str(tmp_path), cap=1)
    assert rows(capped.edges) == rows(first.edges)[:1] and [r.id for r in capped.nodes.orderBy("id").collect()] == ["a 1", "b 1"]
    assert rows(capped.totals) == rows(first.totals)
    assert answer(small, REQUESTS["node"].request(), str(tmp_path), cap=2).nodes.count() == 2
    capped.export(str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "tsv" / "edges"), header=True).first()[:] == ("a 1", "b 1", "e")
    with pytest.raises(ValueError, match="no such relationship"):
        answer(small, q([("x", "b"), ("y", "a")], [("e", "x", "y")]).request(), str(tmp_path))


def test_without_a_cap_the_whole_graph_is_shown(spark, tmp_path):
    edges = spark.range(220_000).selectExpr("id % 200 AS src", "id div 200 AS dst", "id AS uid")
    many = GraphCatalog(spark, {"a": spark.range(200), "b": spark.range(1100)}, {("a", "e", "b"): edges})
    got = answer(many, REQUESTS["edge"].request(), str(tmp_path))
    assert got.edges.count() == 220_000 and got.nodes.count() == 1300
    assert [r[:] for r in got.totals.collect()] == [(1300, 220_000)]
