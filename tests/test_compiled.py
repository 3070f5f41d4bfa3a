"""Compiled graphs: dense ids, offsets, rebuilds of what changed and nothing else, builds that die."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from test_graph import q, rows

from loomgraph.plans import compiler
from loomgraph.sources import compiled, store
from loomgraph.sources.catalog import GraphCatalog

A, B, E = [(3, "x"), (1, "y"), (7, None), (7, "a")], [("b2",), ("b1",)], [(1, "b1", 0), (3, "b2", 1), (3, "b1", 2), (9, "b1", 3), (7, None, 4)]


def put(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(path)


@pytest.fixture
def inputs(spark, tmp_path):
    put(spark, f"{tmp_path}/in/a", A, "id long, name string")
    put(spark, f"{tmp_path}/in/b", B, "id string")
    put(spark, f"{tmp_path}/in/e", E, "src long, dst string, uid long")
    at = lambda n: compiled.Source.parquet(f"{tmp_path}/in/{n}")
    return str(tmp_path), {"a": at("a"), "b": at("b")}, {("a", "e", "b"): at("e")}


def test_dense_ids_and_offsets(spark, inputs):
    tmp, v, e = inputs
    assert compiled.build(spark, f"{tmp}/g", v, e) == ["a", "b", "a_e_b"]
    g = compiled.CompiledGraph.open(spark, f"{tmp}/g")
    assert rows(g.vertices("a")) == [(0, 1, "y"), (1, 3, "x"), (2, 7, None)]  # the least row of a repeated id
    assert rows(g.vertices("b")) == [(0, "b1"), (1, "b2")]
    assert rows(g.edges("a", "e", "b").select("at", "src", "dst", "uid")) == [(0, 0, 0, 0), (1, 1, 0, 2), (2, 1, 1, 1)]
    assert rows(g.offsets("a", "e", "b")) == [(0, 0, 1), (1, 1, 2)]
    assert g.manifest["edges"]['["a", "e", "b"]']["dangling"] == 2
    assert rows(g.neighbours(("a", "e", "b"), [1, 2]).select("dst")) == [(0,), (1,)]
    assert g.neighbours(("a", "e", "b"), []).count() == 0
    with pytest.raises(ValueError, match="no vertices"):
        compiled.build(spark, f"{tmp}/g2", {"a": v["a"]}, e)
    with pytest.raises(ValueError, match="no compiled graph"):
        compiled.CompiledGraph.open(spark, f"{tmp}/elsewhere")


def test_patterns_over_dense_ids(spark, inputs):
    tmp, v, e = inputs
    compiled.build(spark, f"{tmp}/g", v, e)
    g = compiled.CompiledGraph.open(spark, f"{tmp}/g")
    plain = GraphCatalog(spark, {x: s.read(spark, s.paths).groupBy("id").agg(*[F.min(c).alias(c) for c in s.read(spark, s.paths).columns if c != "id"]) if x == "a" else s.read(spark, s.paths) for x, s in v.items()}, {t: s.read(spark, s.paths) for t, s in e.items()})
    for query in (q([("x", "a"), ("y", "b")], [("e", "x", "y")]), q([("x", "a", "3"), ("y", "b")], [("e", "x", "y")]), q([("x", "a", "77"), ("y", "b")], [("e", "x", "y")]), q([("x", "a", "", {"name": "y"}), ("y", "b", "b1")], [("e", "x", "y")])):
        want = compiler.bindings(plain, query).select("x__id", "y__id", "p0__uid")
        assert rows(compiler.bindings(g.catalog(), g.dense(query)).select("x__original", "y__original", "p0__uid")) == rows(want)


def made_by(spark, tmp, v, e, group):
    """What a build made, and how many jobs it ran."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = compiled.build(spark, f"{tmp}/g", v, e)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_only_what_changed_is_made_anew(spark, inputs):
    tmp, v, e = inputs
    first, jobs = made_by(spark, tmp, v, e, "first")
    assert first and jobs
    before = open(f"{tmp}/g/manifest.json").read()
    assert made_by(spark, tmp, v, e, "second") == ([], 0)  # no job: nothing was read
    assert open(f"{tmp}/g/manifest.json").read() == before
    time.sleep(0.01)
    put(spark, f"{tmp}/in/e", E[:1], "src long, dst string, uid long")
    old = compiled.CompiledGraph.open(spark, f"{tmp}/g")
    assert made_by(spark, tmp, v, e, "third")[0] == ["a_e_b"]
    assert compiled.CompiledGraph.open(spark, f"{tmp}/g").edges("a", "e", "b").count() == 1
    assert old.edges("a", "e", "b").count() == 3  # a reader of the old graph keeps it
    put(spark, f"{tmp}/in/b", [*B, ("b0",)], "id string")
    assert made_by(spark, tmp, v, e, "fourth")[0] == ["b", "a_e_b"]  # the dictionary has changed
    assert rows(compiled.CompiledGraph.open(spark, f"{tmp}/g").edges("a", "e", "b").select("dst")) == [(1,)]
    assert len(compiled.vacuum(spark, f"{tmp}/g")) == 3 and compiled.vacuum(spark, f"{tmp}/g") == []
    assert compiled.CompiledGraph.open(spark, f"{tmp}/g").edges("a", "e", "b").count() == 1


def test_a_build_that_dies_changes_nothing(spark, inputs, monkeypatch):
    tmp, v, e = inputs
    compiled.build(spark, f"{tmp}/g", v, e)
    put(spark, f"{tmp}/in/a", [(5, "new")], "id long, name string")
    monkeypatch.setattr(compiled, "replace_text", lambda *a: (_ for _ in ()).throw(OSError("dead")))
    with pytest.raises(OSError, match="dead"):
        compiled.build(spark, f"{tmp}/g", v, e)
    monkeypatch.undo()
    assert compiled.CompiledGraph.open(spark, f"{tmp}/g").vertices("a").count() == 3
    assert compiled.build(spark, f"{tmp}/g", v, e) == ["a", "a_e_b"]
    assert compiled.CompiledGraph.open(spark, f"{tmp}/g").vertices("a").count() == 1


def test_anchored_reads_skip_row_groups(spark, tmp_path):
    put(spark, f"{tmp_path}/a", [(i,) for i in range(4000)], "id long")
    put(spark, f"{tmp_path}/e", [(i, (i * 7) % 4000, i) for i in range(4000)], "src long, dst long, uid long")
    compiled.build(spark, f"{tmp_path}/g", {"a": compiled.Source.parquet(f"{tmp_path}/a")}, {("a", "e", "a"): compiled.Source.parquet(f"{tmp_path}/e")})
    g = compiled.CompiledGraph.open(spark, f"{tmp_path}/g")
    found = g.neighbours(("a", "e", "a"), [11])
    assert "GreaterThanOrEqual(at,11)" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.src, r.dst) for r in found.collect()] == [(11, 77)]
    bounds = g.edges("a", "e", "a").groupBy(F.input_file_name()).agg(F.min("at"), F.max("at")).collect()
    spans = sorted((b[1], b[2]) for b in bounds)
    assert len(spans) > 1 and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))  # a file for each range


def test_order_of_graph_files():
    assert compiled.in_order(["d/b.metta", "d/x.tmp.metta", "a/z.metta", "z/type_defs.metta"]) == ["z/type_defs.metta", "a/z.metta", "d/b.metta"]


def test_store(spark, tmp_path):
    assert store.read_text(spark, f"{tmp_path}/x.json") is None and store.age(spark, f"{tmp_path}/x.json") is None
    assert store.create_text(spark, f"{tmp_path}/d/x.json", "1") and not store.create_text(spark, f"{tmp_path}/d/x.json", "2")
    store.replace_text(spark, f"{tmp_path}/d/x.json", json.dumps({"ü": 3}))
    assert json.loads(store.read_text(spark, f"{tmp_path}/d/x.json")) == {"ü": 3} and store.children(spark, f"{tmp_path}/d") == ["x.json"]
    assert 0 <= store.age(spark, f"{tmp_path}/d/x.json") < 100 and store.exists(spark, f"{tmp_path}/d")
    assert store.listed(spark, [f"file://{tmp_path}/d"])[0][1] == os.path.getsize(f"{tmp_path}/d/x.json")
    with pytest.raises(FileNotFoundError):
        store.listed(spark, [f"{tmp_path}/nowhere"])
    assert store.children(spark, f"{tmp_path}/nowhere") == []
