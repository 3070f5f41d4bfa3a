"""Scripts of creation statements, and property bags."""

import json

import pytest
from pyspark.sql import functions as F
from test_graph import rows

from loomgraph.functions import bags
from loomgraph.sources import scripts

NODES = r"""// comment
CREATE (a:gene {id: 'G1', gene_name: 'S\'F"N\\', start: 17, synonyms: ['A, b', "B:'}"], known: true, score: -1.5e3})
create (:gene{id:"G2"});
MERGE (g:gene {id: 'G1', start: 18, start: 19})
CREATE (t:`non coding rna` {id: 'T1', `a key`: null})
CREATE (t:gene {name: 'no id'})

what is this
"""
EDGES = """MATCH (a:gene {id: 'G1'}), (b:`non coding rna` {id: 'T1'}) MERGE (a)-[r:transcribes_to {score: 0.5, w: ['x']}]->(b);
MATCH (a:`non coding rna` {id: 'T1'}), (b:gene {id: 'G1'}) CREATE (b)-[:transcribes_to]->(a)
MATCH (a:gene {id: 'G1'}), (b:gene {id: 'G2'}) CREATE (a)-[:near]->(c)
CREATE (x:gene {id: 'in an edge file'})
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x_nodes.cypher").write_text(NODES)
    (tmp_path / "x_edges.cypher").write_text(EDGES)
    (tmp_path / "other.cypher").write_text("CREATE (a:gene {id: 'G9'})\n")
    return str(tmp_path)


def test_scripts(spark, folder, tmp_path):
    read = scripts.read_scripts(spark, folder)
    assert {r.kind: r["count"] for r in read.groupBy("kind").count().collect()} == {"vertex": 4, "edge": 2, "unknown": 3}
    genes = scripts.vertices_of(read, "gene", {"gene_name": "string", "start": "int", "synonyms": "array<string>", "known": "boolean", "score": "double", "other": "string"})
    assert rows(genes) == [("G1", "S'F\"N\\", 19, ["A, b", "B:'}"], True, -1500.0, None), ("G2", None, None, None, None, None, None)]
    assert rows(scripts.vertices_of(read, "non coding rna", {"a key": "string"})) == [("T1", None)]
    e = scripts.edges_of(read, "gene", "transcribes_to", "non coding rna", {"score": "double", "w": "array<string>"})
    assert rows(e.drop("uid")) == [("G1", "T1", 0.5, ["x"])]
    assert "Python" not in e._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty").mkdir()
    for wrong in (tmp_path / "missing", tmp_path / "empty"):
        with pytest.raises(ValueError, match="no data|no scripts"):
            scripts.read_scripts(spark, str(wrong))


def test_a_graph_written_and_read_back(spark, tmp_path):
    odd = ["it's", 'say "x"', "back\\slash", "\\", "a\\'b", "tab\there", "curly } { [x]", "", None, "é 日本", "x" * 20_000]
    v = spark.createDataFrame([(f"id {i}'", n, i, [n or "", "b"] if i % 2 else [], i / 4) for i, n in enumerate(odd)], "id string, name string, size int, many array<string>, score double")
    e = spark.createDataFrame([(f"id {i}'", f"id {i + 1}'", 0.5 * i) for i in range(5)], "src string, dst string, w double")
    lines = scripts.statements_of(v, "a label")
    lines.write.text(str(tmp_path / "s" / "n"))
    for i, f in enumerate((tmp_path / "s" / "n").glob("part-*.txt")):
        f.rename(tmp_path / "s" / f"{i}_nodes.cypher")
    scripts.statements_of(e, ("a label", "to", "a label")).coalesce(1).write.text(str(tmp_path / "s" / "e"))
    next((tmp_path / "s" / "e").glob("part-*.txt")).rename(tmp_path / "s" / "x_edges.cypher")
    read = scripts.read_scripts(spark, str(tmp_path / "s"))
    assert rows(scripts.vertices_of(read, "a label", {"name": "string", "size": "int", "many": "array<string>", "score": "double"}).orderBy("id").select(*v.columns)) == rows(v)
    assert rows(scripts.edges_of(read, "a label", "to", "a label", {"w": "double"}).drop("uid")) == rows(e)


# Bags ---------------------------------------------------------------------------------------------

BAGS = [
    {"name": "SFN", "start": "10", "end": 20, "list": ["a", "B"], "odd'key": 1},
    {"name": "sfnx", "list": "['a', 'c']", "flag": True},
    {"start": 15.7, "end": "17", "list": 'not a list', "name": None},
    {"list": '["x", "y", "z", "w"]', "deep": {"a": [1]}},
]


def bag_rows(spark):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(BAGS)] + [(8, "no json"), (9, None)], "id int, j string").select("id", bags.bag_of(F.col("j")).alias("bag"))


def kept(df, properties, **how):
    for c in bags.bag_filters(F.col("bag"), properties, **how):
        df = df.where(c)
    return [r.id for r in df.orderBy("id").collect()]


def test_filters_on_bags(spark):
    df = bag_rows(spark)
    assert kept(df, {"name": "sfn"}) == [0] and kept(df, {"name": "sfn.?"}) == [0, 1] and kept(df, {"name": "SFN"}, matching="exact") == [0]
    assert kept(df, {"list": "b"}) == [0] and kept(df, {"list": "a"}, matching="exact") == [0, 1] and kept(df, {"list": "not.*"}) == [2]
    assert kept(df, {"flag": True}, matching="exact") == [1] and kept(df, {"odd'key": 1}, matching="exact") == [0]
    assert kept(df, {"flag": None, "list": "x"}, matching="exact") == [3] and kept(df, {"missing": ".*"}) == []
    assert kept(df, {"start": 10, "end": 18}) == [2] and kept(df, {"start": 5, "end": 100}) == [0, 2] and kept(df, {"start": 5}) == [0, 1, 2, 3, 8, 9]


def test_values_of_bags(spark):
    df = bag_rows(spark)
    assert [r[0] for r in df.orderBy("id").select(bags.value_of(F.col("bag"), "end", "int")).collect()] == [20, None, 17, None, None, None]
    assert [r[0] for r in df.orderBy("id").select(bags.list_of(F.col("bag"), "list")).collect()] == [["a", "B"], ["a", "c"], ["not a list"], ["x", "y", "z", "w"], None, None]
    assert [r[0] for r in df.where("id IN (1, 3)").orderBy("id").select(bags.bag_description(F.col("bag"), ["name", "list"])).collect()] == ["Name: sfnx | List: a, c", "List: x, y, z"]
    assert df.where("id = 1").select(bags.keys_of(F.col("bag"))).first()[0] == ["flag", "list", "name"]
    made = spark.createDataFrame([(1, "a", None)], "x int, y string, z string")
    assert made.select(bags.bag_from(made, ["x", "y", "z"]).cast("string")).first()[0] == '{"x":1,"y":"a"}'
