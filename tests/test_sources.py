"""Readers, writers, schemas and incremental ingestion."""

import json

import pytest

from loomgraph.sources import files, sexpr
from loomgraph.sources.catalog import GraphCatalog
from loomgraph.sources.schema import GraphSchema
from loomgraph.streaming.ingest import ingest_sexpr

LINES = r"""; a comment
(gene G1)
(gene_name (gene G1) SFN)
(synonyms (gene G1) (YWHAS 14-3-3_protein a\(b\)))
(description (gene G1) text_with_\(parentheses\))
(transcribes_to (gene G1) (transcript T1))
(evidence (transcribes_to (gene G1) (transcript T1)) IPI)
(evidence (transcribes_to (gene G1) (transcript T1)) (IDA IEA))

what is this
"""


def test_sexpr_lines_of_every_shape(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.metta").write_text(LINES)
    parsed = sexpr.read_sexpr(spark, str(tmp_path)).cache()
    assert {r.kind: r["count"] for r in parsed.groupBy("kind").count().collect()} == {"vertex": 1, "vertex_property": 3, "edge": 1, "edge_property": 2, "unknown": 1}
    v = sexpr.vertices_of(parsed, "gene", {"gene_name": False, "synonyms": True, "description": False, "missing": False}).first()
    assert (v.id, v.gene_name, v.synonyms, v.description, v.missing) == ("G1", "SFN", ["YWHAS", "14-3-3 protein", "a(b)"], "text with (parentheses)", None)
    e = sexpr.edges_of(parsed, "gene", "transcribes_to", "transcript", ("evidence",)).first()
    assert (e.src, e.dst, e.evidence) == ("G1", "T1", ["IDA", "IEA", "IPI"])
    with pytest.raises(ValueError, match="no data"):
        sexpr.read_sexpr(spark, str(tmp_path / "missing"))


def test_new_files_are_ingested_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.metta").write_text("(gene G1)\n")
    ingest_sexpr(spark, source, out, state).awaitTermination()
    (tmp_path / "in" / "b.metta").write_text("(gene G2)\n(e (gene G1) (gene G2))\n")
    ingest_sexpr(spark, source, out, state).awaitTermination()
    ingest_sexpr(spark, source, out, state).awaitTermination()
    assert sorted(r.kind for r in spark.read.parquet(out).collect()) == ["edge", "vertex", "vertex"]


def test_node_csv_and_completion(spark, tmp_path):
    (tmp_path / "nodes_gene.csv").write_text("id|gene_name\n1|Abc\n2|abd\n3|\n")
    found = files.read_node_csv(spark, str(tmp_path))
    index = files.completion_index(found)
    assert sorted((r.id, r.label, r.name) for r in index.collect()) == [("1", "gene", "Abc"), ("2", "gene", "abd"), ("3", "gene", "3")]
    assert [r.id for r in files.complete(index, "AB").collect()] == ["1", "2"]


def test_graph_json_and_tsv(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": [{"data": {"id": "a", "type": "t", "name": "n"}}], "edges": [{"data": {"edge_id": "e", "label": "l", "source": "a", "target": "b"}}]}))
    nodes, edges = files.read_graph_json(spark, str(path))
    files.write_graph(nodes, edges, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(r.part for r in back) == ["edges", "nodes"] and json.loads(next(r.value for r in back if r.part == "nodes"))["data"]["id"] == "a"
    files.write_tsv(nodes, edges, str(tmp_path / "tsv"))
    got = spark.read.option("sep", "\t").csv(str(tmp_path / "tsv" / "edges"), header=True)
    assert got.columns == ["source", "target", "label"] and got.first()[:] == ("a", "b", "l")


def test_vcf(spark, tmp_path):
    v = spark.createDataFrame([("chr2", 5, "snp x", "A", "G", 0.5, "n;1 2"), ("chr1", 9, "snp y", None, None, None, None), ("chr1", 7, "snp z", "C", "T", None, None)], "chr string, start long, id string, ref string, alt string, caf_ref double, name string")
    files.write_vcf(v, str(tmp_path / "v"), "test")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and [x for x in lines if "contig" in x] == ["##contig=<ID=chr1>", "##contig=<ID=chr2>"]
    assert lines[-3:] == ["chr1\t7\tsnp_z\tC\tT\t.\tPASS\t.", "chr1\t9\tsnp_y\t.\t.\t.\tPASS\t.", "chr2\t5\tsnp_x\tA\tG\t.\tPASS\tCAF_REF=0.5;NAME=n_1_2"]


def test_schema_inheritance_and_triples(spark):
    base = {"position entity": {"represented_as": "node", "properties": {"chr": "str", "start": {"type": "int"}}}, "coding element": {"represented_as": "node", "properties": {"pwm": "float[]"}}}
    more = {
        "gene": {"represented_as": "node", "is_a": ["coding element", "position entity"], "inherit_properties": True, "properties": {"name": "str"}},
        "transcribes to": {"represented_as": "edge", "input_label": "transcribes_to", "source": ["gene", "non coding rna"], "target": "transcript", "properties": {"score": "float"}},
    }
    s = GraphSchema.of(base, more)
    assert s.triple_keys() == {"gene_transcribes_to_transcript", "non_coding_rna_transcribes_to_transcript"}
    assert [f.simpleString() for f in s.struct("gene")] == ["id:string", "chr:string", "start:bigint", "pwm:array<double>", "name:string"]
    assert s.relations(spark, "non coding rna").count() == 1
    assert s.node_rows(spark).where("type = 'gene'").count() == 8


def test_catalog_round_trip(spark, tmp_path):
    v = {"a": spark.createDataFrame([(1, "x")], "id long, name string")}
    e = {("a", "e", "a"): spark.createDataFrame([(1, 1, 0)], "src long, dst long, uid long")}
    GraphCatalog(spark, v, e).write(str(tmp_path))
    g = GraphCatalog.read(spark, str(tmp_path), ["a"], [("a", "e", "a")])
    assert g.counts() == {("a", "e", "a"): 1} and g.vertices("a").count() == 1
    with pytest.raises(ValueError, match="no vertices"):
        g.vertices("b")


def test_results_are_kept_by_fingerprint(spark, tmp_path):
    from loomgraph.sources.results import kept_or_computed

    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [kept_or_computed(spark, str(tmp_path), "f", make).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    assert kept_or_computed(spark, str(tmp_path), "f", make, anew=True).count() == 3 and len(calls) == 2


def test_edge_counts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"expressed_in": {"count": 5, "name": "expressed in"}}))
    assert files.read_edge_counts(spark, str(tmp_path / "c.json")).first()[:] == ("expressed_in", "expressed in", 5)
