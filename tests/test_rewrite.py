"""Checks and rewrites of requests."""

import pytest

from loomgraph.plans import rewrite
from loomgraph.plans.model import QueryGraph

TRIPLES = {"gene_transcribes_to_transcript", "transcript_translates_to_protein"}


def request(**changes):
    base = {
        "nodes": [{"node_id": "n-1", "id": "", "type": "gene", "properties": {"chr": "3"}}, {"node_id": "n_2", "id": "ENST1", "type": "transcript"}],
        "predicates": [{"type": "transcribes to", "source": "n-1", "target": "n_2"}],
    }
    return base | changes


def broken(part, index, **changes):
    r = request()
    r[part][index] = {k: v for k, v in (r[part][index] | changes).items() if v is not ...}
    return r


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        ({"predicates": []}, "'nodes' key is missing"),
        (request(nodes={}), "'nodes' must be a list"),
        (request(nodes=["x"]), "must be a dictionary"),
        (broken("nodes", 0, id=...), "'id' is required for each node"),
        (broken("nodes", 0, type=""), "'type' is required for each node"),
        (broken("nodes", 0, node_id=...), "'node_id' is required for each node"),
        (broken("nodes", 0, node_id="n2"), "duplicate node_id 'n2'"),
        ({"nodes": request()["nodes"]}, "'predicates' key is missing"),
        (request(predicates={}), "'predicates' must be a list"),
        (broken("predicates", 0, type=...), "'type' is required for each predicate"),
        (broken("predicates", 0, source=""), "'source' is required for each predicate"),
        (broken("predicates", 0, target=...), "'target' is required for each predicate"),
        (broken("predicates", 0, source="x"), "source node 'x' does not exist"),
        (broken("predicates", 0, target="x"), "target node 'x' does not exist"),
        (broken("predicates", 0, type="eats"), "invalid predicate 'eats': no such relationship between 'gene' and 'transcript'"),
        (request(predicates=[]), "disconnected subgraph"),
    ],
)
def test_what_is_wrong_is_said(bad, message):
    with pytest.raises(ValueError, match=message):
        rewrite.validate(bad, TRIPLES)


def test_a_good_request_is_filled_in():
    q = rewrite.validate(request(), TRIPLES)
    assert [n.node_id for n in q.nodes] == ["n1", "n2"]
    assert q.nodes[0].properties == {"chr": "chr3"} and q.edges[0].predicate_id == "p0"
    assert rewrite.validate(request(predicates=[]), TRIPLES, node_only=True).edges == ()


def test_virtual_predicates_need_spans_only():
    r = {"nodes": [{"node_id": "a", "id": "", "type": "gene"}, {"node_id": "b", "id": "", "type": "snp"}], "predicates": [{"type": "overlaps with", "source": "a", "target": "b"}]}
    assert rewrite.validate(r, set(), spans={"gene", "snp"}).edges
    with pytest.raises(ValueError, match="invalid predicate"):
        rewrite.validate(r, set(), spans={"gene"})


def test_ids_that_are_names_become_filters():
    q = QueryGraph.of({"nodes": [{"node_id": "a", "id": "SFN", "type": "gene"}, {"node_id": "b", "id": "ENSG01", "type": "gene"}, {"node_id": "c", "id": "P1", "type": "protein"}]})
    a, b, c = rewrite.names_from_ids(q).nodes
    assert (a.id, a.properties) == ("", {"gene_name": "SFN"}) and b.id == "ensg01" and c.id == "p1"
    assert rewrite.names_from_ids(q, lower=False).nodes[1].id == "ENSG01"


def test_the_fingerprint_ignores_names_and_order():
    nodes = [{"node_id": "x", "id": "E1", "type": "gene"}, {"node_id": "y", "id": "", "type": "protein", "properties": {"name": "p"}}, {"node_id": "z", "id": "", "type": "transcript"}]
    edges = [{"type": "a", "source": "x", "target": "z"}, {"type": "b", "source": "z", "target": "y"}]
    one = QueryGraph.of({"nodes": nodes, "predicates": edges})
    other = {"x": "q", "y": "r", "z": "s"}
    two = QueryGraph.of({"nodes": [n | {"node_id": other[n["node_id"]]} for n in reversed(nodes)], "predicates": [{**e, "source": other[e["source"]], "target": other[e["target"]]} for e in reversed(edges)]})
    prints = [rewrite.fingerprint(rewrite.canonical(q)[0], species="human") for q in (one, two)]
    assert prints[0] == prints[1] != rewrite.fingerprint(rewrite.canonical(one)[0], species="fly")


def test_selective_edges_come_first_and_touch_what_is_bound():
    nodes = [{"node_id": x, "id": "7" if x == "d" else "", "type": "t", "properties": {"gene_name": "g"} if x == "b" else {}} for x in "abcde"]
    edges = [{"type": "e", "source": a, "target": b, "predicate_id": a + b} for a, b in (("a", "c"), ("a", "b"), ("c", "e"), ("e", "d"))]
    q = rewrite.ordered(QueryGraph.of({"nodes": nodes, "predicates": edges}))
    assert [e.predicate_id for e in q.edges] == ["ed", "ce", "ac", "ab"]
