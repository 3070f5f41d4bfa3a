"""Checks and rewrites of a request before it is compiled. All of it is on the driver and small."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Mapping
from dataclasses import replace
from typing import Any

from loomgraph.plans.model import EdgePattern, NodePattern, QueryGraph

VIRTUAL = frozenset({"overlaps_with"})

# The messages that clients of the query interface know.
NO_NODES = "'nodes' key is missing from the request"
NODES_LIST = "'nodes' must be a list"
NODE_DICT = "each item in 'nodes' must be a dictionary"
NODE_NEEDS = "'{}' is required for each node"
NODE_TWICE = "duplicate node_id '{}': node IDs must be unique within the request"
NO_PREDICATES = "'predicates' key is missing from the request"
PREDICATES_LIST = "'predicates' must be a list"
PREDICATE_NEEDS = "'{}' is required for each predicate"
NO_END = "{} node '{}' does not exist in the nodes list"
NO_TRIPLE = "invalid predicate '{}': no such relationship between '{}' and '{}'"
DISCONNECTED = "disconnected subgraph: all nodes must be connected through predicates"


def plain_id(text: str) -> str:
    return text.replace("-", "").replace("_", "")


def connected(query: QueryGraph) -> bool:
    """Whether the pattern hangs together, edges taken both ways."""
    groups = {n.node_id: {n.node_id} for n in query.nodes}
    for e in query.edges:
        joined = groups[e.source] | groups[e.target]
        for x in joined:
            groups[x] = joined
    return len({id(g) for g in groups.values()}) <= 1


def validate(request: Mapping[str, Any], triples: Collection[str], *, node_only: bool = False, spans: Collection[str] = ()) -> QueryGraph:
    """The query graph of a well-formed request; ``ValueError`` says what is wrong with another.

    ``triples`` holds the schema's ``source_type_target`` keys. Virtual predicates need no triple if
    both types are among ``spans`` (types with chr, start and end). ``chr`` values get their prefix.
    """

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(message)

    need("nodes" in request, NO_NODES)
    need(isinstance(request["nodes"], list), NODES_LIST)
    nodes: list[NodePattern] = []
    for n in request["nodes"]:
        need(isinstance(n, dict), NODE_DICT)
        need("id" in n, NODE_NEEDS.format("id"))
        for key in ("type", "node_id"):
            need(n.get(key, "") != "", NODE_NEEDS.format(key))
        properties = dict(n.get("properties") or {})
        if str(properties.get("chr") or "") and not str(properties["chr"]).startswith("chr"):
            properties["chr"] = f"chr{properties['chr']}"
        nodes.append(NodePattern(plain_id(n["node_id"]), n["type"], str(n["id"] or ""), properties))
    types: dict[str, str] = {}
    for node in nodes:
        need(node.node_id not in types, NODE_TWICE.format(node.node_id))
        types[node.node_id] = node.type
    need("predicates" in request, NO_PREDICATES)
    need(isinstance(request["predicates"], list), PREDICATES_LIST)
    edges: list[EdgePattern] = []
    for i, p in enumerate(request["predicates"]):
        for key in ("type", "source", "target"):
            need(p.get(key, "") != "", PREDICATE_NEEDS.format(key))
        ends = {key: plain_id(p[key]) for key in ("source", "target")}
        for key, end in ends.items():
            need(end in types, NO_END.format(key, end))
        a, b = types[ends["source"]], types[ends["target"]]
        name = p["type"].replace(" ", "_")
        need(f"{a}_{name}_{b}" in triples or (name in VIRTUAL and {a, b} <= set(spans)), NO_TRIPLE.format(p["type"], a, b))
        edges.append(EdgePattern(p.get("predicate_id", f"p{i}"), p["type"], ends["source"], ends["target"], dict(p.get("properties") or {})))
    query = QueryGraph(tuple(nodes), tuple(edges))
    need(node_only or connected(query), DISCONNECTED)
    return query


#: Id prefix and name property by type: an id without the prefix is a name.
NAMED_IDS = {"gene": ("ENSG", "gene_name"), "transcript": ("ENST", "transcript_name")}


def types_of(query: QueryGraph) -> list[str]:
    """The distinct vertex types of a request, in its order."""
    return list(dict.fromkeys(n.type for n in query.nodes))


def names_from_ids(query: QueryGraph, named: Mapping[str, tuple[str, str]] = NAMED_IDS, *, lower: bool = True) -> QueryGraph:
    """Ids that are names become filters on the name; other ids are lower-cased if ``lower``."""

    def one(n: NodePattern) -> NodePattern:
        prefix, key = named.get(n.type, ("", ""))
        if n.id and prefix and not n.id.upper().startswith(prefix):
            return replace(n, id="", properties={**n.properties, key: n.id})
        return replace(n, id=n.id.lower() if lower else n.id)

    return replace(query, nodes=tuple(one(n) for n in query.nodes))


def canonical(query: QueryGraph) -> tuple[QueryGraph, dict[str, str]]:
    """The query with nodes and edges in a fixed order and named ``n0, p0, ...``, and the new names by
    the old. Nodes go by type, id, properties and distance from a node with an id."""
    far = len(query.nodes) + 1
    distance = {n.node_id: 0 if n.id else far for n in query.nodes}
    for _ in query.nodes:
        for e in query.edges:
            for a, b in ((e.source, e.target), (e.target, e.source)):
                distance[b] = min(distance[b], distance[a] + 1)
    as_text = lambda properties: json.dumps(dict(properties), sort_keys=True)
    ranked = sorted(query.nodes, key=lambda n: (n.type, n.id, as_text(n.properties), distance[n.node_id]))
    new = {n.node_id: f"n{i}" for i, n in enumerate(ranked)}
    edges = [replace(e, source=new[e.source], target=new[e.target]) for e in query.edges]
    edges.sort(key=lambda e: (e.source, e.target, e.type, as_text(e.properties)))
    return QueryGraph(tuple(replace(n, node_id=new[n.node_id]) for n in ranked), tuple(replace(e, predicate_id=f"p{i}") for i, e in enumerate(edges))), new


def fingerprint(query: QueryGraph, *, species: str = "", data_source: Any = None, limit: int | None = None, node_only: bool = False, properties: bool = True) -> str:
    """The digest of all that changes a result; ``query`` is canonical."""
    parts = query.request() | {"species": species, "data_source": data_source, "limit": limit, "node_only": node_only, "properties": properties}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def selectivity(node: NodePattern) -> int:
    """0 for an id, 1 for a name, 2 for any property, 3 for none."""
    if node.id or "id" in node.properties:
        return 0
    if not node.properties:
        return 3
    return 1 if any("name" in k.lower() for k in node.properties) else 2


def ordered(query: QueryGraph, counts: Mapping[tuple[str, str, str], int] | None = None) -> QueryGraph:
    """Edges from the most selective on, each but the first touching what is bound where that is possible."""

    def rank(e: EdgePattern) -> tuple[int, int]:
        a, b = query.node(e.source), query.node(e.target)
        return min(selectivity(a), selectivity(b)), (counts or {}).get((a.type, e.name, b.type), 0)

    left, out, bound = sorted(query.edges, key=rank), [], set()
    while left:
        best = next((e for e in left if {e.source, e.target} & bound), left[0])
        left.remove(best)
        out.append(best)
        bound |= {best.source, best.target}
    return replace(query, edges=tuple(out))
