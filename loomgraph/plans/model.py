"""The query graph, an immutable description on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class NodePattern:
    node_id: str
    type: str
    id: str = ""
    properties: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class EdgePattern:
    predicate_id: str
    type: str
    source: str
    target: str
    properties: Mapping[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.type.replace(" ", "_")


@dataclass(frozen=True)
class QueryGraph:
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...] = ()

    def node(self, node_id: str) -> NodePattern:
        return next(n for n in self.nodes if n.node_id == node_id)

    @classmethod
    def of(cls, request: Mapping[str, Any]) -> QueryGraph:
        """From a request; edges without an id are numbered, missing ids and properties are empty."""
        nodes = tuple(NodePattern(n["node_id"], n["type"], str(n.get("id") or ""), dict(n.get("properties") or {})) for n in request["nodes"])
        edges = tuple(EdgePattern(p.get("predicate_id") or f"p{i}", p["type"], p["source"], p["target"], dict(p.get("properties") or {})) for i, p in enumerate(request.get("predicates", [])))
        return cls(nodes, edges)

    def request(self) -> dict[str, Any]:
        return {
            "nodes": [{"node_id": n.node_id, "id": n.id, "type": n.type, "properties": dict(n.properties)} for n in self.nodes],
            "predicates": [{"predicate_id": e.predicate_id, "type": e.type, "source": e.source, "target": e.target, "properties": dict(e.properties)} for e in self.edges],
        }
