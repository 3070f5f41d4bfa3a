"""One call from a request to its answer: graph, total count and counts by label, kept under the request's fingerprint.

The request is checked, put into canonical form and fingerprinted; what an equal request has computed is read back.
Otherwise the pattern is compiled once, patterns with cycles by a generic join; counts of patterns without cycles go by messages and
never see the bindings. The counts are of all matches, also where the graph that is shown is capped.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import result
from loomgraph.plans import compiler, counting, generic
from loomgraph.plans.model import QueryGraph
from loomgraph.plans.rewrite import VIRTUAL, canonical, fingerprint, validate
from loomgraph.sources import files
from loomgraph.sources.catalog import GraphCatalog
from loomgraph.sources.results import KEPT, kept_or_computed


@dataclass(frozen=True)
class Answer:
    """``nodes(id, type, name)``, ``edges(edge_id, label, source, target)``, ``totals(total_nodes, total_edges)`` and
    ``labels(kind, label, count)``, read from the kept results; ``query`` is the canonical form."""

    fingerprint: str
    query: QueryGraph
    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame
    labels: DataFrame

    def export(self, path: str) -> None:
        """Tab-separated ``nodes`` and ``edges`` below ``path``."""
        files.write_tsv(self.nodes, self.edges, path)


def answer(catalog: GraphCatalog, request: Mapping[str, Any], base: str, *, species: str = "", sources: Collection[str] = (), spans: Collection[str] = (), cap: int | None = None, anew: bool = False, kept: float | None = KEPT) -> Answer:
    """The answer to a request; a ``ValueError`` says what is wrong with one.

    Results lie below ``base`` and are good for ``kept`` seconds; ``anew`` computes them again. ``sources`` restricts edges
    to these data sources. The whole graph is shown; with a ``cap``, of more edges those first by source, label and target, with
    their ends, and without edges the first nodes by id. Equal requests in other words (names, order) share their results.
    """
    query, _ = canonical(validate(request, catalog.triple_keys(), spans=spans))
    key = fingerprint(query, species=species, data_source=sorted(sources), limit=cap)
    own = catalog.of_sources(sources) if sources else catalog
    tree = counting.trees(query) is not None

    def found() -> DataFrame:
        closes = not tree and not any(e.name in VIRTUAL for e in query.edges)
        return generic.cyclic_bindings(own, query) if closes else compiler.bindings(own, query)

    def held(part: str, compute) -> DataFrame:
        return kept_or_computed(catalog.spark, base, f"{key}-{part}", compute, anew=anew, kept=kept)

    def shown(rows: DataFrame, *order: str) -> DataFrame:
        return rows if cap is None else rows.orderBy(*order).limit(cap)

    if query.edges:
        edges = held("edges", lambda: shown(result.shape_edges(found(), query), "source", "label", "target", "edge_id"))
        ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        nodes = held("nodes", lambda: _named(own, query).join(ends, "id", "left_semi"))
    else:
        nodes = held("nodes", lambda: shown(result.shape_nodes(found(), query), "id"))
        edges = catalog.spark.createDataFrame([], "edge_id string, label string, source string, target string")
    totals = held("totals", lambda: counting.total_counts(own, query) if tree else result.total_counts(found(), query))
    labels = held("labels", lambda: counting.label_counts(own, query) if tree else result.label_counts(found(), query))
    return Answer(key, query, nodes, edges, totals, labels)


def _named(catalog: GraphCatalog, query: QueryGraph) -> DataFrame:
    """The vertices of the request's types by name, whatever their matches: the caller keeps those it shows."""
    bare = QueryGraph(tuple({n.type: n for n in query.nodes}.values()))
    parts = []
    for n in bare.nodes:
        v = catalog.vertices(n.type)
        names = [F.col(c).cast("string") for c in result.NAMES if c in v.columns]
        parts.append(v.select(result.key(n.type, F.col("id")).alias("id"), F.lit(n.type).alias("type"), F.coalesce(*names, result.key(n.type, F.col("id"))).alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id", "type").agg(F.min("name").alias("name"))
