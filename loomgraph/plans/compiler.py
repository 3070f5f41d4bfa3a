"""From a query graph to one DataFrame of bindings.

Each edge pattern is an equi-join (two keys where both ends are bound already); a vertex's filters
sit below its first join, which is with the edges that bring it. Columns are ``{variable}__{property}`` and ``{predicate}__uid``; what a
caller doesn't select is pruned down to the scans, and join strategy and order beyond the fold are
the optimizer's.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.predicates import exact, node_filters, overlaps
from loomgraph.operators.hubs import hub_join
from loomgraph.operators.overlap import overlap_join
from loomgraph.plans.model import EdgePattern, NodePattern, QueryGraph
from loomgraph.plans.rewrite import VIRTUAL, ordered
from loomgraph.session import checkpointed
from loomgraph.sources.catalog import GraphCatalog


def vertex_frame(catalog: GraphCatalog, node: NodePattern, *, matching: str = "regex", bare: bool = False) -> DataFrame:
    """The vertices that satisfy a node pattern; columns prefixed with its variable unless ``bare``."""
    v = catalog.vertices(node.type)
    for condition in node_filters(v, node.id, node.properties, matching=matching):
        v = v.where(condition)
    return v if bare else v.select(*[F.col(f"`{c}`").alias(f"{node.node_id}__{c}") for c in v.columns])


def edge_frame(catalog: GraphCatalog, query: QueryGraph, edge: EdgePattern) -> DataFrame:
    """The edges that satisfy an edge pattern's own properties; columns ``src, dst, {predicate}__...``."""
    e = catalog.edges(query.node(edge.source).type, edge.name, query.node(edge.target).type)
    kinds = dict(e.dtypes)
    for key, value in edge.properties.items():
        e = e.where(exact(F.col(f"`{key}`"), value, kinds[key]) if key in kinds else F.lit(value is None))
    return e.select(F.col("src").alias(f"{edge.predicate_id}__src"), F.col("dst").alias(f"{edge.predicate_id}__dst"), *[F.col(f"`{c}`").alias(f"{edge.predicate_id}__{c}") for c in e.columns if c not in ("src", "dst")])


def bindings(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex", isomorphic: bool = False, limit: int | None = None, counts: Mapping | None = None, hub_rows: int | None = None) -> DataFrame:
    """One row for each match of the pattern.

    Two edge patterns may match one edge unless ``isomorphic``. A limit takes the first rows in order
    of all ids, so it is the same on every run. With ``hub_rows``, vertices that have more edges than that are joined
    over grids (``operators.hubs``), which are found by a pass over each frame while the query is compiled.
    """
    query = ordered(query, counts)
    frame: DataFrame | None = None
    bound: set[str] = set()

    def meet(a: DataFrame, b: DataFrame, key: str, other: str) -> DataFrame:
        return a.join(b, F.col(key) == F.col(other)) if hub_rows is None else hub_join(a, b, key, other, chunk=hub_rows)

    def bring(var: str) -> None:
        nonlocal frame
        v = vertex_frame(catalog, query.node(var), matching=matching)
        frame = v if frame is None else frame.crossJoin(v)
        bound.add(var)

    for e in query.edges:
        if e.name in VIRTUAL:
            for var in dict.fromkeys((e.source, e.target)):
                if frame is not None and var not in bound and {e.source, e.target} & bound:
                    continue
                if var not in bound and frame is None:
                    bring(var)
            frame = _virtual(catalog, query, e, frame, bound, matching)
            continue
        if frame is None:
            bring(e.source)
        elif not {e.source, e.target} & bound:
            bring(e.source)
        edges = edge_frame(catalog, query, e)
        src, dst = f"{e.predicate_id}__src", f"{e.predicate_id}__dst"
        if e.source == e.target:
            edges = edges.where(F.col(src) == F.col(dst))
        on = [(f"{var}__id", key) for var, key in ((e.source, src), (e.target, dst)) if var in bound]
        for var, key in ((e.source, src), (e.target, dst)):
            if var not in bound:  # the edges meet their new end first: what its filters drop is never multiplied by a bound end's matches
                edges = meet(edges, vertex_frame(catalog, query.node(var), matching=matching), key, f"{var}__id")
                bound.add(var)
        frame = meet(frame, edges, *on[0]) if len(on) == 1 else frame.join(edges, reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in on]))
    for n in query.nodes:
        if n.node_id not in bound:
            bring(n.node_id)
    if isomorphic:
        same = [e for e in query.edges if e.name not in VIRTUAL]
        for a, b in combinations(same, 2):
            if a.name == b.name:
                frame = frame.where(F.col(f"{a.predicate_id}__uid") != F.col(f"{b.predicate_id}__uid"))
    if limit is not None:
        frame = frame.orderBy(*[f"{n.node_id}__id" for n in query.nodes], *[f"{e.predicate_id}__uid" for e in query.edges]).limit(limit)
    return frame


def _virtual(catalog: GraphCatalog, query: QueryGraph, e: EdgePattern, frame: DataFrame, bound: set[str], matching: str) -> DataFrame:
    """An overlap edge: a binned join for a new end, a filter where both are bound. Its identity is its ends."""
    if e.source in bound and e.target in bound:
        a, b = e.source, e.target
        frame = frame.where((F.col(f"{a}__chr") == F.col(f"{b}__chr")) & overlaps(F.col(f"{a}__start"), F.col(f"{a}__end"), F.col(f"{b}__start"), F.col(f"{b}__end")))
    else:
        have, new = (e.source, e.target) if e.source in bound else (e.target, e.source)
        frame = overlap_join(frame, vertex_frame(catalog, query.node(new), matching=matching), have, new)
        bound.add(new)
    return frame.withColumn(f"{e.predicate_id}__uid", F.xxhash64(f"{e.source}__id", f"{e.target}__id"))


def optional_nodes(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex", last_only: bool = False) -> DataFrame:
    """Node patterns without edges, each left-joined to one row, so one without matches gives nulls.

    Each node's filters sit in its own join; with ``last_only`` only the last node is filtered, and
    by dropping rows, as a single trailing condition would.
    """
    frame = catalog.spark.range(1).select()
    for i, n in enumerate(query.nodes):
        last = i == len(query.nodes) - 1
        own = n if not last_only else NodePattern(n.node_id, n.type)
        found = vertex_frame(catalog, own, matching=matching)
        # the vertices, or one row of nulls where there are none: a left join on TRUE would broadcast them all
        none = catalog.spark.range(1).join(found.select(F.lit(0).cast("long").alias("id")).limit(1), "id", "left_anti").select(*[F.lit(None).cast(t).alias(c) for c, t in found.dtypes])
        frame = frame.crossJoin(found.unionByName(none))
        if last_only and last and (n.id or n.properties):
            frame = frame.join(vertex_frame(catalog, n, matching=matching).select(f"{n.node_id}__id"), f"{n.node_id}__id", "left_semi")
    return frame


def semijoin_edges(catalog: GraphCatalog, query: QueryGraph, *, mode: str = "full", matching: str = "regex") -> DataFrame:
    """The edges that take part in matches, ``(predicate_id, source, target)``, by semi-joins.

    ``forward`` goes along the edges once and keeps what nothing later confirms; ``full`` goes back
    first, from the last edge to the first, and then forward, which for tree patterns leaves exactly
    the edges of complete matches (for a cycle use the bindings). Each visit is two semi-joins; its
    result is checkpointed, so that the plan of the next doesn't hold those before it.
    """
    query = ordered(query)
    allowed = {n.node_id: vertex_frame(catalog, n, matching=matching, bare=True).select("id") for n in query.nodes}
    kept: dict[str, DataFrame] = {}
    visits = [*(reversed(query.edges) if mode == "full" else ()), *query.edges]
    for i, e in enumerate(visits):
        edges = kept.get(e.predicate_id)
        if edges is None:
            edges = edge_frame(catalog, query, e).select(F.col(f"{e.predicate_id}__src").alias("source"), F.col(f"{e.predicate_id}__dst").alias("target")).distinct()
        for var, key in ((e.source, "source"), (e.target, "target")):
            edges = edges.join(allowed[var].select(F.col("id").alias(key)), key, "left_semi")
        edges = kept[e.predicate_id] = checkpointed(edges) if i < len(visits) - 1 else edges
        for var, key in ((e.source, "source"), (e.target, "target")):
            allowed[var] = edges.select(F.col(key).alias("id")).distinct()
    parts = [kept[e.predicate_id].select(F.lit(e.predicate_id).alias("predicate_id"), F.col("source").cast("string"), F.col("target").cast("string")) for e in query.edges]
    return reduce(DataFrame.unionByName, parts)
