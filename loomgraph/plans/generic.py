"""Bindings of cyclic patterns by a generic join: one variable at a time, all its edges at once.

A fold of joins builds the open path before the edge that closes it, which may be far larger than
the result. Here a partial match is extended by one variable whose every edge pattern to a bound
variable must agree. For each partial match the edge pattern with the fewest neighbours proposes (the numbers
are one aggregation of each edge table), and the others only confirm by semi-joins on both ends: a vertex of
many edges is never expanded where another end has few. Partial matches whose cheapest proposal goes by one
pattern form one join, so heavy and light values go apart. Extended this way, the partial matches never
exceed the bound that the sizes of the edge tables set to the result.

Pairs, and the proposals that they confirm, are dealt by both ends to as many tasks as the edges' number asks for, since Spark merges
partitions by compressed bytes and proposals are narrow and alike. One deal serves an edge pattern's distinct and its confirmations.

Parallel edges are one pair while variables are found; they, and the vertices' properties, are joined at the end.

A cycle of three or four variables is two relations between the same two ends, each an edge pattern or an open path of
two. Where the paths' rows, which are counted before, are not many more than the edges, nothing is proposed: each path is
joined at its middle, dealt by its ends, and the two meet there, which closes the cycle. A path that is needed twice is made once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.compiler import bindings, edge_frame, vertex_frame
from loomgraph.plans.model import EdgePattern, QueryGraph
from loomgraph.plans.rewrite import VIRTUAL
from loomgraph.session import dealt
from loomgraph.sources.catalog import GraphCatalog

#: Edges of all patterns for each task that pairs and proposals are dealt to.
TASK_EDGES = 500_000
#: Rows of open paths for each edge of all patterns, and for each of ``TASK_EDGES`` at one vertex, up to which paths are joined at once.
OPEN = 4

#: Two ends, and two ways from one to the other: the edge patterns of each, and the variable in which they meet.
Sides = tuple[tuple[str, str], tuple[tuple[tuple[EdgePattern, ...], str | None], ...]]


def variable_order(query: QueryGraph) -> list[str]:
    """Anchored and filtered variables first, then always one with most edges to those before it."""
    rank = {n.node_id: (not n.id, not n.properties, i) for i, n in enumerate(query.nodes)}
    near = lambda v, bound: sum({e.source, e.target} - {v} <= bound and v in (e.source, e.target) for e in query.edges)
    order: list[str] = []
    while len(order) < len(query.nodes):
        order.append(min((v for v in rank if v not in order), key=lambda v: (-near(v, set(order)), rank[v])))
    return order


def pairs(catalog: GraphCatalog, query: QueryGraph, edge: EdgePattern, matching: str, edges: int) -> DataFrame:
    """The distinct ends of an edge pattern's edges, in columns named by their variables; both ends passing their filters;
    dealt by both for a query over ``edges`` edges."""
    p = edge.predicate_id
    rows = edge_frame(catalog, query, edge).select(F.col(f"{p}__src").alias(edge.source), F.col(f"{p}__dst").alias(f"{edge.target}" if edge.target != edge.source else "__again"))
    if edge.source == edge.target:
        rows = rows.where(F.col(edge.source) == F.col("__again")).select(edge.source)
    for v in dict.fromkeys((edge.source, edge.target)):
        rows = rows.join(vertex_frame(catalog, query.node(v), matching=matching, bare=True).select(F.col("id").alias(v)), v, "left_semi")
    return dealt(rows, edges, *rows.columns, most=TASK_EDGES).distinct()


def extend(found: DataFrame, new: str, relations: Mapping[str, DataFrame], edges: int) -> tuple[DataFrame, DataFrame]:
    """The partial matches ``found`` with the variable ``new``: ``(proposed, kept)``.

    ``relations`` has for each bound variable that an edge joins to ``new`` the pairs ``(variable, new)``. Every
    partial match takes its proposals from the relation in which its own value has fewest (ties: the first by
    name); ``kept`` are the proposals that all other relations confirm.
    """
    names = sorted(relations)
    if len(names) == 1:
        proposed = found.join(relations[names[0]], names[0])
        return proposed, proposed
    counted = found
    for i, v in enumerate(names):  # an inner join: where a value has no neighbour at all there is no match
        counted = counted.join(relations[v].groupBy(v).agg(F.count("*").alias(f"__n{i}")), v)
    cheapest = F.array_position(F.array(*[F.col(f"__n{i}") for i in range(len(names))]), F.least(*[F.col(f"__n{i}") for i in range(len(names))])) - 1
    chosen = counted.withColumn("__by", cheapest).drop(*[f"__n{i}" for i in range(len(names))])
    proposed, kept = [], []
    for i, v in enumerate(names):
        by = chosen.where(F.col("__by") == i).drop("__by").join(relations[v], v)
        proposed.append(by)
        for other in names:
            if other != v:
                ends = [c for c in relations[other].columns if c in (other, new)]  # in the order in which the pairs are dealt
                by = dealt(by, edges, *ends, most=TASK_EDGES).join(relations[other], ends, "left_semi")
        kept.append(by)
    return reduce(DataFrame.unionByName, proposed), reduce(DataFrame.unionByName, kept)


def cycle_sides(query: QueryGraph) -> list[Sides]:
    """How a cycle of three or four variables parts into two sides between two ends; none for other patterns."""
    names = [n.node_id for n in query.nodes]
    if len(names) not in (3, 4) or len(query.edges) != len(names):
        return []
    between = lambda v, w: [e for e in query.edges if {e.source, e.target} == {v, w}]
    found = []
    for a, b in combinations(names, 2):
        sides = [((e,), None) for e in between(a, b)] + [((e, f), v) for v in names if v not in (a, b) for e in between(a, v) for f in between(v, b)]
        if len(sides) == 2 and {e.predicate_id for own, _ in sides for e in own} == {e.predicate_id for e in query.edges}:
            found.append(((a, b), tuple(sides)))
    return found


def _path_rows(catalog: GraphCatalog, query: QueryGraph, e: EdgePattern, f: EdgePattern, mid: str) -> tuple[float, float]:
    """The rows of the path of two edge patterns that meet in ``mid``, and the most of them at one vertex, before any vertex filter."""

    def degrees(edge: EdgePattern, n: str) -> DataFrame:
        return edge_frame(catalog, query, edge).groupBy(F.col(f"{edge.predicate_id}__{'src' if edge.source == mid else 'dst'}").alias("v")).agg(F.count("*").cast("double").alias(n))

    row = degrees(e, "n").join(degrees(f, "m"), "v").agg(F.sum(F.col("n") * F.col("m")), F.max(F.col("n") * F.col("m"))).first()
    return row[0] or 0.0, row[1] or 0.0


def _kind(query: QueryGraph, edges: tuple[EdgePattern, ...], *variables: str | None) -> str:
    """What edge patterns are but for the names: their ends' types, with the places of ``variables``, and all filters."""
    node = lambda v: (variables.index(v) if v in variables else None, query.node(v).type)
    own = [query.node(v) for v in variables if v is not None]
    return repr(([(node(e.source), e.name, node(e.target), sorted(e.properties.items())) for e in edges], [(n.id, sorted(n.properties.items())) for n in own]))


def open_sides(catalog: GraphCatalog, query: QueryGraph, edges: int) -> Sides | None:
    """The sides of a cycle over ``edges`` edges whose paths have the fewest rows; None if these are too many, or it is no such cycle."""
    seen: dict[str, tuple[float, float]] = {}

    def rows(own: tuple[EdgePattern, ...], mid: str | None) -> tuple[float, float]:
        if mid is None:
            return 0.0, 0.0
        kind = _kind(query, own, mid)
        if kind not in seen:
            seen[kind] = _path_rows(catalog, query, *own, mid)
        return seen[kind]

    sized = [(way, [rows(*side) for side in way[1]]) for way in cycle_sides(query)]
    fit = [(sum(n for n, _ in sizes), way) for way, sizes in sized if max(most for _, most in sizes) <= OPEN * TASK_EDGES]
    least, way = min(fit, key=lambda x: x[0], default=(0.0, None))
    return way if least <= OPEN * edges else None


def closed(catalog: GraphCatalog, query: QueryGraph, way: Sides, edges: int, *, matching: str = "regex", whole: bool = False) -> DataFrame:
    """The distinct matches of a cycle's variables by its sides, a column of ids for each; if ``whole`` the bindings,
    whose edges and vertices bring their columns along.

    A vertex without a filter is looked up once; those with one on every edge pattern that they end. Sides that differ
    in names alone are one plan until they are dealt, so their exchange serves both (unless ``whole``).
    """
    (a, b), sides = way
    alike = not whole and len({_kind(query, own, a, b, mid) for own, mid in sides}) == 1

    def side(own: tuple[EdgePattern, ...], mid: str | None, ends: bool) -> DataFrame:
        label = {a: "__a", b: "__b", mid: "__m"}
        parts, asked = [], set() if ends else {a, b}
        for e in own:
            rows = edge_frame(catalog, query, e).withColumnsRenamed({f"{e.predicate_id}__src": label[e.source], f"{e.predicate_id}__dst": label[e.target]})
            rows = rows if whole else rows.select(label[e.source], label[e.target])
            for v in sorted((e.source, e.target), key=lambda v: v == mid):
                n = query.node(v)
                if v == mid:
                    rows = dealt(rows, edges, "__m", most=TASK_EDGES)
                if v not in asked or n.id or n.properties:
                    there = vertex_frame(catalog, n, matching=matching).withColumnRenamed(f"{v}__id", label[v])
                    rows = rows.join(there, label[v]) if whole and v not in asked else rows.join(there.select(label[v]), label[v], "left_semi")
                    asked.add(v)
            parts.append(rows)
        if mid is None:
            rows = dealt(parts[0], edges, "__a", "__b", most=TASK_EDGES)
            rows = rows if whole else rows.distinct()
        else:
            path = parts[0].join(parts[1], "__m")
            path = path if whole else path.select("__a", "__m", "__b").distinct()  # dealt by the middle already
            rows = dealt(path, edges, "__a", "__b", most=TASK_EDGES)
        return rows.select(*[F.col(x).alias(v) for v, x in label.items() if v is not None], *[c for c in rows.columns if c not in label.values()])

    left, right = (side(*s, i == 0 or alike) for i, s in enumerate(sides))
    found = left.join(right, [a, b])
    if not whole:
        return found.select(*variable_order(query))
    ends = [F.col(v).alias(f"{e.predicate_id}__{end}") for e in query.edges for end, v in (("src", e.source), ("dst", e.target))]
    return found.select(*[F.col(n.node_id).alias(f"{n.node_id}__id") for n in query.nodes], *ends, *[c for c in found.columns if c not in {n.node_id for n in query.nodes}])


def _edges(catalog: GraphCatalog, query: QueryGraph) -> int:
    """The number of edges of all patterns."""
    if any(e.name in VIRTUAL for e in query.edges):
        raise ValueError("overlap edges aren't joined on keys; use compiler.bindings")
    return sum(edge_frame(catalog, query, e).count() for e in query.edges)


def node_bindings(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex", steps: list | None = None) -> DataFrame:
    """The distinct matches of the pattern's variables, a column of ids for each.

    ``steps``, if given, gets ``(variable, proposed, kept)`` of each extension, for measurements.
    """
    order, edges = variable_order(query), _edges(catalog, query)
    if way := open_sides(catalog, query, edges):
        found = closed(catalog, query, way, edges, matching=matching)
        if steps is not None:
            steps.append((order[-1], found, found))
        return found
    own = {e.predicate_id: pairs(catalog, query, e, matching, edges) for e in query.edges}
    found: DataFrame | None = None
    for at, new in enumerate(order):
        bound = set(order[:at])
        relations: dict[str, DataFrame] = {}
        loops = [own[e.predicate_id] for e in query.edges if e.source == e.target == new]
        for e in query.edges:
            ends = {e.source, e.target}
            if new in ends and len(ends) == 2 and (ends - {new}) <= bound:
                (other,) = ends - {new}
                # several edge patterns between the same two variables are one relation: what all have
                relations[other] = relations[other].join(own[e.predicate_id], [other, new], "left_semi") if other in relations else own[e.predicate_id]
        if relations:
            if at == 1 and not any(e.source == e.target == order[0] for e in query.edges):
                # the first variable's vertices alone rule out nothing that its other edges don't later
                proposed = found = relations[order[0]]
            else:
                proposed, found = extend(found, new, relations, edges)
            if steps is not None:
                steps.append((new, proposed, found))
        else:
            touching = [e for e in query.edges if new in (e.source, e.target) and e.source != e.target]
            # a first variable: the ends of one of its edge patterns, or its vertices where it has none
            start = own[touching[0].predicate_id].select(new).distinct() if touching else vertex_frame(catalog, query.node(new), matching=matching, bare=True).select(F.col("id").alias(new))
            found = start if found is None else found.crossJoin(start)
        for loop in loops:
            found = found.join(loop, new, "left_semi")
    return found


def cyclic_bindings(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex") -> DataFrame:
    """The same rows and columns as ``compiler.bindings``, found one variable at a time."""
    if not query.edges:
        return bindings(catalog, query, matching=matching)
    edges = _edges(catalog, query)
    if way := open_sides(catalog, query, edges):
        return closed(catalog, query, way, edges, matching=matching, whole=True)
    found = node_bindings(catalog, query, matching=matching)
    found = found.select(*[F.col(v).alias(f"{v}__id") for v in found.columns])
    for e in query.edges:
        p = e.predicate_id
        found = found.join(edge_frame(catalog, query, e), (F.col(f"{e.source}__id") == F.col(f"{p}__src")) & (F.col(f"{e.target}__id") == F.col(f"{p}__dst")))
    for n in query.nodes:
        v = vertex_frame(catalog, n, matching=matching)
        if len(v.columns) > 1:
            found = found.join(v, f"{n.node_id}__id")
    return found
