"""Counts of a pattern without its bindings, by messages along the edges of the pattern.

For a pattern whose edges make no cycle, a vertex takes part in a match exactly if every edge pattern
at it leads on to vertices that do; so the distinct counts of all variables come from semi-joins along the
edges, first towards the middle of the pattern and then back out (a full reduction), and the number of
matches from sums of products carried the same way. The largest frame is an edge table, whatever the
number of matches; no frame holds two variables that aren't joined by an edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.result import roll_up_counts
from loomgraph.plans.compiler import bindings, edge_frame, vertex_frame
from loomgraph.plans.model import EdgePattern, QueryGraph
from loomgraph.plans.rewrite import VIRTUAL
from loomgraph.session import checkpointed
from loomgraph.sources.catalog import GraphCatalog

#: Edge patterns up to which one plan holds the whole reduction; longer ones are cut by checkpoints.
ONE_PLAN = 4


@dataclass(frozen=True)
class Step:
    """An edge pattern on the way out from the middle: from ``near`` to ``far``."""

    edge: EdgePattern
    near: str
    far: str

    @property
    def keys(self) -> tuple[str, str]:
        """The columns of the edge frame that hold the near and the far end."""
        ends = (f"{self.edge.predicate_id}__src", f"{self.edge.predicate_id}__dst")
        return ends if self.edge.source == self.near else ends[::-1]


def trees(query: QueryGraph) -> list[tuple[str, list[Step]]] | None:
    """For each connected part of the pattern a variable in its middle and the steps outward from it, nearer ones
    first; None if the edges make a cycle or one of them is an overlap, which no semi-join on a key expresses."""
    at: dict[str, list[EdgePattern]] = {n.node_id: [] for n in query.nodes}
    for e in query.edges:
        if e.name in VIRTUAL or e.source == e.target:
            return None
        at[e.source].append(e)
        at[e.target].append(e)

    def outward(root: str) -> tuple[list[Step], int] | None:
        depth, steps, used = {root: 0}, [], set()
        for near in (order := [root]):  # grows as it is read
            for e in at[near]:
                if e.predicate_id in used:
                    continue
                far = e.target if e.source == near else e.source
                if far in depth:
                    return None
                used.add(e.predicate_id)
                depth[far] = depth[near] + 1
                steps.append(Step(e, near, far))
                order.append(far)
        return steps, max(depth.values())

    found, seen = [], set()
    for n in query.nodes:
        if n.node_id in seen:
            continue
        first = outward(n.node_id)
        if first is None:
            return None
        part = [n.node_id, *(s.far for s in first[0])]
        seen.update(part)
        root = min(part, key=lambda v: (outward(v)[1], part.index(v)))
        found.append((root, outward(root)[0]))
    return found


@dataclass(frozen=True)
class Reduced:
    """What takes part in matches: ``domains[variable](id)`` and ``edges[predicate_id]`` with its two ends and ``uid``."""

    roots: list[str]
    domains: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    steps: dict[str, Step]


def reduced(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex") -> Reduced:
    """The full reduction of a pattern without cycles (each connected part by itself); an error for others.

    The domain of a variable other than a root is the far ends of its step's edges, repeated as they come.
    """
    parts = trees(query)
    if parts is None:
        raise ValueError("the pattern has a cycle or an overlap edge")
    cut = checkpointed if len(query.edges) > ONE_PLAN else lambda df: df
    allowed = {n.node_id: vertex_frame(catalog, n, matching=matching, bare=True).select("id") for n in query.nodes}
    edges, steps = {}, {}
    for root, outward in parts:
        for s in reversed(outward):  # inward: what the far side allows
            near, far = s.keys
            e = edge_frame(catalog, query, s.edge).select(near, far, f"{s.edge.predicate_id}__uid")
            edges[s.edge.predicate_id] = e = cut(e.join(allowed[s.far].select(F.col("id").alias(far)), far, "left_semi"))
            allowed[s.near] = allowed[s.near].join(e.select(F.col(near).alias("id")), "id", "left_semi")
            steps[s.edge.predicate_id] = s
        for s in outward:  # outward: what the near side allows
            near, far = s.keys
            kept = edges[s.edge.predicate_id].join(allowed[s.near].select(F.col("id").alias(near)), near, "left_semi")
            edges[s.edge.predicate_id] = kept = cut(kept)
            allowed[s.far] = kept.select(F.col(far).alias("id"))
    return Reduced([root for root, _ in parts], allowed, edges, steps)


def variable_counts(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex") -> DataFrame:
    """``(kind, variable, label, count)`` for every variable and edge pattern of a pattern without cycles: distinct vertices
    and edges in its matches.

    A part of the pattern without a match makes all counts 0.
    """
    r = reduced(catalog, query, matching=matching)
    labels = {n.node_id: n.type for n in query.nodes}

    def one(frame: DataFrame, key: str, kind: str, var: str, label: str) -> DataFrame:
        """A count by itself: two distinct counts in one aggregation would double every row."""
        return frame.agg(F.count_distinct(key).alias("count")).select(F.lit(kind).alias("kind"), F.lit(var).alias("variable"), F.lit(label).alias("label"), "count")

    rows = [one(r.domains[root], "id", "node", root, labels[root]) for root in r.roots]
    for p, s in r.steps.items():
        rows += [one(r.edges[p], s.keys[1], "node", s.far, labels[s.far]), one(r.edges[p], f"{p}__uid", "edge", p, s.edge.name)]
    counts = reduce(DataFrame.unionAll, rows)
    if len(r.roots) == 1:
        return counts
    some = reduce(DataFrame.unionAll, [r.domains[x].select(F.lit(x).alias("root")).limit(1) for x in r.roots]).agg((F.count("*") == len(r.roots)).alias("matched"))
    return counts.crossJoin(some).select("kind", "variable", "label", F.when(F.col("matched"), F.col("count")).otherwise(F.lit(0)).alias("count"))


def total_counts(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex") -> DataFrame:
    """``(total_nodes, total_edges)``, variables counted one by one as in ``result.total_counts``."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0).cast("long"))
    return variable_counts(catalog, query, matching=matching).agg(of("node").alias("total_nodes"), of("edge").alias("total_edges"))


def label_counts(catalog: GraphCatalog, query: QueryGraph, requested: Sequence[str] = (), *, matching: str = "regex") -> DataFrame:
    """``(kind, label, count)``: variables of one label together; requested labels without any count 0."""
    return roll_up_counts(variable_counts(catalog, query, matching=matching), requested)


def matches_at(catalog: GraphCatalog, query: QueryGraph, variable: str, *, matching: str = "regex") -> DataFrame:
    """``(id, matches)``: in how many matches of a connected pattern without cycles each vertex of a variable stands.

    A vertex's message is the product, over the edge patterns that lead away from the variable, of the sums
    of the messages at their far ends; sums are exact (38 digits) and edges are combined before they are shuffled.
    """
    parts = trees(query)
    if parts is None or len(parts) > 1:
        raise ValueError("a connected pattern without cycles is needed")
    outward = _rooted(parts[0][1], variable)
    message = {n.node_id: vertex_frame(catalog, n, matching=matching, bare=True).select("id", F.lit(1).cast("decimal(38,0)").alias("matches")) for n in query.nodes}
    for s in reversed(outward):
        near, far = s.keys
        e = edge_frame(catalog, query, s.edge).select(F.col(near).alias("near"), F.col(far).alias("id"))
        up = e.join(message[s.far], "id").groupBy(F.col("near").alias("id")).agg(F.sum("matches").alias("more"))
        message[s.near] = message[s.near].join(up, "id").select("id", (F.col("matches") * F.col("more")).cast("decimal(38,0)").alias("matches"))
    return message[variable]


def _rooted(steps: list[Step], variable: str) -> list[Step]:
    """The steps turned so that they lead away from ``variable``."""
    found, reached, left = [], {variable}, list(steps)
    while left:
        s = next(x for x in left if x.near in reached or x.far in reached)
        left.remove(s)
        found.append(s if s.near in reached else Step(s.edge, s.far, s.near))
        reached |= {s.near, s.far}
    return found


def match_count(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex") -> DataFrame:
    """``(matches)``, the number of the pattern's bindings, as one row (a decimal): for a pattern without cycles from
    messages, the product of its connected parts' numbers; for others from the bindings."""
    parts = trees(query)
    if parts is None:
        return bindings(catalog, query, matching=matching).agg(F.count("*").cast("decimal(38,0)").alias("matches"))
    sums = []
    for root, steps in parts:
        own = {root, *(s.far for s in steps)}
        part = QueryGraph(tuple(n for n in query.nodes if n.node_id in own), tuple(e for e in query.edges if e.source in own))
        sums.append(matches_at(catalog, part, root, matching=matching).agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("decimal(38,0)").alias("matches")))
    both = lambda a, b: a.crossJoin(b.withColumnRenamed("matches", "more")).select((F.col("matches") * F.col("more")).cast("decimal(38,0)").alias("matches"))
    return reduce(both, sums)  # one row each


def occurrence_counts(catalog: GraphCatalog, query: QueryGraph, *, matching: str = "regex") -> DataFrame:
    """``(kind, label, count)`` as decimals: vertices of a type once each, whichever variables they are bound to, and edges as often as matches
    show them, so a match counts each of its edge patterns. Labels without a match count 0.

    Of a pattern without cycles neither count sees the bindings.
    """
    tree = trees(query) is not None
    matches = match_count(catalog, query, matching=matching)
    if tree:
        r = reduced(catalog, query, matching=matching)
        domains = [r.domains[n.node_id].select(F.lit(n.type).alias("label"), F.col("id").cast("string").alias("id")) for n in query.nodes]
    else:
        found = bindings(catalog, query, matching=matching)
        domains = [found.select(F.lit(n.type).alias("label"), F.col(f"{n.node_id}__id").cast("string").alias("id")) for n in query.nodes]
    whole = "decimal(38,0)"
    spark = catalog.spark
    distinct = reduce(DataFrame.unionAll, domains).groupBy("label").agg(F.count_distinct("id").cast(whole).alias("n"))
    types = spark.createDataFrame([(t,) for t in dict.fromkeys(n.type for n in query.nodes)], "label string")
    # the domains of one part don't know of another part without a match
    nodes = types.join(distinct, "label", "left").crossJoin(matches).select(F.lit("node").alias("kind"), "label", F.when(F.col("matches") > 0, F.coalesce("n", F.lit(0).cast(whole))).otherwise(F.lit(0)).cast(whole).alias("count"))
    names = [e.name for e in query.edges]
    if not names:
        return nodes
    patterns = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(names.count(x)).alias("n")) for x in dict.fromkeys(names)])
    edges = matches.select("matches", F.inline(patterns)).select(F.lit("edge").alias("kind"), "label", (F.col("matches") * F.col("n")).cast(whole).alias("count"))
    return nodes.unionAll(edges)
