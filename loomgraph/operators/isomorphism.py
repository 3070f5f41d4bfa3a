"""Exact isomorphism of graphs, component by component.

Two graphs are isomorphic if their connected components are, as multisets. Each component gets the digest of
its canonical form: colours are refined by the neighbours' colours until they settle; where vertices of one
colour are left, each of a smallest such class in turn is given a colour of its own, and the least form of all is taken.
Components are gathered one at a time and in parallel; those over a stated size, and those whose search
looks at more than a stated number of vertices and edges, are undecided, which the answer says.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components

#: Edges of a component that is gathered, and vertices and edges that its search looks at in all.
EDGES, WORK = 20_000, 5_000_000

Edges = list[tuple[int, int, str]]


def canonical_form(n: int, edges: Edges, colours: Sequence[str], work: int = WORK) -> str | None:
    """A digest that two graphs of ``n`` vertices share exactly if an isomorphism keeps colours, directions and edge labels;
    None if refinements look at more than ``work`` vertices and edges. Parallel edges count."""
    many = Counter(edges)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    into: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    for (a, b, label), count in many.items():
        out[a].append((label, count, b))
        into[b].append((label, count, a))
    left = work

    def refine(colour: list[int]) -> list[int] | None:
        nonlocal left
        while True:
            left -= n + len(many)
            if left < 0:
                return None
            seen = [(colour[v], tuple(sorted([(x, c, colour[w]) for x, c, w in out[v]])), tuple(sorted([(x, c, colour[w]) for x, c, w in into[v]]))) for v in range(n)]
            rank = {s: i for i, s in enumerate(sorted(set(seen)))}
            new = [rank[s] for s in seen]
            if len(rank) == len(set(colour)):
                return new
            colour = new

    def twins(u: int, v: int) -> bool:
        """Whether exchanging the two changes nothing."""
        turn = {u: v, v: u}
        moved = lambda side, w: sorted((x, c, turn.get(t, t)) for x, c, t in side[w])
        return moved(out, u) == sorted(out[v]) and moved(into, u) == sorted(into[v])

    def search(colour: list[int]) -> tuple | None:
        settled = refine(colour)
        if settled is None:
            return None
        classes: dict[int, list[int]] = {}
        for v, c in enumerate(settled):
            classes.setdefault(c, []).append(v)
        open_ = [(len(vs), c) for c, vs in classes.items() if len(vs) > 1]
        if not open_:
            place = settled
            return tuple(sorted((place[a], place[b], label, count) for (a, b, label), count in many.items()))
        cell, alike, least = classes[min(open_)[1]], [], None
        for v in cell:
            same = next((group for group in alike if twins(group[0], v)), None)
            alike.append([v]) if same is None else same.append(v)
        if len(alike) == 1:  # any order of them is as good as another
            order = {v: i for i, v in enumerate(cell)}
            return search([c * (len(cell) + 1) + order.get(w, 0) for w, c in enumerate(settled)])
        for v in (group[0] for group in alike):
            found = search([2 * c + (w != v and c == settled[v]) for w, c in enumerate(settled)])
            if found is None:
                return None
            least = found if least is None or found < least else least
        return least

    kinds = {c: i for i, c in enumerate(sorted(set(colours)))}
    form = search([kinds[c] for c in colours])
    if form is None:
        return None
    return hashlib.sha256(repr((sorted(Counter(colours).items()), form)).encode()).hexdigest()


def component_forms(nodes: DataFrame, edges: DataFrame, *, by_type: bool = False, by_label: bool = False, max_edges: int = EDGES, work: int = WORK) -> DataFrame:
    """``(component, n_nodes, n_edges, form)`` for each connected component; ``form`` is null where it is undecided.

    ``nodes(id[, type])`` and ``edges(source, target[, label])``; with ``by_type`` and ``by_label`` an isomorphism must
    keep those. Ends that aren't among the nodes are bare nodes of no type.
    """
    kind = F.coalesce(F.col("type"), F.lit("")) if by_type else F.lit("")
    own = nodes.where("id IS NOT NULL").select("id", kind.alias("kind")).groupBy("id").agg(F.min("kind").alias("kind"))
    links = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target", (F.coalesce(F.col("label"), F.lit("")) if by_label else F.lit("")).alias("label"))
    bare = links.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(own, "id", "left_anti").withColumn("kind", F.lit(""))
    found = connected_components(links, "source", "target")
    placed = own.unionByName(bare).join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    edge_rows = links.join(placed.select(F.col("id").alias("source"), "component"), "source")
    rows = placed.select("component", F.col("id").alias("a"), F.lit(None).cast(placed.schema["id"].dataType).alias("b"), F.col("kind").alias("label")).unionByName(edge_rows.select("component", F.col("source").alias("a"), F.col("target").alias("b"), "label"))
    sizes = rows.groupBy("component").agg(F.sum(F.col("b").isNull().cast("long")).alias("n_nodes"), F.sum(F.col("b").isNotNull().cast("long")).alias("n_edges"))
    small = rows.join(sizes.where((F.col("n_edges") <= max_edges) & (F.col("n_nodes") <= max_edges + 1)).select("component"), "component", "left_semi")

    def form(table: pa.Table) -> pa.Table:
        a, b, label = (table.column(c).to_pylist() for c in ("a", "b", "label"))
        at = {x: i for i, x in enumerate(x for x, y in zip(a, b, strict=True) if y is None)}
        colours = [k for k, y in zip(label, b, strict=True) if y is None]
        digest = canonical_form(len(at), [(at[x], at[y], k) for x, y, k in zip(a, b, label, strict=True) if y is not None], colours, work)
        return pa.table({"component": table.column("component").slice(0, 1), "form": pa.array([digest], pa.string())})

    kind_of = rows.schema["component"].dataType.simpleString()
    forms = small.groupBy("component").applyInArrow(form, f"component {kind_of}, form string")
    return sizes.join(forms, "component", "left").select("component", "n_nodes", "n_edges", "form")


def isomorphic(nodes1: DataFrame, edges1: DataFrame, nodes2: DataFrame, edges2: DataFrame, *, by_type: bool = False, by_label: bool = False, max_edges: int = EDGES, work: int = WORK) -> bool | None:
    """Whether the graphs are isomorphic; None where that is undecided: the decided components match one to one and
    the undecided ones have the same sizes."""
    both = [component_forms(n, e, by_type=by_type, by_label=by_label, max_edges=max_edges, work=work).select("n_nodes", "n_edges", "form", F.lit(sign).alias("sign")) for n, e, sign in ((nodes1, edges1, 1), (nodes2, edges2, -1))]
    balance = both[0].unionByName(both[1]).groupBy("n_nodes", "n_edges", "form").agg(F.sum("sign").alias("over"))
    seen = balance.agg(F.max((F.col("over") != 0).cast("int")).alias("differ"), F.max(F.col("form").isNull().cast("int")).alias("open")).first()
    if not seen.differ:
        return None if seen.open else True
    if not seen.open:
        return False
    # a component may be decided in one graph and not in the other only if its search ran out there: compare what is left by size
    sizes = both[0].unionByName(both[1]).groupBy("n_nodes", "n_edges").agg(F.sum("sign").alias("over"), F.max(F.col("form").isNull().cast("int")).alias("open"))
    if not sizes.where("over <> 0").isEmpty():
        return False
    decided = balance.join(sizes.where("open = 0").select("n_nodes", "n_edges"), ["n_nodes", "n_edges"], "left_semi")
    return False if not decided.where("over <> 0").isEmpty() else None
