"""Operators on result graphs: ``nodes(id, type, name)`` and ``edges(edge_id, label, source, target)``.

Groups get digests of what defines them as ids, so a result is the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import middle
from loomgraph.operators.components import connected_components
from loomgraph.operators.result import roll_up
from loomgraph.session import checkpointed


def incident(edges: DataFrame) -> DataFrame:
    """Every edge seen from both its ends: ``(id, way, edge_id, other)``."""
    seen = F.array(F.struct(F.col("source").alias("id"), F.lit("out").alias("way"), "edge_id", F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.lit("in").alias("way"), "edge_id", F.col("source").alias("other")))
    return edges.select(F.inline(seen))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(id, edge_id, is_source, other)``: a row for each neighbour along each edge id; if there are any
    outgoing ones the whole entry counts as outgoing."""
    seen = incident(edges).groupBy("id", "edge_id", "other").agg(F.max("way").alias("way"))
    ways = seen.groupBy("id", "edge_id").agg((F.max("way") == "out").alias("is_source"))
    return seen.join(ways, ["id", "edge_id"]).select("id", "edge_id", "is_source", "other")


def set_digest(parts: Sequence[str]) -> list[Column]:
    """Aggregates that tell sets of distinct rows apart: their number and two sums of 60 bits of digests.
    They combine on the map side, so a hub's neighbours never meet in one row."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    bits = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("n"), F.sum(bits(1)).alias("s1"), F.sum(bits(16)).alias("s2")]


def _signed(nodes: DataFrame, edges: DataFrame, own: Sequence[str], *, once: bool = False) -> DataFrame:
    """``nodes`` with ``group_id``, a digest of the columns ``own`` and of the node's neighbours along its edges. ``once``
    says that no edge id has two edges from one source to one target, so that none need be told apart."""
    seen = incident(edges) if once else incident(edges).distinct()
    sums = seen.groupBy("id").agg(*set_digest(["way", "edge_id", "other"]))
    sums = sums.select("id", F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s1", "s2")]).alias("signature"))
    labelled = nodes.join(sums, "id", "left")
    return labelled.withColumn("group_id", F.sha2(F.concat_ws("|", *own, F.coalesce("signature", F.lit(""))), 256)).drop("signature")


def _named_groups(grouped: DataFrame) -> DataFrame:
    """``(id, type, name, n)`` of the groups; a single node keeps its name, the least member gives the type."""
    groups = grouped.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("id", "type", "name")).alias("one"))
    name = F.when(F.col("n") == 1, F.col("one.name")).otherwise(F.concat_ws(" ", F.col("n").cast("string"), "one.type", F.lit("nodes")))
    return groups.select("id", F.col("one.type").alias("type"), name.alias("name"), "n")


def collapse(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of one label with the same neighbours along the same edges become one.

    Returns the groups ``(id, type, name, n)``, edges between them, and the members ``(parent, child)``, a row
    each. A single node keeps its name; edges within a group go; parallel edges of one edge id become one.
    """
    grouped = checkpointed(_signed(nodes, edges, ["type"]))
    return _named_groups(grouped), repointed(edges, grouped.select("id", "group_id")), grouped.select(F.col("group_id").alias("parent"), F.col("id").alias("child"))


def repointed(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between the groups ``(id, group_id)`` of their ends, once each, none within a group."""
    a = groups.select(F.col("id").alias("source"), F.col("group_id").alias("a"))
    b = groups.select(F.col("id").alias("target"), F.col("group_id").alias("b"))
    moved = edges.join(a, "source").join(b, "target").where("a <> b")
    return moved.select("edge_id", "label", F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def compound(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The grouping of ``collapse`` for connected nodes only, as compound nodes ``(parent, id)`` and
    edges from the source side, each once."""
    grouped = checkpointed(_signed(nodes, edges, ["type"]).join(incident(edges).select("id").distinct(), "id", "left_semi"))
    return grouped.select(F.col("group_id").alias("parent"), "id"), repointed(edges, grouped.select("id", "group_id"))


def group_parents(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared neighbours become children of a parent node.

    A candidate is a set of at least two neighbours along one edge id, owned by the least node that
    has it. A candidate with a member in a larger one of the same direction goes; every node joins
    its largest remaining candidate (ties: least owner); parents with fewer than two children go.
    Returns ``(parent, child)``, ``(parent, owner, edge_id, label, is_source, n)`` and all edges, those to
    children replaced by one to their parent.
    """
    near = checkpointed(adjacency(edges))
    sets = near.groupBy("id", "edge_id", "is_source").agg(*set_digest(["other"])).where("n >= 2")
    sets = sets.withColumn("parent", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s1", "s2")]), 256))
    cand = sets.groupBy("parent").agg(F.min(F.struct("id", "edge_id", "is_source", "n")).alias("c")).select("parent", F.col("c.id").alias("owner"), "c.edge_id", "c.is_source", "c.n")
    cand = checkpointed(cand)
    member = cand.join(near.select(F.col("id").alias("owner"), "edge_id", F.col("other").alias("child")), ["owner", "edge_id"])
    # the largest size at each member and direction decides; no pair of candidates is formed
    top = member.groupBy("child", "is_source").agg(F.max("n").alias("top"))
    beaten = member.join(top, ["child", "is_source"]).where("top > n").select("parent").distinct()
    left = member.join(beaten, "parent", "left_anti").join(nodes.select(F.col("id").alias("child")), "child", "left_semi")
    best = left.groupBy("child").agg(F.min(F.struct((-F.col("n")).alias("size"), "owner", "parent")).alias("b"))
    chosen = checkpointed(best.select("b.parent", "child"))
    full = chosen.groupBy("parent").count().where("count > 1").select("parent")
    children = chosen.join(full, "parent", "left_semi")
    parents = checkpointed(cand.join(full, "parent", "left_semi"))
    inside = parents.select("owner", "edge_id", "is_source").join(near.select(F.col("id").alias("owner"), "edge_id", F.col("other").alias("child")), ["owner", "edge_id"])
    out = F.array(F.struct(F.lit(True).alias("is_source"), F.col("source").alias("owner"), F.col("target").alias("child")), F.struct(F.lit(False).alias("is_source"), F.col("target").alias("owner"), F.col("source").alias("child")))
    held = edges.select("edge_id", "label", "source", "target", F.explode(out).alias("x")).select("edge_id", "label", "source", "target", "x.*")
    gone = held.join(inside, ["owner", "edge_id", "is_source", "child"], "left_semi").select("edge_id", "label", "source", "target")
    kept = edges.select("edge_id", "label", "source", "target").join(gone, ["edge_id", "label", "source", "target"], "left_anti")
    new = parents.select("edge_id", middle(F.col("edge_id")).alias("label"), F.when(F.col("is_source"), F.col("owner")).otherwise(F.col("parent")).alias("source"), F.when(F.col("is_source"), F.col("parent")).otherwise(F.col("owner")).alias("target"))
    summary = parents.select("parent", "owner", "edge_id", middle(F.col("edge_id")).alias("label"), "is_source", F.col("n"))
    return children, summary, kept.unionByName(new)


def group_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A graph collapsed and then grouped into parents: the groups, their members ``(parent, child)``,
    the groups' parents ``(parent, child)``, and the edges that are left."""
    groups, between, members = collapse(nodes, edges)
    groups, between = checkpointed(groups), checkpointed(between)
    children, _, regrouped = group_parents(groups, between)
    return groups, members, children, regrouped


def break_grouping(children: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Edges with parents replaced by their children, and then groups by their members, at both ends;
    each edge once. ``children(parent, child)``; ``members(parent, child)`` of collapsed nodes."""
    for groups in (children, members):
        if groups is None:
            continue
        for end in ("source", "target"):
            g = groups.select(F.col("parent").alias(end), F.col("child").alias("__in"))
            edges = edges.join(g, end, "left").withColumn(end, F.coalesce("__in", end)).drop("__in")
    return edges.select("edge_id", "label", "source", "target").distinct()


def by_location(nodes: DataFrame, location: str = "location") -> tuple[DataFrame, DataFrame]:
    """A node in several comma-separated locations becomes one node in each: the first stands for the
    node, the others point to it by ``location_alias`` edges. Nodes without a location stay."""
    spread = nodes.select("id", "type", "name", F.posexplode_outer(F.split(location, ",")).alias("i", "place"))
    several = F.max("i").over(Window.partitionBy("id")) > 0
    spread = spread.withColumn("several", F.coalesce(several, F.lit(False)))
    new = F.when(F.col("several"), F.concat(F.col("id"), F.lit("_loc_"), F.col("i").cast("string"))).otherwise(F.col("id"))
    out = spread.select(new.alias("id"), F.col("id").alias("original"), "type", "name", F.trim("place").alias("location"), F.coalesce(F.col("i") == 0, F.lit(True)).alias("main"))
    alias = out.where(~F.col("main")).select(F.lit("location_alias").alias("edge_id"), F.lit("location_alias").alias("label"), F.col("id").alias("source"), F.concat(F.col("original"), F.lit("_loc_0")).alias("target"))
    return out, alias


def collapse_location(nodes: DataFrame, edges: DataFrame, location: str = "location") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph spread over locations, nodes of one location with the same neighbours collapsed.

    Edges go to the nodes that stand for the original ones; of parallel edges that with the least edge
    id stays, and a node's own copies hang on it by ``location_alias`` edges. Returns groups
    ``(id, type, name, n)`` (a node alone keeps its id), edges between groups and members ``(parent, child)``.
    """
    spread, alias = by_location(nodes, location)
    spread = checkpointed(spread)
    main = spread.where("main").select("original", F.col("id").alias("now"))
    for end in ("source", "target"):
        edges = edges.join(main.withColumnRenamed("original", end), end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
    one = edges.select("edge_id", "label", "source", "target").unionByName(alias).groupBy("source", "target").agg(F.min(F.struct("edge_id", "label")).alias("e"))
    one = checkpointed(one.select("e.edge_id", "e.label", "source", "target"))
    signed = _signed(spread.select("id", "type", "name", F.coalesce("location", F.lit("")).alias("location")), one, ["location"], once=True)
    alone = F.count("*").over(Window.partitionBy("group_id")) == 1
    signed = checkpointed(signed.withColumn("group_id", F.when(alone, F.col("id")).otherwise(F.col("group_id"))))
    return _named_groups(signed), repointed(one, signed.select("id", "group_id")), signed.select(F.col("group_id").alias("parent"), F.col("id").alias("child"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least node that can be reached, either way along edges."""
    found = connected_components(edges, "source", "target").withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def diff(nodes1: DataFrame, edges1: DataFrame, nodes2: DataFrame, edges2: DataFrame, by: Sequence[str] = ("source", "target", "label")) -> DataFrame:
    """``(kind, change, key)`` of nodes by id and edges by the columns ``by``."""
    parts = []
    for kind, a, b, cols in (("node", nodes1, nodes2, ["id"]), ("edge", edges1, edges2, list(by))):
        k = F.concat_ws("|", *cols)
        x, y = a.select(k.alias("key")).distinct(), b.select(k.alias("key")).distinct()
        parts += [y.join(x, "key", "left_anti").select(F.lit(kind).alias("kind"), F.lit("added").alias("change"), "key"), x.join(y, "key", "left_anti").select(F.lit(kind).alias("kind"), F.lit("removed").alias("change"), "key")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def merge_nodes(nodes1: DataFrame, nodes2: DataFrame, policy: str = "mark") -> DataFrame:
    """The union of two graphs' nodes with ``origin`` (G1, G2 or both) and ``conflict`` where both have
    a node with other attributes. ``prefer_G2`` shows the second's, else the first's are shown."""
    cols = [c for c in nodes1.columns if c != "id" and c in nodes2.columns]
    a = nodes1.select("id", F.struct(*cols).alias("a"))
    b = nodes2.select("id", F.struct(*cols).alias("b"))
    both = a.join(b, "id", "full_outer")
    origin = F.when(F.col("a").isNull(), "G2").when(F.col("b").isNull(), "G1").otherwise("both")
    conflict = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.to_json("a") != F.to_json("b"))
    shown = F.coalesce("b", "a") if policy == "prefer_G2" else F.coalesce("a", "b")
    return both.select("id", origin.alias("origin"), conflict.alias("conflict"), shown.alias("s")).select("id", "origin", "conflict", "s.*")


def merge_edges(edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """The union of two graphs' edges with ``origin``; the i-th of parallel edges meets the i-th."""
    keyed = ["edge_id", "source", "target"]
    nth = lambda e: e.select(*keyed, F.row_number().over(Window.partitionBy(*keyed).orderBy("label")).alias("nth"))
    a, b = nth(edges1).withColumn("a", F.lit(1)), nth(edges2).withColumn("b", F.lit(1))
    both = a.join(b, [*keyed, "nth"], "full_outer")
    return both.select(*keyed, "nth", F.when(F.col("a").isNull(), "G2").when(F.col("b").isNull(), "G1").otherwise("both").alias("origin"))


def reverse_pairs(edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """``(u, v)``, the smaller end first, with an edge one way in one graph and the other way in the other."""
    x = edges1.select(F.col("source").alias("p"), F.col("target").alias("q")).distinct()
    y = edges2.select(F.col("target").alias("p"), F.col("source").alias("q")).distinct()
    return x.join(y, ["p", "q"]).where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()


def out_index(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, target)`` for every outgoing edge, and the isolated nodes ``(id)``."""
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return edges.select(F.col("source").alias("id"), "target"), nodes.select("id").join(touched, "id", "left_anti")


def limit_graph(nodes: DataFrame, edges: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph cut to at most ``threshold`` nodes: in order of id, each node's whole
    out-star if it still fits (its edges and itself count), then isolated nodes.

    The choice depends on all before it. The driver reads the next stars that could still fit, at most
    ``threshold / 2`` at a time; the first of them always does, so the rounds are bounded by the limit
    and not by the graph.
    """
    stars = checkpointed(edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") < threshold))
    left, chosen, last = threshold, [], None
    while left >= 2:
        fits = stars.where(F.col("n") < left)
        some = (fits if last is None else fits.where(F.col("id") > last)).orderBy("id").limit(max(1, left // 2)).collect()
        for row in some:
            if row.n < left:
                chosen.append(row.id)
                left -= row.n + 1
        if not some:
            break
        last = some[-1].id
    picked = nodes.sparkSession.createDataFrame([(x,) for x in chosen], "source string")
    held = edges.join(F.broadcast(picked), "source", "left_semi").select(*edges.columns)  # at most threshold / 2 ids
    taken = held.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    lone = out_index(nodes, edges)[1].orderBy("id").limit(left)
    return nodes.join(taken.unionAll(lone), "id", "left_semi"), held


def colour_histogram(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``(colour, n)`` after rounds of neighbourhood refinement. Isomorphic graphs have equal
    histograms; different histograms prove that two graphs are not isomorphic."""
    colour = nodes.select("id", F.sha2("type", 256).alias("c"))
    around = incident(edges)
    for _ in range(rounds):
        seen = around.join(colour.select(F.col("id").alias("other"), F.col("c").alias("oc")), "other")
        sums = seen.groupBy("id").agg(*set_digest(["way", "edge_id", "oc"]))
        mixed = sums.select("id", F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s1", "s2")]).alias("m"))
        colour = colour.join(mixed, "id", "left").select("id", F.sha2(F.concat_ws("|", "c", F.coalesce("m", F.lit(""))), 256).alias("c"))
    return colour.groupBy(F.col("c").alias("colour")).agg(F.count("*").alias("n"))


def maybe_isomorphic(nodes1: DataFrame, edges1: DataFrame, nodes2: DataFrame, edges2: DataFrame) -> bool:
    """False if the graphs surely differ in shape; True is no proof that they don't."""
    a, b = colour_histogram(nodes1, edges1), colour_histogram(nodes2, edges2)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def localised(edges: DataFrame, children: DataFrame, places: DataFrame, parents: DataFrame, label: str = "protein", members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of a grouped graph between nodes of one label, with where each of them is.

    Groups are broken up first. ``places(member, term)`` says where nodes are, ``parents(child, parent)``
    takes a term up one step. Returns ``(id, location)``, comma-joined, null where nothing is known, and
    the edges between these nodes.
    """
    own = lambda c: F.substring_index(c, " ", 1) == label
    inside = break_grouping(children, edges, members).where(own("source") & own("target"))
    nodes = inside.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    located = roll_up(places, parents).select(F.col("member").alias("id"), F.col("terms").alias("location"))
    return nodes.join(located, "id", "left"), inside
