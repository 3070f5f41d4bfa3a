"""From bindings to result graphs and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.model import QueryGraph
from loomgraph.session import dealt
from loomgraph.sources.catalog import GraphCatalog

#: Properties that a node is called by, the first that is set.
NAMES = ("gene_name", "transcript_name", "protein_name", "pathway_name", "term_name", "name")
#: Properties never shown.
HIDDEN = ("synonyms", "accessions")


def key(label: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{label} "), id_.cast("string"))


def shape_nodes(found: DataFrame, query: QueryGraph) -> DataFrame:
    """``(id, type, name)`` of the distinct vertices in the bindings; nulls of optional nodes are none."""
    parts = []
    for n in query.nodes:
        at = lambda c, n=n: F.col(f"{n.node_id}__{c}")
        named = [at(c).cast("string") for c in NAMES if f"{n.node_id}__{c}" in found.columns]
        parts.append(found.where(at("id").isNotNull()).select(key(n.type, at("id")).alias("id"), F.lit(n.type).alias("type"), F.coalesce(*named, key(n.type, at("id"))).alias("name")))
    return reduce(DataFrame.unionByName, parts).groupBy("id", "type").agg(F.min("name").alias("name"))


def shape_edges(found: DataFrame, query: QueryGraph) -> DataFrame:
    """``(edge_id, label, source, target)``: of parallel edges of one type one is shown."""
    parts = []
    for e in query.edges:
        a, b = query.node(e.source).type, query.node(e.target).type
        parts.append(found.select(F.lit(f"{a}_{e.name}_{b}").alias("edge_id"), F.lit(e.name).alias("label"), key(a, F.col(f"{e.source}__id")).alias("source"), key(b, F.col(f"{e.target}__id")).alias("target")))
    return reduce(DataFrame.unionByName, parts).distinct()


def edge_properties(found: DataFrame, query: QueryGraph, predicate_id: str) -> DataFrame:
    """One edge pattern's edges with their properties; of parallel edges the one with the least uid (ties: least properties).
    A property ``source`` is shown as ``source_data``."""
    e = next(e for e in query.edges if e.predicate_id == predicate_id)
    a, b = query.node(e.source).type, query.node(e.target).type
    own = [c for c in found.columns if c.startswith(f"{predicate_id}__") and c.split("__", 1)[1] not in ("src", "dst", "uid")]
    plain = lambda c: "source_data" if c.split("__", 1)[1] == "source" else c.split("__", 1)[1]
    rows = found.groupBy(key(a, F.col(f"{e.source}__id")).alias("source"), key(b, F.col(f"{e.target}__id")).alias("target")).agg(F.min(F.struct(F.col(f"{predicate_id}__uid").alias("uid"), *[F.col(c).alias(plain(c)) for c in own])).alias("p"))
    return rows.select(F.lit(f"{a}_{e.name}_{b}").alias("edge_id"), "source", "target", *[F.col(f"p.{plain(c)}") for c in own])


def total_counts(found: DataFrame, query: QueryGraph, *, distinct_entities: bool = False) -> DataFrame:
    """``(total_nodes, total_edges)``. A vertex bound to two variables counts twice, as variables are
    counted one by one, unless ``distinct_entities``."""
    zero = F.lit(0).cast("long")
    edges = reduce(lambda a, b: a + b, [F.count_distinct(f"{e.predicate_id}__uid") for e in query.edges], zero)
    if not distinct_entities:
        nodes = reduce(lambda a, b: a + b, [F.count_distinct(f"{n.node_id}__id") for n in query.nodes], zero)
        return found.agg(nodes.alias("total_nodes"), edges.alias("total_edges"))
    each = F.explode(F.array(*[key(n.type, F.col(f"{n.node_id}__id")) for n in query.nodes]))
    return found.select(each.alias("k")).agg(F.count_distinct("k").alias("total_nodes")).crossJoin(found.agg(edges.alias("total_edges")))


def variable_counts(found: DataFrame, query: QueryGraph) -> DataFrame:
    """``(kind, variable, label, count)`` for every variable and edge pattern, in one aggregation."""
    nodes = [("node", n.node_id, n.type, F.count_distinct(f"{n.node_id}__id")) for n in query.nodes]
    edges = [("edge", e.predicate_id, e.name, F.count_distinct(f"{e.predicate_id}__uid")) for e in query.edges]
    one = found.agg(*[agg.alias(f"c{i}") for i, (*_, agg) in enumerate(nodes + edges)])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(var).alias("variable"), F.lit(label).alias("label"), F.col(f"c{i}").alias("count")) for i, (kind, var, label, _) in enumerate(nodes + edges)])
    return one.select(F.inline(rows))


def label_counts(found: DataFrame, query: QueryGraph, requested: Sequence[str] = ()) -> DataFrame:
    """``(kind, label, count)``: variables of one label together; requested labels without any count 0."""
    return roll_up_counts(variable_counts(found, query), requested)


def roll_up_counts(counts: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """The rows of ``variable_counts`` summed by label, with zeros for requested labels that have none."""
    counted = counts.groupBy("kind", "label").agg(F.sum("count").alias("count"))
    if not requested:
        return counted
    zeros = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in requested])).alias("label"), F.lit("node").alias("kind"))
    missing = zeros.join(counted, ["kind", "label"], "left_anti")
    return counted.unionByName(missing.withColumn("count", F.lit(0).cast("long")))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, label, count)`` of a graph at hand; a node without a type counts under its id's first
    part, or ``unknown``."""
    label = F.coalesce("type", F.nullif(F.substring_index("id", " ", 1), F.lit("")), F.lit("unknown"))
    return nodes.groupBy(label.alias("label")).count().select(F.lit("node").alias("kind"), "label", "count").unionByName(edges.groupBy("label").count().select(F.lit("edge").alias("kind"), "label", "count"))


def grouped_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One meta-node for each type, ``(type, name)``, and its members ``(type, id, name)``, a row each."""
    by = nodes.groupBy("type").agg(F.count("*").alias("n"))
    return by.select("type", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("type"), F.lit(" nodes")).alias("name")), nodes.select("type", "id", "name")


def first_edges(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of edges with one source, label and target the first in ``order``, whole."""
    w = Window.partitionBy("source", "label", "target").orderBy(*order)
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def enrich(keys: DataFrame, catalog: GraphCatalog, label: str, *, all_properties: bool = True) -> DataFrame:
    """Vertices of one label in ``keys(id)`` with their properties; one without a property keeps its row."""
    v = catalog.vertices(label)
    v = v.drop(*HIDDEN) if all_properties else v.select("id", *[c for c in NAMES if c in v.columns])
    return keys.select("id").distinct().join(v, "id", "left")


def patch_missing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and, for edge ends that are not among them, bare nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    lost = ends.join(nodes, "id", "left_anti").select("id", F.substring_index("id", " ", 1).alias("type"), F.col("id").alias("name"))
    return nodes.unionByName(lost)


def list_by_target(edges: DataFrame, targets: DataFrame, sources: DataFrame | None = None, *, arrays: bool = False) -> DataFrame:
    """For each wanted target the distinct sources that reach it: ``(target, node_id)``, a row each, or
    with ``arrays`` one row a target, ``(target, node_ids)``, for callers who know that their targets have
    few. ``targets(id)`` and, if given, ``sources(id)`` restrict the ends."""
    kept = edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    if sources is not None:
        kept = kept.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    pairs = kept.select(F.col("dst").alias("target"), F.col("src").alias("node_id")).distinct()
    return pairs.groupBy("target").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids")) if arrays else pairs


def source_summaries(nodes: DataFrame, edges: DataFrame, described: Column) -> DataFrame:
    """``(source, about, line)``: for every edge a line that describes its target, beside its source's
    description. ``described`` is a column over ``nodes``, such as ``functions.text.description`` makes."""
    d = nodes.select("id", described.alias("about"))
    ends = edges.join(d.withColumnsRenamed({"id": "source"}), "source", "left").join(d.withColumnsRenamed({"id": "target", "about": "other"}), "target", "left")
    line = F.concat(F.col("label"), F.lit(" -> Target Node ("), F.col("target"), F.lit("): "), F.coalesce("other", F.lit("")))
    return ends.select("source", F.coalesce("about", F.lit("")).alias("about"), line.alias("line"))


#: Lines of texts that one task handles, about: they are some hundred bytes each.
TASK_LINES = 200_000


def source_texts(summaries: DataFrame, page: int = 50, rows: int | None = None) -> DataFrame:
    """``(source, page, text)``: the rows of ``source_summaries`` as texts of about ``page`` lines, for a reader with a budget.

    A source with more lines than that gets several pages, to which its lines are dealt by a digest, so no hub's lines meet in
    one row; page 0 is always there and begins with ``Source Node (id): about``. Within a page lines are sorted, equal ones once.
    ``rows`` says about how many summaries there are (the edges' number; counted if not given): they are dealt to tasks by it.
    """
    spread = lambda df, *keys: dealt(df, rows, *keys, most=TASK_LINES)
    rows = summaries.count() if rows is None else rows
    # dealt before lines are told apart, so that no map of all lines of an input split is built; alike lines compress so
    # well that partitions merged by their bytes would hold millions
    summaries = spread(summaries.select("source", "about", "line"), "source", "line").distinct()
    totals = summaries.groupBy("source").agg(F.ceil(F.count("*") / page).cast("long").alias("pages"))
    at = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long") % F.col("pages")
    # a page may be left empty; the first one then holds the source's own line alone
    heads = summaries.groupBy("source").agg(F.min("about").alias("about"), F.lit(0).cast("long").alias("page"))
    bodies = spread(summaries.join(totals, "source").select("source", at.alias("page"), "line"), "source", "page")
    bodies = bodies.groupBy("source", "page").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    begun = F.concat(F.lit("Source Node ("), F.substring_index("source", " ", -1), F.lit("): "), F.col("about"))
    return bodies.join(heads, ["source", "page"], "full").select("source", "page", F.concat_ws("\n", F.when(F.col("about").isNotNull(), begun), "body").alias("text"))


def by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, type, data)``: nodes by type and edges by label, each as JSON; of edges with one source, label and target the
    first in the order of their JSON. Rows, not lists: a type's rows stay distributed, and ``partitionBy`` writes them apart."""
    as_json = lambda df: F.to_json(F.struct(*df.columns))
    parts = [nodes.select(F.lit("node").alias("kind"), F.col("type"), as_json(nodes).alias("data")), edges.groupBy("source", "label", "target").agg(F.min(as_json(edges)).alias("data")).select(F.lit("edge").alias("kind"), F.col("label").alias("type"), "data")]
    return reduce(DataFrame.unionAll, parts)


def roll_up(members: DataFrame, parents: DataFrame) -> DataFrame:
    """``(member, term)`` rows up one step of ``parents(child, parent)``: for each member its terms'
    parents, comma-joined; a term without a parent stands for itself."""
    up = members.join(parents, members.term == parents.child, "left").select("member", F.coalesce("parent", "term").alias("at"))
    return up.groupBy("member").agg(F.array_join(F.sort_array(F.collect_set(F.col("at").cast("string"))), ",").alias("terms"))
