"""A compiled graph: dense ids, sorted adjacency by offsets, and a manifest that says what it was made from.

Each label gets a dictionary of its ids: sorted by range partitions, an id's number is what stands in
earlier partitions (a count for each) and before it in its own. Edge tables hold dense ends, sorted by
the source, and a table of offsets says for each source where its edges begin and how many there are;
both are sorted, so a reader of a few vertices touches the row groups that hold them. The manifest
names each table's inputs by path, length and modification time. A build compares them with the files as
they are: what hasn't changed isn't read, an edge table is made anew when its inputs or one of its two
dictionaries have changed. New tables go to folders of their own and become visible when the new manifest
takes the old one's place by a rename, so a build that dies leaves the old graph as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.model import QueryGraph
from loomgraph.session import checkpointed, parallelism
from loomgraph.sources.catalog import GraphCatalog, Triple
from loomgraph.sources.store import children, listed, read_text, remove, replace_text

#: Rows of a partition that a dense id leaves room for, as Spark's monotonically increasing ids do.
_ROOM = 33


@dataclass(frozen=True)
class Source:
    """Files or folders, and how a frame is read from them: vertices ``id`` and properties, edges ``src, dst, uid`` and properties."""

    paths: tuple[str, ...]
    read: Callable[[SparkSession, Sequence[str]], DataFrame]

    @classmethod
    def parquet(cls, *paths: str, columns: Sequence[Column | str] = ("*",)) -> Source:
        return cls(paths, lambda spark, files: spark.read.parquet(*files).select(*columns))


def in_order(paths: Sequence[str]) -> list[str]:
    """The files of a graph in the order in which they are read: type definitions first, the others by name; temporary
    files (``*.tmp.metta``) are left out."""
    name = lambda p: p.rsplit("/", 1)[-1]
    kept = [p for p in paths if not name(p).endswith(".tmp.metta")]
    return sorted(kept, key=lambda p: (name(p) != "type_defs.metta", p))


def numbered(rows: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """The rows sorted by ``order`` over range partitions with a dense number each, from 0, and how many there are.

    The sorted rows are checkpointed; the driver gets one count a partition.
    """
    n = partitions or parallelism(rows.sparkSession)
    ranged = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    place = ranged.withColumn("__at", F.monotonically_increasing_id())
    counts = {r.p: r.n for r in place.groupBy(F.shiftright("__at", _ROOM).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    if not total:
        return ranged.withColumn(name, F.lit(None).cast("long")), 0
    offsets = rows.sparkSession.createDataFrame(list(enumerate(before)), "__p long, __before long")  # a row a partition
    own = place.withColumn("__p", F.shiftright("__at", _ROOM)).join(F.broadcast(offsets), "__p")
    return own.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << _ROOM) - 1)).drop("__p", "__before", "__at"), total


class CompiledGraph:
    """A graph as ``build`` has left it at ``base``."""

    def __init__(self, spark: SparkSession, base: str, manifest: Mapping):
        self.spark, self.base, self.manifest = spark, base, manifest

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> CompiledGraph:
        text = read_text(spark, f"{base}/manifest.json")
        if text is None:
            raise ValueError(f"no compiled graph at '{base}'")
        return cls(spark, base, json.loads(text))

    def _table(self, entry: Mapping, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{entry['folder']}/{name}")

    def vertices(self, label: str) -> DataFrame:
        """``id`` (dense, a long), ``original`` and the properties."""
        if label not in self.manifest["vertices"]:
            raise ValueError(f"no vertices of type '{label}'")
        return self._table(self.manifest["vertices"][label], "rows")

    def edges(self, source: str, name: str, target: str) -> DataFrame:
        """``src, dst`` (dense), ``uid``, the properties, and ``at``, the edge's place in order of source and target."""
        return self._table(self._edge_entry((source, name, target)), "rows")

    def offsets(self, source: str, name: str, target: str) -> DataFrame:
        """``(src, first, n)``: where the edges of each source that has any begin, and how many there are."""
        return self._table(self._edge_entry((source, name, target)), "offsets")

    def _edge_entry(self, triple: Triple) -> Mapping:
        if _key(triple) not in self.manifest["edges"]:
            raise ValueError("no edges '{1}' from '{0}' to '{2}'".format(*triple))
        return self.manifest["edges"][_key(triple)]

    def catalog(self) -> GraphCatalog:
        """For patterns over dense ids; ``id`` is the number, ``original`` a property."""
        vertices = {x: (lambda x=x: self.vertices(x)) for x in self.manifest["vertices"]}
        edges = {t: (lambda t=t: self.edges(*t).drop("at")) for t in (tuple(json.loads(k)) for k in self.manifest["edges"])}
        return GraphCatalog(self.spark, vertices, edges)

    def dense(self, query: QueryGraph) -> QueryGraph:
        """The query graph with the original ids of its anchored nodes as numbers (-1 for one that isn't there): a
        filtered read of a dictionary for each, which is sorted by the original id."""
        nodes = []
        for n in query.nodes:
            if n.id:
                kind = self.vertices(n.type).schema["original"].dataType.simpleString()
                found = self.vertices(n.type).where(F.col("original") == F.lit(n.id).try_cast(kind)).select("id", F.col("original").cast("string").alias("o")).where(F.col("o") == n.id).first()
                n = replace(n, id=str(found.id if found else -1))
            nodes.append(n)
        return QueryGraph(tuple(nodes), query.edges)

    def neighbours(self, triple: Triple, ids: Sequence[int]) -> DataFrame:
        """The edges of a few sources, read by their offsets: the filter on ``at`` reaches the sorted files."""
        spans = self.offsets(*triple).where(F.col("src").isin(*ids)).select("first", "n").collect()
        within = F.lit(False)
        for s in spans:
            within = within | F.col("at").between(s.first, s.first + s.n - 1)
        return self.edges(*triple).where(within)


def _key(triple: Triple) -> str:
    return json.dumps(list(triple))


def build(spark: SparkSession, base: str, vertices: Mapping[str, Source], edges: Mapping[Triple, Source]) -> list[str]:
    """Compiles the graph of these sources to ``base`` and returns the names of the tables that were made (for edges
    the triple joined by ``_``); nothing is read if no input has changed.

    Vertices must have ``id`` and edges ``src, dst, uid``. Rows that repeat a vertex's id are one vertex (the least row),
    null ids none. Edges whose ends aren't vertices can't match and are left out; the manifest counts them.
    """
    for triple in edges:
        if missing := {triple[0], triple[2]} - vertices.keys():
            raise ValueError(f"no vertices of type '{min(missing)}'")
    text = read_text(spark, f"{base}/manifest.json")
    old = json.loads(text) if text else {"vertices": {}, "edges": {}}
    new: dict[str, dict] = {"vertices": {}, "edges": {}}
    made: list[str] = []
    run = uuid.uuid4().hex[:12]
    for label, source in vertices.items():
        inputs = listed(spark, source.paths)
        entry = old["vertices"].get(label)
        if entry is None or entry["inputs"] != inputs:
            folder = f"vertices/{label}-{run}"
            entry = {"inputs": inputs, "folder": folder, "rows": _write_vertices(source.read(spark, source.paths), f"{base}/{folder}")}
            made.append(label)
        new["vertices"][label] = entry
    for triple, source in edges.items():
        inputs = listed(spark, source.paths)
        ends = [new["vertices"][triple[0]]["folder"], new["vertices"][triple[2]]["folder"]]
        entry = old["edges"].get(_key(triple))
        if entry is None or entry["inputs"] != inputs or entry["ends"] != ends:
            folder = f"edges/{'-'.join(triple)}-{run}"
            a, b = (spark.read.parquet(f"{base}/{x}/rows") for x in ends)
            entry = {"inputs": inputs, "ends": ends, "folder": folder, **_write_edges(source.read(spark, source.paths), a, b, f"{base}/{folder}")}
            made.append("_".join(triple))
        new["edges"][_key(triple)] = entry
    if new != old:
        replace_text(spark, f"{base}/manifest.json", json.dumps(new, indent=1, sort_keys=True))
    return made


def _write_vertices(rows: DataFrame, path: str) -> int:
    others = [c for c in rows.columns if c != "id"]
    if "original" in others:
        raise ValueError("a property can't be called 'original'")
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*others)).alias("p")) if others else rows.where("id IS NOT NULL").select("id").distinct()
    dense, n = numbered(first.withColumnRenamed("id", "original"), ["original"], "id")
    dense.select("id", "original", *[F.col(f"p.`{c}`") for c in others]).write.parquet(f"{path}/rows")
    return n


def _write_edges(rows: DataFrame, sources: DataFrame, targets: DataFrame, path: str) -> dict[str, int]:
    others = [c for c in rows.columns if c not in ("src", "dst")]
    own = rows.withColumnsRenamed({"src": "__src", "dst": "__dst"})
    ends = own.join(sources.select(F.col("original").alias("__src"), F.col("id").alias("src")), "__src").join(targets.select(F.col("original").alias("__dst"), F.col("id").alias("dst")), "__dst")
    dense, n = numbered(ends.select("src", "dst", *others), ["src", "dst", "uid"], "at")
    dense.write.parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    written.groupBy("src").agg(F.min("at").alias("first"), F.count("*").alias("n")).repartitionByRange(parallelism(rows.sparkSession), "src").sortWithinPartitions("src").write.parquet(f"{path}/offsets")
    return {"rows": n, "dangling": rows.count() - n}


def vacuum(spark: SparkSession, base: str) -> list[str]:
    """Removes the folders that the manifest doesn't name: those of earlier builds and of builds that died. Not to be
    called while a build runs or a reader of an older graph is at work."""
    manifest = CompiledGraph.open(spark, base).manifest
    named = {e["folder"] for kind in manifest.values() for e in kind.values()}
    lost = [f"{kind}/{name}" for kind in ("vertices", "edges") for name in children(spark, f"{base}/{kind}") if f"{kind}/{name}" not in named]
    for folder in lost:
        remove(spark, f"{base}/{folder}")
    return lost
