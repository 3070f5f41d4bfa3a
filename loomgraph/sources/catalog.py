"""Where vertices and edges are: one DataFrame for each label and for each (source, type, target)."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Triple = tuple[str, str, str]


class GraphCatalog:
    """Vertex frames have ``id`` and typed properties; edge frames ``src, dst, uid`` and properties.

    A frame may be given as a function that makes it, called when a query first asks for it; then
    only the columns that the query needs are read.
    """

    def __init__(self, spark: SparkSession, vertices: Mapping[str, DataFrame | Callable[[], DataFrame]], edges: Mapping[Triple, DataFrame | Callable[[], DataFrame]]):
        self.spark, self._vertices, self._edges = spark, dict(vertices), dict(edges)

    @classmethod
    def read(cls, spark: SparkSession, base: str, labels: list[str], triples: list[Triple]) -> GraphCatalog:
        """From Parquet folders ``vertices/label=...`` and ``edges/triple=...`` as ``write`` lays them out."""
        return cls(spark, {x: spark.read.parquet(f"{base}/vertices/label={x}") for x in labels}, {t: spark.read.parquet(f"{base}/edges/triple={'-'.join(t)}") for t in triples})

    def write(self, base: str) -> None:
        for label in self._vertices:
            self.vertices(label).write.mode("overwrite").parquet(f"{base}/vertices/label={label}")
        for triple in self._edges:
            self.edges(*triple).write.mode("overwrite").parquet(f"{base}/edges/triple={'-'.join(triple)}")

    def labels(self) -> list[str]:
        return list(self._vertices)

    def triples(self) -> list[Triple]:
        return list(self._edges)

    def triple_keys(self) -> set[str]:
        return {"_".join(t) for t in self._edges}

    def vertices(self, label: str) -> DataFrame:
        if label not in self._vertices:
            raise ValueError(f"no vertices of type '{label}'")
        return self._made(self._vertices, label)

    def edges(self, source: str, name: str, target: str) -> DataFrame:
        if (source, name, target) not in self._edges:
            raise ValueError(f"no edges '{name}' from '{source}' to '{target}'")
        return self._made(self._edges, (source, name, target))

    @staticmethod
    def _made(frames: dict, key: str | Triple) -> DataFrame:
        if callable(frames[key]):
            frames[key] = frames[key]()
        return frames[key]

    def of_sources(self, names: Collection[str], column: str = "source") -> GraphCatalog:
        """The catalog with only the edges (and vertices) that come from these data sources; frames without
        the column stay whole."""

        def only(df: DataFrame) -> DataFrame:
            return df.where(F.col(column).isin(*names)) if column in df.columns else df

        return GraphCatalog(self.spark, {x: (lambda x=x: only(self.vertices(x))) for x in self._vertices}, {t: (lambda t=t: only(self.edges(*t))) for t in self._edges})

    def all_vertices(self) -> DataFrame:
        """``(type, id)`` of every vertex."""
        return reduce(DataFrame.unionAll, [v.select(F.lit(x).alias("type"), F.col("id").cast("string").alias("id")) for x in self._vertices for v in (self.vertices(x),)])

    def all_edges(self) -> DataFrame:
        """``(source_type, type, target_type, source, target)`` of every edge."""
        return reduce(DataFrame.unionAll, [e.select(F.lit(a).alias("source_type"), F.lit(t).alias("type"), F.lit(b).alias("target_type"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target")) for a, t, b in self._edges for e in (self.edges(a, t, b),)])

    def counts(self) -> dict[Triple, int]:
        """Edges by triple, for ordering patterns."""
        return {(r.source_type, r.type, r.target_type): r["count"] for r in self.all_edges().groupBy("source_type", "type", "target_type").count().collect()}


def for_species(catalogs: Mapping[str, GraphCatalog], species: str) -> GraphCatalog:
    """One catalog of several by species."""
    if species not in catalogs:
        raise ValueError(f"no graph of '{species}'; there are {', '.join(sorted(catalogs))}")
    return catalogs[species]
