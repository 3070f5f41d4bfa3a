"""Graph schemas from YAML: types, inheritance, and the triples that a request may use."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names of the schema files and what they hold.
TYPES: dict[str, T.DataType] = {
    "str": T.StringType(),
    "string": T.StringType(),
    "int": T.LongType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "str[]": T.ArrayType(T.StringType()),
    "float[]": T.ArrayType(T.DoubleType()),
    "obj": T.MapType(T.StringType(), T.StringType()),
    "list[tuple]": T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("description", T.StringType())])),
}


def _listed(x: Any) -> list[str]:
    return [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]


def _name(text: str) -> str:
    return text.replace(" ", "_")


@dataclass
class GraphSchema:
    """Vertex types and edge triples with their properties, inherited ones included."""

    nodes: dict[str, dict[str, str]] = field(default_factory=dict)
    parents: dict[str, list[str]] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], dict[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, *layers: Mapping[str, Any]) -> GraphSchema:
        """From parsed YAML mappings, later ones overriding earlier ones entry by entry."""
        entries: dict[str, Any] = {}
        for layer in layers:
            entries |= {k: v for k, v in (layer or {}).items() if isinstance(v, dict)}
        out = cls()

        def properties(name: str, seen: tuple[str, ...] = ()) -> dict[str, str]:
            entry = entries.get(name, {})
            found: dict[str, str] = {}
            if entry.get("inherit_properties"):
                for parent in _listed(entry.get("is_a")):
                    if parent not in seen:
                        found = properties(parent, (*seen, name)) | found
            return found | {k: str(v.get("type", "str") if isinstance(v, dict) else v) for k, v in (entry.get("properties") or {}).items()}

        for name, entry in entries.items():
            if entry.get("represented_as") == "edge":
                for source in _listed(entry.get("source")):
                    for target in _listed(entry.get("target")):
                        for label in _listed(entry.get("output_label") or entry.get("input_label") or name):
                            out.edges[_name(source), _name(label), _name(target)] = properties(name)
            else:
                out.nodes[_name(name)] = properties(name)
                out.parents[_name(name)] = [_name(p) for p in _listed(entry.get("is_a"))]
        return out

    @classmethod
    def read(cls, *paths: str) -> GraphSchema:
        import yaml

        layers = []
        for path in paths:
            with open(path) as f:  # a schema is a small file beside the program
                layers.append(yaml.safe_load(f))
        return cls.of(*layers)

    def triple_keys(self) -> set[str]:
        return {"_".join(t) for t in self.edges}

    def struct(self, label: str) -> T.StructType:
        """The row type of a vertex label; types that are not known are texts."""
        return T.StructType([T.StructField("id", T.StringType())] + [T.StructField(k, TYPES.get(v, T.StringType())) for k, v in self.nodes[label].items()])

    def node_rows(self, spark: SparkSession) -> DataFrame:
        """``(type, parent, property, property_type)``."""
        rows = [(n, p, k, t) for n, own in self.nodes.items() for p in (self.parents[n] or [None]) for k, t in (own.items() or [(None, None)])]
        return spark.createDataFrame(rows, "type string, parent string, property string, property_type string")

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        """``(source, label, target, property, property_type)``."""
        rows = [(*t, k, v) for t, own in self.edges.items() for k, v in (own.items() or [(None, None)])]
        return spark.createDataFrame(rows, "source string, label string, target string, property string, property_type string")

    def relations(self, spark: SparkSession, label: str) -> DataFrame:
        """Triples that begin or end at a label."""
        rows = self.edge_rows(spark).select("source", "label", "target").distinct()
        return rows.where((rows.source == _name(label)) | (rows.target == _name(label)))


def of_sources(spark: SparkSession, schemas: Mapping[str, GraphSchema], wanted: Collection[str] = ("all",)) -> tuple[DataFrame, DataFrame]:
    """What these data sources hold together: node types ``(id)`` and triples ``(source, label, target)``, each once.

    Sources are named in any case; names that no schema has are passed over, ``all`` means every one. Of a source with edges
    the types that its edges touch and it describes are given, of one without edges all its types.
    """
    asked = {w.upper() for w in wanted}
    own = [s for name, s in schemas.items() if "ALL" in asked or name.upper() in asked]
    triples = dict.fromkeys(t for s in own for t in s.edges)
    nodes = dict.fromkeys(n for s in own for n in ([x for a, _, b in s.edges for x in (a, b) if x in s.nodes] if s.edges else s.nodes))
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(list(triples), "source string, label string, target string")


def form_inputs(vertices: DataFrame, most: int = 50) -> DataFrame:
    """``(name, input, option)``: how a form asks for the properties of a type, learnt from its table.

    Numbers are asked for by ``number``; texts and booleans of at most ``most`` values by ``combobox``, with a row for each value; other
    texts by ``input``. Lists, maps and the id aren't asked for. One pass counts the values roughly; only
    columns whose count says that they might fit are counted exactly, so no column of many values is shuffled.
    """
    kinds = {f.name: f.dataType for f in vertices.schema if f.name != "id"}
    numbers = [c for c, t in kinds.items() if isinstance(t, T.NumericType)]
    texts = [c for c, t in kinds.items() if isinstance(t, (T.StringType, T.BooleanType))]
    # an estimate with an error of 2 % is never over twice the number, so no column that fits is lost
    rough = vertices.agg(F.count("*"), *[F.approx_count_distinct(F.col(f"`{c}`"), 0.02) for c in texts]).first()[1:] if texts else ()
    few = [c for c, n in zip(texts, rough, strict=True) if n <= 2 * most]
    spark = vertices.sparkSession
    plain = spark.createDataFrame([(c, "number") for c in numbers] + [(c, "input") for c in texts if c not in few], "name string, input string").withColumn("option", F.lit(None).cast("string"))
    if not few:
        return plain
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("option")) for c in few]))
    options = vertices.select(each.alias("o")).select("o.*").distinct()  # at most a few times ``most`` rows
    sizes = options.groupBy("name").agg(F.count("option").alias("n"))
    boxes = options.join(sizes.where(F.col("n") <= most), "name").where("option IS NOT NULL").select("name", F.lit("combobox").alias("input"), "option")
    # columns of more values than it seemed, and those without any
    asked = spark.createDataFrame([(c,) for c in few], "name string").join(sizes, "name", "left")
    rest = asked.where((F.coalesce("n", F.lit(0)) == 0) | (F.col("n") > most)).select("name", F.lit("input").alias("input"), F.lit(None).cast("string").alias("option"))
    return reduce(DataFrame.unionByName, [plain, boxes, rest])
