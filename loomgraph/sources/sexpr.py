"""Graphs written as S-expressions, one a line.

    (label id)                                  a vertex
    (property (label id) value)                 a vertex property
    (type (label id) (label id))                an edge
    (property (type (label id) (label id)) value)   an edge property

A value is a symbol or a parenthesised list; ``\\(`` and ``\\)`` are parentheses in a text, ``_`` a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_END = r"\(\s*(\S+)\s+((?:[^()\\\s]|\\.)+)\s*\)"
_VALUE = r"((?:[^()\\\s]|\\.)+|\((?:[^()\\]|\\.)*\))"
_SHAPES = {
    "edge_property": rf"^\s*\(\s*(\S+)\s+\(\s*(\S+)\s+{_END}\s+{_END}\s*\)\s+{_VALUE}\s*\)\s*$",
    "edge": rf"^\s*\(\s*(\S+)\s+{_END}\s+{_END}\s*\)\s*$",
    "vertex_property": rf"^\s*\(\s*(\S+)\s+{_END}\s+{_VALUE}\s*\)\s*$",
    "vertex": r"^\s*\(\s*([^()\s]+)\s+((?:[^()\\\s]|\\.)+)\s*\)\s*$",
}
#: Which group of a shape is which column.
_GROUPS = {
    "edge_property": {"property": 1, "type": 2, "source_label": 3, "source": 4, "target_label": 5, "target": 6, "value": 7},
    "edge": {"type": 1, "source_label": 2, "source": 3, "target_label": 4, "target": 5},
    "vertex_property": {"property": 1, "source_label": 2, "source": 3, "value": 4},
    "vertex": {"source_label": 1, "source": 2},
}
COLUMNS = ("property", "type", "source_label", "source", "target_label", "target", "value")


def plain(text: Column) -> Column:
    """A symbol as text: escapes resolved, underscores as blanks."""
    return F.regexp_replace(F.translate(text, "_", " "), r"\\(.)", "$1")


def value_text(value: Column, kind: T.DataType) -> Column:
    """A typed value as an expression writes it: numbers and booleans bare, a null as ``"null"``, lists, maps and structs as
    JSON in quotes, texts bare unless they hold a blank, a newline or a bracket. In quotes ``\\`` stands before ``"`` and ``\\``."""
    text = F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        shown = text
    elif isinstance(kind, T.StringType):
        shown = F.when(text.rlike(r"[ \n()\[\]{}]"), quoted).otherwise(text)
    else:
        shown = quoted
    return F.coalesce(shown, F.lit('"null"'))


def property_lines(vertices: DataFrame, label: str) -> DataFrame:
    """``(id, line)``: ``(property (label id) value)`` for every vertex and property that it has."""
    own = [f for f in vertices.schema if f.name != "id"]
    begun = lambda name: F.concat(F.lit(f"({name} ({label} "), F.col("id").cast("string"), F.lit(") "))
    lines = [F.when(F.col(f.name).isNotNull(), F.concat(begun(f.name), value_text(F.col(f.name), f.dataType), F.lit(")"))) for f in own]
    return vertices.select("id", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(kind, property, type, source_label, source, target_label, target, value)``, ``value`` an array
    of texts. Lines of no known shape have kind ``unknown``; blank lines and ``;`` comments are skipped."""
    line = F.col(column)
    kind = F.lit("unknown")
    for name in reversed(_SHAPES):
        kind = F.when(line.rlike(_SHAPES[name]), name).otherwise(kind)
    rows = lines.where(~line.rlike(r"^\s*(;.*)?$")).select(line.alias("line"), kind.alias("kind"))

    def part(name: str) -> Column:
        out = F.lit(None).cast("string")
        for shape, groups in _GROUPS.items():
            if name in groups:
                out = F.when(F.col("kind") == shape, F.regexp_extract("line", _SHAPES[shape], groups[name])).otherwise(out)
        return out

    flat = rows.select("kind", *[part(c).alias(c) for c in COLUMNS])
    items = F.split(F.regexp_replace("value", r"^\((.*)\)$", "$1"), r"(?<!\\)\s+")
    values = F.when(F.col("value").isNotNull(), F.transform(F.filter(items, lambda x: x != ""), plain))
    return flat.select("kind", *COLUMNS[:-1], values.alias("value"))


def read_sexpr(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.metta`` files below ``path``, parsed; a missing path is a ``ValueError``."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.metta").text(path)
    except AnalysisException as e:
        raise ValueError(f"no data at '{path}'") from e
    return parse_lines(lines)


def vertices_of(parsed: DataFrame, label: str, properties: dict[str, bool]) -> DataFrame:
    """One label's vertices with the named properties; True for one that is a list."""
    own = parsed.where((F.col("source_label") == label) & F.col("kind").isin("vertex", "vertex_property"))
    values = [F.max(F.when(F.col("property") == p, F.col("value") if many else F.array_join("value", " "))).alias(p) for p, many in properties.items()]
    return own.groupBy(F.col("source").alias("id")).agg(*values) if values else own.select(F.col("source").alias("id")).distinct()


def edges_of(parsed: DataFrame, source: str, name: str, target: str, properties: tuple[str, ...] = ()) -> DataFrame:
    """One triple's edges; a property's values on equal edges are collected."""
    own = parsed.where((F.col("type") == name) & (F.col("source_label") == source) & (F.col("target_label") == target))
    values = [F.sort_array(F.flatten(F.collect_set(F.when(F.col("property") == p, F.col("value"))))).alias(p) for p in properties]
    by = own.groupBy(F.col("source").alias("src"), F.col("target").alias("dst"))
    out = by.agg(*values) if values else own.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return out.withColumn("uid", F.xxhash64("src", F.lit(name), "dst"))
