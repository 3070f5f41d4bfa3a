"""Readers of delimited and JSON graph files, and writers of result graphs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import safe_name


def read_node_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated ``nodes_<label>.csv`` files below ``path``; the label comes from the file's name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "nodes_*.csv").csv(path, header=True, sep="|")
    return rows.withColumn("label", F.regexp_extract(F.input_file_name(), r"nodes_([^/]+)\.csv$", 1))


def completion_index(nodes: DataFrame, label_col: str = "label") -> DataFrame:
    """``(id, label, name)`` for prefix search, the name from the column ``<label>_name``."""
    names = [F.when(F.col(label_col) == c.removesuffix("_name"), F.col(c)) for c in nodes.columns if c.endswith("_name")]
    return nodes.select("id", F.col(label_col).alias("label"), F.coalesce(*names, F.col("id").cast("string")).alias("name"))


def complete(index: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return index.where(F.lower("name").startswith(prefix.lower())).orderBy("name", "id").limit(n)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of result graphs ``{"nodes": [{"data": ...}], "edges": [{"data": ...}]}``. A path without a file, and a
    graph without nodes or edges, give tables without rows: ``(id, type, name)`` and ``(edge_id, label, source, target)``."""
    bare = {"nodes": "id string, type string, name string", "edges": "edge_id string, label string, source string, target string"}
    try:
        whole = spark.read.option("multiLine", "true").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = spark.createDataFrame([], "nodes array<string>, edges array<string>")

    def part(name: str) -> DataFrame:
        items = whole.schema[name].dataType if name in whole.columns else None
        if not isinstance(items, T.ArrayType) or not isinstance(items.elementType, T.StructType):  # what holds nothing has no fields
            return spark.createDataFrame([], bare[name])
        return whole.select(F.explode(name).alias("x")).select("x.data.*")

    return part("nodes"), part("edges")


def graph_json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, json)``: one line for each node and edge, for distributed writing."""
    one = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(F.struct(*df.columns).alias("data"))).alias("json"))
    return one(nodes, "nodes").unionAll(one(edges, "edges"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines in ``part=nodes`` and ``part=edges``."""
    graph_json_rows(nodes, edges).write.mode("overwrite").partitionBy("part").text(path)


def tsv_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", "type")


def tsv_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "label")


def write_tsv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    for name, rows in (("nodes", tsv_nodes(nodes)), ("edges", tsv_edges(edges))):
        rows.write.mode("overwrite").option("sep", "\t").csv(f"{path}/{name}", header=True)


def write_sheets(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """CSV files by node type and by edge id, the sheets of a workbook."""
    nodes.write.mode("overwrite").partitionBy("type").csv(f"{path}/nodes", header=True)
    edges.write.mode("overwrite").partitionBy("edge_id").csv(f"{path}/edges", header=True)


#: Characters of a sheet's name. A fixed value.
SHEET = 31


def node_sheets(nodes: DataFrame, members: DataFrame, grouped: DataFrame) -> DataFrame:
    """``(sheet, id, type, member, name)``: a sheet for each node type, groups flattened.

    A node that stands for ``members(parent, child)`` becomes a row for each of them, with the group's id, the member's and the
    member's name from ``grouped(id, name)`` (or its id); any other node is one row without a member. Types that agree in
    ``SHEET`` characters share a sheet.
    """
    named = members.join(grouped.select(F.col("id").alias("child"), F.col("name").alias("own")), "child", "left").select(F.col("parent").alias("id"), "child", F.coalesce("own", "child").alias("own"))
    return nodes.join(named, "id", "left").select(F.substring("type", 1, SHEET).alias("sheet"), "id", "type", F.col("child").alias("member"), F.coalesce("own", "name").alias("name"))


def edge_sheets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(sheet, edge_id, label, source, target)``: a sheet for the edges between each two node types. Ends that are not among
    the nodes count under the first part of their id."""
    kinds = lambda end: nodes.groupBy(F.col("id").alias(end)).agg(F.min("type").alias(f"{end}_type"))
    ends = edges.join(kinds("source"), "source", "left").join(kinds("target"), "target", "left")
    typed = lambda end: F.coalesce(f"{end}_type", F.substring_index(end, " ", 1))
    return ends.select(F.substring(F.concat(typed("source"), F.lit("-relationship-"), typed("target")), 1, SHEET).alias("sheet"), "edge_id", "label", "source", "target")


def write_workbook(sheets: DataFrame, path: str) -> None:
    """A folder of CSV files for each sheet."""
    sheets.write.mode("overwrite").partitionBy("sheet").csv(path, header=True)


#: INFO fields of a variant by its property, with number, type and description.
INFO = {
    "caf_ref": ("CAF_REF", "1", "Float", "Reference allele frequency"),
    "caf_alt": ("CAF_ALT", ".", "Float", "Alternate allele frequency"),
    "raw_cadd_score": ("CADD_RAW", "1", "Float", "Raw CADD score"),
    "phred_score": ("CADD_PHRED", "1", "Float", "Phred CADD score"),
    "name": ("NAME", "1", "String", "Variant Name"),
}


def vcf_rows(variants: DataFrame) -> DataFrame:
    """``(chr, start, line)``: a VCF 4.2 line for each variant; properties that are missing leave no trace."""
    text = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing)) if c in variants.columns else F.lit(missing)
    shown = lambda c: safe_name(F.col(c).cast("string")) if c == "name" else F.col(c).cast("string")
    info = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{field}="), shown(c))) for c, (field, *_) in INFO.items() if c in variants.columns]
    said = F.coalesce(F.nullif(F.concat_ws(";", *info), F.lit("")), F.lit(".")) if info else F.lit(".")
    line = F.concat_ws("\t", text("chr", "."), text("start", "0"), F.translate(text("id", "."), " ", "_"), text("ref", "."), text("alt", "."), F.lit("."), F.lit("PASS"), said)
    return variants.select(F.coalesce(F.col("chr").cast("string"), F.lit("")).alias("chr"), F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"), line.alias("line"))


def vcf_header(variants: DataFrame, name: str) -> DataFrame:
    """The header's lines in order: ``(ordinal, line)``; one contig for each chromosome."""
    spark = variants.sparkSession
    head = ["##fileformat=VCFv4.2", f"##source={name}", "##reference=hg38"]
    tail = [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFO.values()] + ["\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"))]
    fixed = spark.createDataFrame([(i, "", x) for i, x in enumerate(head)] + [(10 + i, "", x) for i, x in enumerate(tail)], "part int, chr string, line string")
    contigs = variants.where("chr IS NOT NULL").select("chr").distinct().select(F.lit(5).alias("part"), "chr", F.concat(F.lit("##contig=<ID="), F.col("chr"), F.lit(">")).alias("line"))
    return fixed.unionByName(contigs)


def write_vcf(variants: DataFrame, path: str, name: str) -> None:
    """Header and variants, sorted by chromosome and position; the files in order of their names are the VCF."""
    rows = vcf_rows(variants).select(F.lit(99).alias("part"), "chr", "start", "line")
    head = vcf_header(variants, name).select("part", "chr", F.lit(0).cast("long").alias("start"), "line")
    head.unionByName(rows).orderBy("part", "chr", "start", "line").select("line").write.mode("overwrite").text(path)


def read_edge_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(edge_key, name, count)`` of a statistics file ``{"key": {"count": n, "name": text}}``."""
    whole = spark.read.option("multiLine", "true").text(path, wholetext=True)
    each = F.explode(F.from_json("value", "map<string, struct<count: bigint, name: string>>")).alias("edge_key", "v")
    return whole.select(each).select("edge_key", F.col("v.name").alias("name"), F.col("v.count").alias("count"))
