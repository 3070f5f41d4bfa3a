"""Counts over a whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.catalog import GraphCatalog


def entities(catalog: GraphCatalog) -> DataFrame:
    return catalog.all_vertices().agg(F.count("*").alias("entities"))


def connections(catalog: GraphCatalog) -> DataFrame:
    return catalog.all_edges().agg(F.count("*").alias("connections"))


def label_histogram(catalog: GraphCatalog) -> DataFrame:
    return catalog.all_vertices().groupBy("type").agg(F.count("*").alias("n"))


def triple_histogram(catalog: GraphCatalog) -> DataFrame:
    """By type, the most frequent first within one."""
    return catalog.all_edges().groupBy("type", "source_type", "target_type").agg(F.count("*").alias("n")).orderBy("type", F.desc("n"))


def type_histogram(catalog: GraphCatalog) -> DataFrame:
    return catalog.all_edges().groupBy("type").agg(F.count("*").alias("n"))
