"""Files that arrive in a folder become rows of the parsed-graph table, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomgraph.sources.sexpr import parse_lines


def ingest_sexpr(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Takes all files there are and stops; started again with the same checkpoint it takes what is new."""
    lines = spark.readStream.option("pathGlobFilter", "*.metta").option("recursiveFileLookup", "true").text(folder)
    return parse_lines(lines).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start()
