"""A prefix index for completing names: sorted keys in range partitions, and lists of the best for short prefixes.

Names are kept in lower case, sorted over range partitions, each of which becomes files of its own; a table of
the files' first and last keys says which can hold a prefix, so a search reads one file or few, and in them the row
groups that the pushed prefix filter leaves. Prefixes of one to ``SHORT`` characters, which may cover most of the table, are
answered from a table of their first ``best`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import checkpointed, parallelism

SHORT = 3


def write_index(names: DataFrame, path: str, *, best: int = 10, short: int = SHORT, partitions: int | None = None) -> None:
    """Writes the index of ``names(id, label, name)``; rows without a name are left out, names may repeat.

    Each range keeps its own first ``best`` names of a short prefix before they meet, so no task sees a prefix's rows whole.
    """
    spark = names.sparkSession
    rows = names.where("name IS NOT NULL").select(F.lower("name").alias("key"), "name", F.col("id").cast("string").alias("id"), "label")
    order = ["name", "id", "label"]
    n = partitions or parallelism(spark)
    ranged = checkpointed(rows.repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order))
    ranged.write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    file = F.col("_metadata.file_path")
    bounds = written.select("key", file.alias("file")).groupBy("file").agg(F.min("key").alias("least"), F.max("key").alias("greatest"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/files")  # a row a file
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key"), F.lit(short))), lambda k: F.substring("key", F.lit(1), k)))
    prefixes = ranged.where("key <> ''").withColumn("p", F.spark_partition_id()).withColumn("prefix", cut)
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= best)
    lists = first(first(prefixes, "p", "prefix").drop("rank"), "prefix").select("prefix", "rank", "id", "label", "name")
    lists.repartitionByRange(n, "prefix").sortWithinPartitions("prefix", "rank").write.mode("overwrite").parquet(f"{path}/best")
    spark.createDataFrame([(best, short)], "best int, short int").write.mode("overwrite").parquet(f"{path}/settings")


def search(spark: SparkSession, path: str, prefix: str, n: int = 10) -> DataFrame:
    """``(id, label, name)``: the first ``n`` names, by name and id, that begin with ``prefix`` in any case.

    A short prefix is looked up in its list as long as ``n`` names are in it; any other is sought in the files whose bounds
    allow it (their names come to the driver, a few for a long prefix).
    """
    best, short = spark.read.parquet(f"{path}/settings").first()
    wanted = prefix.lower()
    if 1 <= len(wanted) <= short and n <= best:
        return spark.read.parquet(f"{path}/best").where((F.col("prefix") == wanted) & (F.col("rank") <= n)).orderBy("rank").select("id", "label", "name")
    files = files_of(spark, path, wanted)
    rows = spark.read.schema("key string, name string, id string, label string").parquet(*files) if files else spark.createDataFrame([], "key string, name string, id string, label string")
    return rows.where(F.col("key").startswith(wanted)).orderBy("name", "id", "label").limit(n).select("id", "label", "name")


def files_of(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The files that can hold keys with a prefix: those that don't end before it or begin behind all that start with it."""
    bounds = spark.read.parquet(f"{path}/files")
    may = (F.col("greatest") >= prefix) & ((F.col("least") <= prefix) | F.col("least").startswith(prefix))
    return [r.file for r in bounds.where(may).select("file").collect()]
