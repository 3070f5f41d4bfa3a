"""Session helpers: table access and reliable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors cost no
    recomputation of what lies before it. The folder is the cluster's ``spark.checkpoint.dir``; only
    on a local master (tests, a laptop) a temporary one is made where that is unset.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: a cut like ``checkpointed``, in compressed columns, of
    which readers take those they need and the number of rows from the footers. Order and partitions aren't kept."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many narrow rows (a few numbers) at most, about, go to one task where the number of tasks follows the rows.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str, most: int | None = None) -> DataFrame:
    """``df`` dealt by its keys to as many tasks as about ``rows`` rows need, ``most`` each, at least one for each core.

    Spark merges small shuffle partitions by their compressed bytes; where rows are narrow or alike, what a task then
    sorts or hashes is many times as much and grows with the data. Partitions by number stay as they are.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // (most or TASK_ROWS))), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below the shared checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path not used before in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``shared_path``, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """The number of partitions that a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of an application, once, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "loomgraph"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
