"""Small files and folders in whatever store Spark reads: listing, exclusive creation, replacing by a rename."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from loomgraph.session import remove

__all__ = ["age", "children", "create_text", "exists", "listed", "now", "read_text", "remove", "replace_text"]


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, paths: Sequence[str]) -> list[list]:
    """``[path, length, modification time]`` of every file at or below the paths (patterns allowed), sorted; an error where
    nothing is. Hidden files and markers (``_...``, ``....``) are no inputs."""
    found = []
    for path in paths:
        fs, where = _at(spark, path)
        matched = fs.globStatus(where)
        if not matched:
            raise FileNotFoundError(path)
        for status in matched:
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                if not str(f.getPath().getName()).startswith(("_", ".")):
                    found.append([str(f.getPath().toString()), int(f.getLen()), int(f.getModificationTime())])
    return sorted(found)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names right below a folder; none where there is no folder."""
    fs, where = _at(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    fs, where = _at(spark, path)
    try:
        stream = fs.open(where)
    except Py4JJavaError as e:
        if "FileNotFound" in e.java_exception.getClass().getName():
            return None
        raise
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file unless it exists; of several that try at once one succeeds. What others read is whole only
    where the store shows a file when it is closed; use it for marks whose being there is what counts."""
    fs, where = _at(spark, path)
    if str(fs.getUri().getScheme()) == "file":  # Hadoop's local store looks first and creates then; the system call does both
        local = str(where.toUri().getPath())
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            made = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(made, "w") as f:
            f.write(text)
        return True
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a new file in the place of an old one by a rename, so readers see the one or the other, whole."""
    fs, where = _at(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    create_text(spark, fresh, text)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(_at(spark, fresh)[1], where, options)


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was last changed, by the store's clock for the file and this machine's for now; None where there is none."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    return now(spark) - fs.getFileStatus(where).getModificationTime() / 1000


def now(spark: SparkSession) -> float:
    return spark.sparkContext._jvm.System.currentTimeMillis() / 1000
