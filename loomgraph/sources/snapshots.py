"""A keyed table whose merges are seen whole or not at all.

Rows are dealt to hash buckets of their key, each bucket a folder. A merge reads the buckets that its rows fall in,
writes these anew beside the old ones, and publishes a manifest that names, for each bucket, the folder that
holds it. Manifests are numbered, and the next number can be claimed once: of two merges that started from
one snapshot the later is told to start again from the new one. Readers take the newest published manifest and so one
snapshot; a merge that dies before it publishes leaves folders that nobody names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.sources.store import age, children, create_text, read_text, remove, replace_text

_BUCKET = "__bucket"
#: Seconds after which a claim that hasn't published is taken for dead.
CLAIM_SECONDS = 600.0


class Superseded(RuntimeError):
    """Another merge has published since the snapshot was taken."""


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    base: str
    version: int
    manifest: Mapping

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    @property
    def keys(self) -> list[str]:
        return self.manifest["keys"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.manifest["n_buckets"])).cast("int")

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the snapshot, or of some of its buckets."""
        folders = [f for b, f in self.manifest["buckets"].items() if buckets is None or int(b) in set(buckets)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{f}" for f in folders])


def create(spark: SparkSession, base: str, schema: StructType, keys: Sequence[str], *, n_buckets: int = 64) -> Snapshot:
    """An empty table; an error where there is one already."""
    if missing := set(keys) - set(schema.fieldNames()):
        raise ValueError(f"no column '{min(missing)}'")
    manifest = {"schema": schema.jsonValue(), "keys": list(keys), "n_buckets": n_buckets, "buckets": {}}
    if not _publish(spark, base, 0, manifest):
        raise ValueError(f"there is a table at '{base}'")
    return Snapshot(spark, base, 0, manifest)


def current(spark: SparkSession, base: str) -> Snapshot:
    """The newest published snapshot."""
    versions = _versions(spark, base)
    if not versions:
        raise ValueError(f"no table at '{base}'")
    return Snapshot(spark, base, versions[-1], json.loads(read_text(spark, _manifest(base, versions[-1]))))


def upsert(spark: SparkSession, base: str, changes: DataFrame, *, retries: int = 5) -> Snapshot:
    """Merges ``changes`` by key: columns that they have replace those of a row with the key (nulls too), other columns of it
    stay, and keys that are new are inserted with nulls for columns that the changes lack.

    Keys must not be null and each may change once in a merge; anything else is an error, and nothing is changed.
    Where another merge publishes meanwhile, this one starts again, ``retries`` times at most.
    """
    for attempt in range(retries + 1):
        try:
            return _merge(current(spark, base), changes)
        except Superseded:
            if attempt == retries:
                raise
    raise AssertionError


def _merge(old: Snapshot, changes: DataFrame) -> Snapshot:
    spark, keys, names = old.spark, old.keys, old.schema.fieldNames()
    if unknown := set(changes.columns) - set(names):
        raise ValueError(f"no column '{min(unknown)}'")
    if missing := set(keys) - set(changes.columns):
        raise ValueError(f"changes need the key '{min(missing)}'")
    kinds = {f.name: f.dataType for f in old.schema.fields}
    new = changes.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in changes.columns]).withColumn(_BUCKET, old.bucket())
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(f"`{k}`").isNull()
    touched = new.groupBy(_BUCKET).agg(F.max(null_key.cast("int")).alias("null_keys")).collect()  # a row a bucket at most
    if not touched:
        return old
    if any(r.null_keys for r in touched):
        raise ValueError("a key is null")
    if not new.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a key changes more than once")
    buckets = [r[_BUCKET] for r in touched]
    changed = [c for c in changes.columns if c not in keys]
    renamed = new.select(*keys, F.lit(True).alias("__new"), *[F.col(f"`{c}`").alias(f"__new_{c}") for c in changed])
    both = old.rows(buckets).join(renamed, keys, "full")
    value = lambda c: F.col(f"`{c}`") if c in keys or c not in changed else F.when(F.col("__new"), F.col(f"`__new_{c}`")).otherwise(F.col(f"`{c}`"))
    merged = both.select(*[value(c).alias(c) for c in names]).withColumn(_BUCKET, old.bucket())
    run = f"data/{uuid.uuid4().hex}"
    merged.repartition(len(buckets), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{old.base}/{run}")
    manifest = dict(old.manifest) | {"buckets": dict(old.manifest["buckets"]) | {str(b): f"{run}/{_BUCKET}={b}" for b in buckets}}
    if not _publish(spark, old.base, old.version + 1, manifest):
        remove(spark, f"{old.base}/{run}")
        raise Superseded(f"version {old.version + 1} is another's")
    return Snapshot(spark, old.base, old.version + 1, manifest)


def _manifest(base: str, version: int) -> str:
    return f"{base}/manifests/{version:012d}.json"


def _versions(spark: SparkSession, base: str) -> list[int]:
    return [int(n[:12]) for n in children(spark, f"{base}/manifests") if len(n) == 17 and n.endswith(".json") and n[:12].isdigit()]


def _publish(spark: SparkSession, base: str, version: int, manifest: Mapping) -> bool:
    """Claims the version's number and puts its manifest there by a rename; False if the number is another's. The claim of
    a merge that died in between is void after ``CLAIM_SECONDS``."""
    claim = f"{base}/claims/{version:012d}"
    mine = uuid.uuid4().hex
    attempt = 0
    while not create_text(spark, f"{claim}-{attempt}", mine):
        if version in _versions(spark, base) or (age(spark, f"{claim}-{attempt}") or 0) < CLAIM_SECONDS:
            return False
        attempt += 1
    if version in _versions(spark, base):
        return False
    replace_text(spark, _manifest(base, version), json.dumps(manifest, sort_keys=True))
    return True


def vacuum(spark: SparkSession, base: str, *, keep: int = 1) -> list[str]:
    """Removes manifests older than the newest ``keep`` and the bucket folders that only they, or merges that died, have.
    Not to be called while a merge runs or a reader is at an older snapshot."""
    versions = _versions(spark, base)
    kept = versions[-keep:]
    for v in versions[:-keep]:
        remove(spark, _manifest(base, v))
    named = {f for v in kept for f in json.loads(read_text(spark, _manifest(base, v)))["buckets"].values()}
    lost = [f"data/{run}/{b}" for run in children(spark, f"{base}/data") for b in children(spark, f"{base}/data/{run}") if b.startswith(_BUCKET) and f"data/{run}/{b}" not in named]
    for folder in lost:
        remove(spark, f"{base}/{folder}")
    return lost
