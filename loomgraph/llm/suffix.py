"""Removal of repeated 100-byte strings, by blockwise suffix sorting with a difference cover.

A byte goes if a ``LENGTH``-byte string over it also starts earlier: in a document with a smaller id,
or before it in the same one. Only suffixes of equal first ``LENGTH`` bytes matter, so the suffix
array is built to that depth and a bucket is sorted by 64-bit images of prefixes, any order of which
puts equal ones side by side. (Images and not the bytes themselves, which would be 100 times the text.)

Memory and shuffle are bounded as in blockwise construction with a difference cover:

1. Positions whose remainder modulo ``PERIOD`` is in ``COVER`` are the sample. For any two positions
   some offset below ``PERIOD`` takes both into the sample, so two equal strings hold a sample
   position each, at the same offset, whose ``NAMED`` bytes are equal. The sample's names are ranked
   bucket by bucket; all that is kept of a rank is whether it is tied, one bit.
2. Only suffixes within reach of a tied sample position can tie to full depth. These, and of equal
   ones in a block only the first, are dealt to buckets and each bucket is sorted by itself; the
   answer is again one bit: whether an earlier block has the same prefix.
3. Each block marks what is covered.

Documents are dealt once to ranges of (id, digest) and cut into blocks of about ``BLOCK_BYTES`` by their
running size (a longer document is a block whole), so the order of blocks is the order of documents,
however ids and sizes are spread. Blocks are written as a table bucketed by block in the warehouse, so
that the text never moves again and only names and bits shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textkit import Spans, slices, utf8
from loomgraph.session import checkpointed, parallelism

LENGTH = 100
#: A perfect difference set: every nonzero remainder modulo 57 is a difference of two of these, once.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
NAMED = LENGTH - PERIOD + 1
BLOCK_BYTES = 8 << 20
BUCKET_ENTRIES = 2 << 20
#: Salts over which a text's copies are dealt.
SALTS = 16
_REPLY = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])
_REPLY_SQL = "block long, kind int, bucket long, bits binary"
_WORK_SQL = "bucket long, block long, entries binary"


def same_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the values, where each run of equal ones begins in it, and each one's run."""
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Block:
    """The documents of a block in order, without those that copy an earlier document whole."""

    def __init__(self, table: pa.Table, replies: pa.Table | None):
        order = table.select(["doc_id", "sha"]).append_column("n", pa.array(np.arange(table.num_rows))).sort_by([("doc_id", "ascending"), ("sha", "ascending")]).column("n")
        self.table = table.take(order)
        replies = [] if replies is None else list(zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True))
        copies = {bits for kind, _, bits in replies if kind == 0}
        self.said = {(kind, bucket): bits for kind, bucket, bits in replies if kind}
        keys = list(zip(self.table.column("doc_id").to_pylist(), self.table.column("sha").to_pylist(), strict=True))
        keep = [f"{d}:{s}".encode() not in copies and (i == 0 or keys[i - 1] != (d, s)) for i, (d, s) in enumerate(keys)]
        self.table = self.table.filter(pa.array(keep, pa.bool_()))
        self.data, self.offsets = utf8(self.table.column("text"))

    def images(self, at: np.ndarray, size: int) -> np.ndarray:
        """64-bit images of the ``size`` bytes from each of the ascending positions."""
        out = np.zeros(len(at), np.uint64)
        for lo, hi in slices(self.offsets, 256 << 10):
            a, b = self.offsets[lo], self.offsets[hi]
            x, y = np.searchsorted(at, [a, b])
            if y > x:
                out[x:y] = Spans(self.data[a:b]).hash(at[x:y] - a, at[x:y] - a + size)
        return out

    def sample(self) -> np.ndarray:
        """Positions of the sample, in order."""
        cover, found = np.array(COVER), [np.zeros(0, np.int64)]
        for a, b in pairwise(self.offsets.tolist()):
            own = (np.arange(a, b, PERIOD)[:, None] + cover).ravel()
            found.append(own[: np.searchsorted(own, b - NAMED, side="right")])
        return np.concatenate(found)

    def bits(self, kind: int, bucket: int, n: int) -> np.ndarray:
        bits = self.said.get((kind, bucket))
        return np.zeros(n, bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)

    def tied(self, buckets: int) -> np.ndarray:
        """Which positions of the sample have a name that is also elsewhere, in this block or another."""
        names = self.images(self.sample(), NAMED)
        order, starts, run = same_runs(names)
        tie = np.diff(np.append(starts, len(names))) > 1
        for bucket, own in by_bucket(names[order[starts]], buckets):
            tie[own] |= self.bits(1, bucket, len(own))
        out = np.zeros(len(names), bool)
        out[order] = tie[run]
        return out

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Positions, in order, of suffixes that may tie to full depth: those within reach of a tied one."""
        at = self.sample()[tied]
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        first = np.maximum(at - PERIOD + 1, self.offsets[doc])
        after = np.maximum(np.minimum(at, self.offsets[doc + 1] - LENGTH) + 1, first)
        cover = np.bincount(first, minlength=len(self.data) + 1).astype(np.int32)
        cover -= np.bincount(after, minlength=len(self.data) + 1).astype(np.int32)
        return np.flatnonzero(np.cumsum(cover, dtype=np.int32)[:-1] > 0)


def by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with values, and the indices of these in their order; values are sorted and distinct, and
    buckets are ranges of their upper halves."""
    if not len(values):
        return
    of = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(of)).tolist(), strict=True):
        yield int(of[a]), np.arange(a, b)


def _work(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, e = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int64()), "block": pa.array(k, pa.int64()), "entries": pa.array(e, pa.binary())})


def _replies(kind: int, bucket: int, blocks: list[int], flags: list[np.ndarray]) -> pa.Table:
    some = [(k, f) for k, f in zip(blocks, flags, strict=True) if f.any()]
    return pa.table({"block": pa.array([k for k, _ in some], pa.int64()), "kind": pa.array([kind] * len(some), pa.int32()), "bucket": pa.array([bucket] * len(some), pa.int64()), "bits": pa.array([np.packbits(f).tobytes() for _, f in some], pa.binary())}, schema=_REPLY)


def rank_sample(work: pa.Table) -> pa.Table:
    """One bucket of sample names: which are in more than one block."""
    work = work.sort_by("block")
    entries = [np.frombuffer(e.as_py(), "<u4") for e in work.column("entries")]
    order, starts, run = same_runs(np.concatenate(entries))
    tied = np.zeros(len(order), bool)
    tied[order] = (np.diff(np.append(starts, len(order))) > 1)[run]
    return _replies(1, work.column("bucket")[0].as_py(), work.column("block").to_pylist(), np.split(tied, np.cumsum([len(x) for x in entries])[:-1]))


def sort_bucket(work: pa.Table) -> pa.Table:
    """One bucket of suffixes: which have their prefix in an earlier block too. (A block's own bits,
    in a bucket of their own below 0, are passed on.)"""
    bucket = work.column("bucket")[0].as_py()
    if bucket < 0:
        return pa.table({"block": work.column("block"), "kind": pa.array([3] * work.num_rows, pa.int32()), "bucket": pa.array([0] * work.num_rows, pa.int32()), "bits": work.column("entries")}, schema=_REPLY)
    work = work.sort_by("block")
    lists = []
    for e in work.column("entries"):
        narrow = np.frombuffer(e.as_py(), np.uint8).reshape(-1, 7)
        wide = np.zeros((len(narrow), 8), np.uint8)
        wide[:, :7] = narrow
        lists.append(wide.view("<u8").ravel())
    order, starts, run = same_runs(np.concatenate(lists))
    later = np.zeros(len(order), bool)
    later[order] = order != np.minimum.reduceat(order, starts)[run]
    return _replies(2, bucket, work.column("block").to_pylist(), np.split(later, np.cumsum([len(x) for x in lists])[:-1]))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, on UTF-8 bytes.

    Null texts count as empty; texts of fewer than ``LENGTH`` bytes lose nothing. Rows without an id
    come last. Rows that repeat an id come in the order of their texts' digests; rows that repeat id
    and text are one document and get the same result. Other columns are never read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    heads = checkpointed(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    total = heads.where(F.col("n_bytes") >= LENGTH).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(parallelism(spark), -(-total // (16 * BLOCK_BYTES)))
    names = max(parallelism(spark), -(-total * len(COVER) // PERIOD // BUCKET_ENTRIES))
    suffixes = max(parallelism(spark), -(-total // 4 // BUCKET_ENTRIES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seen = TaskContext.get().partitionId() << 32, 0  # ranges ascend with the partition's number
        for batch in batches:
            size = np.diff(utf8(batch.column(1))[1])
            before = seen + np.cumsum(size) - size
            seen += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + before // BLOCK_BYTES)], ["doc_id", "text", "sha", "block"])

    place = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("sha")]
    long = rows.where(F.octet_length("text") >= LENGTH).repartitionByRange(parts, *place).sortWithinPartitions(*place)
    kind = docs.schema[id_col].dataType
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    long.mapInArrow(cut, f"doc_id {kind.simpleString()}, text string, sha string, block long").write.option("compression", "zstd").bucketBy(parts, "block").saveAsTable(name)
    try:
        held = lambda: spark.table(name).groupBy("block")
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
        own = spark.table(name).select("doc_id", "sha", "block")
        first = own.groupBy("sha").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "block"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"])
        copies = checkpointed(copies.where(~rank.eqNullSafe(F.col("first"))).select("block", "doc_id", "sha").distinct())
        told = copies.select("block", F.lit(0).cast("int").alias("kind"), F.pmod(F.xxhash64("doc_id", "sha"), F.lit(1 << 30)).alias("bucket"), F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), "sha").cast("binary").alias("bits"))

        def sample(table: pa.Table, said: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _work([])
            k = table.column("block")[0].as_py()
            own_block = Block(table, said)
            values = distinct(own_block.images(own_block.sample(), NAMED))
            return _work([(b, k, values[own].astype("<u4").tobytes()) for b, own in by_bucket(values, names)])

        ranked = held().cogroup(told.groupBy("block")).applyInArrow(sample, _WORK_SQL).groupBy("bucket").applyInArrow(rank_sample, _REPLY_SQL)
        told = checkpointed(told.unionAll(ranked))

        def deal(table: pa.Table, said: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _work([])
            k = table.column("block")[0].as_py()
            own_block = Block(table, said)
            tied = own_block.tied(names)
            values = distinct(own_block.images(own_block.candidates(tied), LENGTH))
            return _work([(-1 - k, k, np.packbits(tied).tobytes()), *((b, k, values[own].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()) for b, own in by_bucket(values, suffixes))])

        placed = held().cogroup(told.groupBy("block")).applyInArrow(deal, _WORK_SQL).groupBy("bucket").applyInArrow(sort_bucket, _REPLY_SQL)
        told = checkpointed(told.unionAll(placed))

        def mark(table: pa.Table, said: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table.select(["doc_id", "sha"]).append_column("n_removed", pa.array([], pa.int64())).append_column("n_spans", pa.array([], pa.int64())).append_column("kept_sha256", pa.array([], pa.string()))
            own = Block(table, said)
            place = own.candidates(own.bits(3, 0, len(own.sample())))
            images = own.images(place, LENGTH)
            order, starts, run = same_runs(images)
            earlier = np.zeros(len(starts), bool)
            for b, some in by_bucket(images[order[starts]], suffixes):
                earlier[some] = own.bits(2, b, len(some))
            again = place[order[earlier[run] | (order != np.minimum.reduceat(order, starts)[run])]] if len(order) else place
            cover = np.bincount(again, minlength=len(own.data) + 1).astype(np.int32)
            cover -= np.bincount(again + LENGTH, minlength=len(own.data) + 1).astype(np.int32)
            gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            heads_ = own.offsets[:-1]
            opens[heads_] = gone[heads_]
            per = lambda flags: np.add.reduceat(flags, heads_, dtype=np.int64) if len(heads_) else np.zeros(0, np.int64)
            removed, spans = per(gone), per(opens)
            kept, ends = own.data[~gone], np.cumsum(np.diff(own.offsets) - removed)
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
            return own.table.select(["doc_id", "sha"]).append_column("n_removed", pa.array(removed)).append_column("n_spans", pa.array(spans)).append_column("kept_sha256", pa.array(sha, pa.string()))

        found = checkpointed(held().cogroup(told.groupBy("block")).applyInArrow(mark, f"doc_id {kind.simpleString()}, sha string, n_removed long, n_spans long, kept_sha256 string"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    found = found.select(F.col("doc_id").alias("id"), F.col("sha").alias("own"), "n_removed", "n_spans", "kept_sha256")
    out = heads.join(found, (heads.sha == found.own) & heads.doc_id.eqNullSafe(found.id), "left")
    whole = F.col("own").isNull() & (F.col("n_bytes") >= LENGTH)  # a copy of an earlier document
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
