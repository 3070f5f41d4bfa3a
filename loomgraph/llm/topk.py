"""Exact top-k inner-product search by no-random-access (NRA) aggregation over sorted lists.

Each dimension of a block of candidates is a list sorted by its values; a query reads it from the
top where its weight is positive and from the bottom where it is negative. All lists are read to the
same depth, then deeper. What has been read gives every candidate a lower bound (unread components
at the list's worst value) and an upper bound (unread components at the last value read). A block is
left as soon as few candidates can still reach the query's k-th best lower bound; their final scores
are then resolved in integers. The k-th best score is carried on from block to block.

Queries are packed into blocks and meet candidate blocks by an equi-join on (query block, candidate
group), so nothing is broadcast and no task holds more than its group; the bounds of all queries of a
block come from a few matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
BLOCK = 2048
GROUP = 4  # candidate blocks that one query block meets in a row
DEPTHS = (0.25, 0.5, 1.0)
FEW = 0.03  # share of candidates whose scores are resolved rather than read further
_PACKED = "part int, ids binary, dims int, vectors binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows with an id and a vector of finite components."""
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _pack(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of floor(scale * x), shorter vectors filled up with zeros."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                some = batch.slice(lo, size)
                lists = some.column(1)
                lens = np.diff(lists.offsets.to_numpy())
                flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                if np.abs(flat).max(initial=0) >= 2.0**62:
                    raise ValueError("components are too large for integer scores")
                x = np.zeros((some.num_rows, int(lens.max(initial=0))), np.int64)
                x[np.arange(x.shape[1]) < lens[:, None]] = flat.astype(np.int64)
                width = "<i4" if np.abs(flat).max(initial=0) < 2**31 else "<i8"
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.column(0).to_numpy().astype("<i8").tobytes()]), pa.array([x.shape[1]], pa.int32()), pa.array([x.astype(width).tobytes()])], ["part", "ids", "dims", "vectors"])

    return rows.mapInArrow(run, _PACKED)


def _unpack(ids: bytes, dims: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    width = len(vectors) // max(1, len(ids) * dims)
    return ids, np.frombuffer(vectors, f"<i{width or 4}").reshape(len(ids), dims).astype(np.int64)


class Search:
    """The best ``k`` of a block of queries so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, score, vec_id
        self.least = np.full(len(ids), -np.inf)  # k-th best score
        self.read = 0  # list entries read, for tests and tuning

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        d = max(self.q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (self.q, x))
        n = len(ids)
        if not n or not len(q):
            return
        if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d >= 2.0**62:
            raise ValueError("components are too large for integer scores")
        up, down, xf = np.maximum(q, 0).astype(float), np.maximum(-q, 0).astype(float), x.astype(float)
        order = np.argsort(x, axis=0, kind="stable")
        low, high = xf.min(0, initial=np.inf), xf.max(0, initial=-np.inf)
        own = self.ids[:, None] == ids[None, :]
        slack = 1e-12 * np.abs(q).sum(1, keepdims=True) * max(1.0, np.abs(xf).max(initial=0))  # floats may round
        for depth in DEPTHS:
            t = max(1, math.ceil(depth * n))
            self.read += 2 * t * d
            top, bottom = order[n - t :], order[:t]
            read_top, read_bottom = np.take_along_axis(xf, top, 0), np.take_along_axis(xf, bottom, 0)

            def total(last_top, last_bottom, top=top, bottom=bottom, read_top=read_top, read_bottom=read_bottom):
                a, b = np.zeros((n, d)), np.zeros((n, d))
                np.put_along_axis(a, top, read_top - last_top, 0)
                np.put_along_axis(b, bottom, last_bottom - read_bottom, 0)
                return up @ (a.T + last_top[:, None]) + down @ (b.T - last_bottom[:, None])

            upper = total(read_top[0], read_bottom[-1])  # unread components at the last value read
            lower = upper if t == n else total(low, high)  # unread components at the list's worst value
            lower = np.where(own, -np.inf, lower) - slack
            if n >= self.k:
                self.least = np.maximum(self.least, np.partition(lower, n - self.k, axis=1)[:, n - self.k])
            open_ = (upper + slack >= self.least[:, None]) & ~own
            if t == n or open_.mean() <= FEW:
                break
        for lo in range(0, len(q), 64):
            i, j = np.nonzero(open_[lo : lo + 64])
            for at in range(0, len(i), 1 << 16):
                ii, jj = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
                self._keep(ii, np.einsum("ij,ij->i", q[ii], x[jj]), ids[jj])

    def _keep(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        query, score, vec = (np.concatenate(z) for z in zip(self.found, (query, score, vec), strict=True))
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        self.found = tuple(z[rank < self.k] for z in (query, score, vec))
        last = (rank == self.k - 1).nonzero()[0]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10, scale: float = 1024, query_every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``query_every`` the
    ``k`` highest integer inner products with the other rows, ties to the smaller id.

    Components become floor(scale * x). Rows without an id, and vectors that are null or hold null or
    non-finite components, take no part; components so large that a score could leave the range of long are an error; empty and shorter vectors count as filled up with zeros.
    Rows that share the query's id are its own; of rows that repeat another id each is a candidate, and
    of rows that repeat the query's id each is asked, as in the SQL. Fewer than ``k`` candidates give fewer rows; no queries give none.
    """
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(F.col("vec_id") % query_every == 0)
    n, queries = rows.agg(F.count("*"), F.sum((F.col("vec_id") % query_every == 0).cast("long"))).first()
    parts = max(1, math.ceil((queries or 0) / QUERY_BLOCK))
    groups = max(1, math.ceil(n / (BLOCK * GROUP)))
    q = _pack(asked.repartition(parts), scale, QUERY_BLOCK).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = _pack(rows, scale, BLOCK).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        for ids, dims, vectors in zip(*(left.column(x).to_pylist() for x in ("ids", "dims", "vectors")), strict=True):
            s = Search(*_unpack(ids, dims, vectors), k)
            for block in zip(*(right.column(x) for x in ("ids", "dims", "vectors")), strict=True):
                s.block(*_unpack(*(x.as_py() for x in block)))
            query, score, vec = s.found
            got.append(pa.table([s.ids[query], vec, score], schema=out))
        return pa.concat_tables(got) if got else out.empty_table()

    found = q.groupBy("part", "g").cogroup(c.groupBy("part", "g")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
