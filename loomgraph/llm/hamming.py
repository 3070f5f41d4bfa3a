"""All pairs of 64-bit fingerprints within a Hamming radius, by tiled exact comparison.

Distinct fingerprints are dealt to tiles by bands of their population count (and a hash within one band).
A tile pair is compared only if the counts may differ by at most the radius, since each differing bit
moves the count by one at most. Where links also need a similarity of the sets behind the fingerprints
(the cosine, which SimHash estimates too), tiles are dealt by set size: at a cosine s the sizes differ by
a factor of 1/s**2 at most.
Tiles have a bounded number of fingerprints; bands that fit in a tile together share it, so that few tiles
travel to few partners. Each tile pair is a task's group of its own, and it returns a spanning forest of its links, so a dense group never expands into all its pairs.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import checkpointed

#: Fingerprints of a tile on average, at most. A pair of tiles is 65,536 squared comparisons (seconds), and
#: shuffled bytes fall as tiles grow.
TILE = 65536
_BLOCK = 1024
_HALF = np.uint64(0xFFFFFFFF)


class Forest:
    """Union-find over 0..n-1 with array operations; links that join nothing new are dropped."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Afterwards both ends of each link have the same root, the least of their group."""
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.arange(len(self.root))
        return own[self.root != own], self.root[self.root != own]


def compare(x: np.ndarray, y: np.ndarray | None, radius: int, sketches: tuple[np.ndarray, ...] | None = None, agree: float = 0, names: tuple[np.ndarray, ...] | None = None, sizes: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``x`` (``y`` None) or between ``x`` and ``y``, by the
    fingerprints or by ``names`` of their holders.

    With ``sketches`` (a row of values for each fingerprint of ``x`` and ``y``) a link also needs the
    share ``agree`` of equal values, or with the ``sizes`` of the sketched sets the cosine ``agree`` that
    follows from that share; pairs that are joined already are not looked at again.
    """
    sides, ranked, named, large = [], [], [], []
    for n, side in enumerate([x] if y is None else [x, y]):
        order = np.lexsort((np.bitwise_count(side >> np.uint64(32)), np.bitwise_count(side & _HALF)))
        named.append((side if names is None else names[n])[order])
        side = side[order]
        if sketches is not None:
            ranked.append(sketches[n][order])
        if sizes is not None:
            large.append(sizes[n][order].astype(float))
        lo, hi = np.bitwise_count(side & _HALF).astype(int), np.bitwise_count(side >> np.uint64(32)).astype(int)
        cut = range(0, len(side), _BLOCK)
        sides.append((side, [(i, min(i + _BLOCK, len(side)), lo[i : i + _BLOCK].min(), lo[i : i + _BLOCK].max(), hi[i : i + _BLOCK].min(), hi[i : i + _BLOCK].max()) for i in cut]))
    (a, blocks), (b, others) = sides[0], sides[-1]
    base = len(a) if y is not None else 0
    forest = Forest(base + len(b))
    for i0, i1, l0, l1, h0, h1 in blocks:
        for j0, j1, m0, m1, g0, g1 in others:
            if y is None and j0 < i0 or max(0, m0 - l1, l0 - m1) + max(0, g0 - h1, h0 - g1) > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(a[i0:i1, None] ^ b[None, j0:j1]) <= radius)
            i, j = i + i0, j + j0 + base
            if sketches is None:
                if len(i):
                    forest.add(i, j)
                continue
            for lo in range(0, len(i), 8192):
                p, q = i[lo : lo + 8192], j[lo : lo + 8192]
                apart = forest.root[p] != forest.root[q]
                p, q = p[apart], q[apart]
                share = (ranked[0][p] == ranked[-1][q - base]).mean(1)
                if sizes is not None:  # a share e of the union means e / (1 + e) of both sizes in common
                    a_, b_ = large[0][p], large[-1][q - base]
                    share = share / (1 + share) * (a_ + b_) / np.sqrt(a_ * b_)
                like = share >= agree
                if like.any():
                    forest.add(p[like], q[like])
    nodes = np.concatenate(named) if base else named[0]
    i, j = forest.links()
    return nodes[i], nodes[j]


def hamming_links(prints: DataFrame, fp: str, radius: int, tile: int = TILE, *, sketch: str | None = None, size: str | None = None, similarity: float = 0, allowed: float = 0, key: str | None = None) -> DataFrame:
    """Rows ``(a, b)`` of fingerprints, such that two of the distinct fingerprints in the long column
    ``fp`` can be reached from one another by them exactly if they can by steps of at most ``radius``
    bits. Null fingerprints link nothing.

    With the binary column ``sketch`` (8-bit values) and the long column ``size`` (of the sets that were
    sketched) a step also needs the cosine ``similarity - allowed`` by the sketches. Sizes fall into buckets
    of the ratio 1 / similarity**2, and pairs further apart than adjoining buckets, whose cosine is lower
    for certain, are left out. With the long column ``key`` the nodes are its values, each with one
    fingerprint and one sketch, and equal fingerprints are linked like any others; without it the least
    sketch of a fingerprint stands.
    """
    spark = prints.sparkSession
    kept = F.min(F.struct(F.col(sketch).alias("sketch"), F.col(size).alias("size"), F.col(fp).alias("fp"))) if sketch else F.min(F.struct(F.lit(b"").alias("sketch"), F.lit(1).alias("size"), F.col(fp).alias("fp")))
    own = prints.where(F.col(fp).isNotNull()).groupBy(F.col(key or fp).alias("key")).agg(kept.alias("kept")).select("key", "kept.*")
    bucket = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / (2 * log(1 / (similarity - allowed)))) if sketch else F.lit(0)
    own = checkpointed(own.select("key", "fp", "sketch", "size", bucket.cast("int").alias("bucket"), F.floor(F.bit_count("fp") / (radius + 1)).cast("int").alias("band")))
    # 65 bands at most, and as many buckets as the logarithm of the longest text
    held = sorted((r.bucket, r.band, r.n) for r in own.groupBy("bucket", "band").agg(F.count("*").alias("n")).collect())
    runs: list[list] = []  # bucket, first and last band, count: bands side by side that fit in a tile together
    for b, c, n in held:
        if runs and runs[-1][0] == b and runs[-1][3] + n <= tile:
            runs[-1][2:] = [c, runs[-1][3] + n]
        else:
            runs.append([b, c, c, n])
    tiles = np.cumsum([0] + [-(-n // tile) for *_, n in runs]).tolist()
    near = [[(tiles[j], tiles[j + 1]) for j, (b2, lo2, hi2, _) in enumerate(runs) if abs(b - b2) <= 1 and lo2 <= hi + 1 and hi2 >= lo - 1] for b, lo, hi, _ in runs]
    cells = [(b, c, tiles[i], tiles[i + 1] - tiles[i], near[i]) for b, c, _ in held for i in [next(i for i, r in enumerate(runs) if r[0] == b and r[1] <= c <= r[2])]]
    cells = spark.createDataFrame(cells, "bucket int, band int, first long, parts long, near array<struct<lo: long, hi: long>>")
    dealt = own.join(F.broadcast(cells), ["bucket", "band"]).withColumn("t", F.col("first") + F.pmod(F.xxhash64("key"), "parts"))
    packed = dealt.groupBy("t").agg(F.collect_list("fp").alias("fps"), F.collect_list("sketch").alias("sketches"), F.collect_list("key").alias("keys"), F.collect_list("size").alias("sizes"), F.first("near").alias("near"))
    sides = ["fps", *(["sketches", "sizes"] if sketch else []), *(["keys"] if key else [])]
    pairs = packed.select("t", *sides, F.explode("near").alias("near")).select("t", *sides, F.explode(F.sequence("near.lo", F.col("near.hi") - 1)).alias("other"))
    pairs = pairs.select(F.least("t", "other").alias("p"), F.greatest("t", "other").alias("q"), "t", *sides)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        sides = [np.asarray(v, np.int64).view(np.uint64) for v in pdf.fps]
        values = tuple(np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in pdf.sketches) if sketch else None
        if len(sides) == 1 and pdf.p.iloc[0] != pdf.q.iloc[0]:  # no fingerprint was dealt to that tile
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        names = tuple(np.asarray(v, np.int64) for v in pdf["keys"]) if key else None
        sizes = tuple(np.asarray(v, np.int64) for v in pdf.sizes) if sketch else None
        a, b = compare(sides[0], sides[1] if len(sides) > 1 else None, radius, values, similarity - allowed, names, sizes)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("p", "q").applyInPandas(links, "a long, b long")
