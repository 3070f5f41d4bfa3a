"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a target share of the corpus by weight, at most ``max_repeat`` times its own size,
and an integer number of blocks by the highest quotients ``target / (2k + 1)``. Its blocks are dealt
over bounded shards (a hash of the document id) by the same rule. Within a shard the documents lie
in a seeded order and are cut into blocks; the quota is met by whole passes over the shard and one
seeded run of consecutive blocks, so that all but the run's two edge documents stay whole.

The text is only counted (JVM side). What shuffles is one row of numbers for a document; a hot
source is spread over as many shards as its size asks for. The driver sees one row of totals for
each source, never a document. Sources must be so few that these rows fit (tens of millions).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Shards of a source that are apportioned in one group; more are dealt in two levels.
SHARDS = 4096


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """``seats`` dealt out by highest quotients weight / (2k + 1), ties to the first, none above ``most``.

    All weights zero, or ``most`` reached everywhere, leave seats undealt.
    """
    w, most = np.asarray(weights, float), np.asarray(most, np.int64)
    at = lambda d: np.minimum(np.floor(w / d + 0.5), most).astype(np.int64)  # noqa: E731  seats with quotients of d / 2 at least
    if seats <= 0 or not (w > 0).any():
        return np.zeros(len(w), np.int64)
    lo, hi = 0.0, 2 * w.max() + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid).sum() > seats else (lo, mid)
        if hi - lo <= 1e-12 * hi:
            break
    dealt = at(hi)
    rest = [(-w[i] / (2 * dealt[i] + 1), i) for i in np.flatnonzero((w > 0) & (dealt < most))]
    heapq.heapify(rest)
    for _ in range(int(seats - dealt.sum())):
        if not rest:
            break
        _, i = heapq.heappop(rest)
        dealt[i] += 1
        if dealt[i] < most[i]:
            heapq.heappush(rest, (-w[i] / (2 * dealt[i] + 1), i))
    return dealt


def targets(sizes: np.ndarray, weights: np.ndarray, max_repeat: float) -> np.ndarray:
    """The total shared by weight; a target stops at ``max_repeat`` times its size, the excess is reshared by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, left, open_ = np.zeros(len(sizes)), float(sizes.sum()), np.ones(len(sizes), bool)
    while open_.any() and left > 0:
        share = left * weights / weights[open_].sum()
        over = open_ & (share > max_repeat * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = max_repeat * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, block_words: int = 32, shard_words: int = 1 << 20, seed: int = 42, keep_rows: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, source_size, target, taken`` and how it is
    taken: ``passes`` whole copies, then its words in ``[from1, to1)`` and ``[from2, to2)``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. With ``keep_rows``
    the whole input row comes along as the struct ``row`` (its text then shuffles too); other columns
    of ``docs``, whatever their names, are never read. Null text and text without words have size 0
    and are never taken; null ids and repeated rows are rows like any other, ordered by a hash of id and
    text, then id and size (equal rows are interchangeable); an empty table gives no rows. The same rows and seed give
    the same mix however they are partitioned.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("k"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed)).alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []),
    )
    if not keep_rows:
        rows = checkpointed(rows)  # a few numbers a document: the text is read once
    totals = rows.groupBy("k").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).toPandas()
    totals = totals.iloc[sorted(range(len(totals)), key=lambda i: (totals.k[i] == "n", totals.k[i]))].reset_index(drop=True)
    size = totals.source_size.to_numpy(np.int64)
    target = targets(size, np.resize(np.asarray(weights, float), len(size)) if len(size) else np.zeros(0), max_repeat)
    shards = np.maximum(1, -(-np.maximum(size // shard_words, totals.n.to_numpy(np.int64) // (1 << 14)))).astype(np.int64)
    quota = sainte_lague(target, int(round(target.sum() / block_words)), max_repeat * -(-size // block_words))
    sources = docs.sparkSession.createDataFrame(pa.table({"k": pa.array(totals.k, pa.string()), "source_size": size, "target": target, "shards": shards, "quota": quota}))

    dealt = rows.join(sources, "k").withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    held = dealt.groupBy("k", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))

    def deal(by: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by, ignore_index=True)
            pdf["quota"] = sainte_lague(pdf.words.to_numpy(), int(pdf.quota.iloc[0]), max_repeat * pdf.blocks.to_numpy(np.int64))
            return pdf

        return run

    held = held.withColumn("blocks", F.ceil(F.col("words") / block_words)).withColumn("part", F.floor(F.col("shard") / SHARDS))
    parts = held.groupBy("k", "part").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.first("quota").alias("quota"))
    parts = parts.groupBy("k").applyInPandas(deal("part"), "k string, part long, words long, blocks long, quota long")
    quotas = held.drop("quota").join(parts.select("k", "part", "quota"), ["k", "part"]).groupBy("k", "part").applyInPandas(deal("shard"), "k string, part long, shard long, words long, blocks long, quota long").drop("part")
    order = Window.partitionBy("k", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.drop("quota").withColumn("to", F.sum("size").over(order)).withColumn("start", F.col("to") - F.col("size")).join(quotas, ["k", "shard"])

    c, b = F.col, F.lit(block_words)
    some = c("blocks") > 0
    passes = F.when(some, F.floor(c("quota") / c("blocks"))).otherwise(0).cast("long")
    laid = laid.withColumn("passes", passes).withColumn("run", F.when(some, c("quota") - c("passes") * c("blocks")).otherwise(0).cast("long"))
    laid = laid.withColumn("begin", F.when(some, F.pmod(F.xxhash64("k", "shard", F.lit(seed)), c("blocks"))).otherwise(0))
    end = c("begin") + c("run")
    clip = lambda x, lo: F.greatest(lo, F.least(c("size"), x - c("start")))  # noqa: E731  a word position within the document
    nil = F.lit(0).cast("long")

    def piece(lo: Column, hi: Column, names: tuple[str, str], frame: DataFrame) -> DataFrame:
        frame = frame.withColumn(names[0], clip(lo, nil))
        return frame.withColumn(names[1], F.greatest(c(names[0]), clip(hi, nil)))

    # the run may pass the shard's end; what goes on from its start comes first in the document
    laid = piece(nil, F.least(c("words"), F.greatest(nil, end - c("blocks")) * b), ("from1", "to1"), laid)
    laid = piece(c("begin") * b, F.least(c("words"), F.least(end, c("blocks")) * b), ("from2", "to2"), laid)
    taken = c("passes") * c("size") + c("to1") - c("from1") + c("to2") - c("from2")
    return laid.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "from1", "to1", "from2", "to2", *(["row"] if keep_rows else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each is repeated as often as it is taken whole; of a document at the
    edge of a run the words taken stand alone, with the white space between them. The columns are those of ``docs``;
    ``text`` and, where there is one, ``n_chars`` follow what was taken.
    """
    picks = mix(docs, keep_rows=True, **options)
    space = r"[\x20\x09-\x0D]"
    words = F.filter(F.split("row.text", f"(?<={space})(?!{space})"), lambda w: F.regexp_replace(w, space, "") != "")  # each with what follows it
    part = lambda a, b: F.array_join(F.slice(words, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), "")
    extra = F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    whole = (extra == F.col("size")) & (extra > 0)
    pieces = F.concat(
        F.array_repeat(F.col("row.text"), (F.col("passes") * (F.col("size") > 0).cast("long") + whole.cast("long")).cast("int")),
        F.when((extra > 0) & ~whole, F.array(F.regexp_replace(F.concat_ws("", part("from1", "to1"), part("from2", "to2")), f"{space}+$", ""))).otherwise(F.array().cast("array<string>")),
    )
    out = picks.select("row", F.explode(pieces).alias("piece"))
    kept = [F.col("piece").alias(c) if c == "text" else F.length("piece").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*kept)
