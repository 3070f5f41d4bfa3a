"""Toxicity by non-negative positive-unlabelled learning (nnPU; Kiryo et al., 2017).

Only confirmed toxic examples are used as labels; everything else is unlabelled text drawn from the
whole corpus, toxic documents included. The classifier is linear in the presence of words and word
beginnings; its risk is corrected by the class prior and kept non-negative:

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

Learning sees bounded samples (``POSITIVES`` and ``UNLABELLED`` documents, the first by a hash of
their ids); scoring reads every whole text in Arrow batches with a model of at most ``FEATURES``
weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textkit import LOWER, Spans, fresh, released, slices, utf8, word_spans
from loomgraph.session import checkpointed

#: Bounds of what the model is fitted on.
POSITIVES, UNLABELLED = 4000, 12000
#: Features considered (by how many positives have them), and kept (by how far they tell).
CONSIDERED, FEATURES = 20_000, 512
#: A feature is kept only if positives have it more often by that many standard errors.
TELLING = 2.5
#: Lengths in bytes of the word beginnings that are features beside the words.
BEGINNINGS = (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit features: letters-only lower-case words and their beginnings; repeats included."""
    starts, ends, first = word_spans(data, offsets)
    kept = _LETTER[data]
    at = np.concatenate([[0], np.cumsum(kept)])
    s, e = at[starts], at[ends]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    s, e, row = s[e > s], e[e > s], row[e > s]
    spans = Spans(LOWER[data[kept]])
    found, rows = [spans.hash(s, e)], [row]
    for n in BEGINNINGS:
        longer = e - s > n
        found.append(spans.hash(s[longer], s[longer] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        rows.append(row[longer])
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of the features present)."""

    keys: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.keys):
            row, h = features(data, offsets)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pairs = np.unique(row[hit] * len(self.keys) + at[hit])
            np.add.at(total, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def nnpu_risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The part of the risk from unlabelled text (before it is kept non-negative), and the gradients of
    both parts. ``w`` ends with the bias; the matrices (any float type) are used as they are."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    margin = lambda m: (m @ w[:-1].astype(m.dtype)).astype(np.float64) + w[-1]
    pull = lambda s, m: np.append((s.astype(m.dtype) @ m).astype(np.float64), s.sum()) / len(m)
    fp, fu = margin(positive), margin(unlabelled)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return negative, -prior * pull(sigmoid(-fp), positive), pull(sigmoid(fu), unlabelled) - prior * pull(sigmoid(fp), positive)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model that minimises the non-negative PU risk under logistic loss."""
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        negative, towards, slope = nnpu_risk(w, positive, unlabelled, prior)
        g = towards + slope if negative >= 0 else -slope
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, positives: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 42) -> Model:
    """The model from ``positives`` (rows ``doc_id``) and ``docs`` as unlabelled text; both bounded
    samples as stated above. Without positives, or with prior 0, every score is the prior.
    """
    if not prior:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(1e-6)))
    first = lambda rows, n: rows.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "doc_id").limit(n)
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"))
    chosen = first(positives.distinct(), POSITIVES).withColumn("p", F.lit(1)).unionByName(first(ids.distinct(), UNLABELLED).withColumn("p", F.lit(0)))
    chosen = checkpointed(chosen.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u")))
    # at most POSITIVES + UNLABELLED ids, a few hundred kB whatever the input: small enough to broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text", F.lit(seed)))
    # a repeated row counts once; an id may have many texts, so each class is bounded by itself again, and neither crowds out the other
    texts = checkpointed(texts.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.max("p").alias("p"), F.min("u").alias("u")))
    least = lambda which, n: texts.where(which).select("doc_id", "h").orderBy("h", "doc_id").limit(n)
    kept = least("p = 1", POSITIVES).withColumn("as", F.lit(1)).unionByName(least("u = 0", UNLABELLED).withColumn("as", F.lit(0)))
    kept = checkpointed(kept.groupBy("doc_id", "h").agg(F.max("as").alias("p"), F.min("as").alias("u")))
    texts = checkpointed(texts.select("doc_id", "h", "text").join(F.broadcast(kept), ["doc_id", "h"]).select("text", "p", "u"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                row, h = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                keys, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = texts.where("p = 1").select("text").mapInArrow(released(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2")
    considered = np.sort(counts.orderBy(F.desc("n"), "h").limit(CONSIDERED).toArrow().column("h").to_numpy().view(np.uint64))
    if not len(considered):
        return Model(considered, np.zeros(0), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            got: list[bytes] = []
            for lo, hi in slices(offsets):
                row, h = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.minimum(np.searchsorted(considered, h), len(considered) - 1)
                hit = considered[at] == h
                pairs = np.unique(row[hit] * len(considered) + at[hit])
                cut = np.searchsorted(pairs // len(considered), np.arange(hi - lo + 1))
                own = (pairs % len(considered)).astype("<u2")
                got += [own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column(1), batch.column(2)], ["f", "p", "u"])

    rows = texts.mapInArrow(released(present), "f binary, p int, u int").toArrow().sort_by([("f", "ascending"), ("p", "ascending"), ("u", "ascending")])
    lists = [np.frombuffer(x.as_py(), "<u2") for x in rows.column("f")]
    is_p, is_u = rows.column("p").to_numpy() == 1, rows.column("u").to_numpy() == 0
    share = lambda which: np.bincount(np.concatenate([np.zeros(0, np.uint16), *[x for x, w in zip(lists, which, strict=True) if w]]), minlength=len(considered)) / max(1, which.sum())
    a, b = share(is_p), share(is_u)
    tells = (a - b) / np.sqrt(np.maximum(a, b) * (1 - np.minimum(a, b)) / max(1, is_p.sum()) + 1e-9)
    chosen_at = np.argsort(-tells, kind="stable")[:FEATURES]
    chosen_at = np.sort(chosen_at[tells[chosen_at] >= TELLING])
    column = np.full(len(considered), -1)
    column[chosen_at] = np.arange(len(chosen_at))

    def matrix(which: np.ndarray) -> np.ndarray:
        out = np.zeros((int(which.sum()), len(chosen_at)), np.float32)
        for i, x in enumerate(x for x, w in zip(lists, which, strict=True) if w):
            c = column[x]
            out[i, c[c >= 0]] = 1
        return out

    weights, bias = fit_nnpu(matrix(is_p), matrix(is_u), prior)
    return Model(considered[chosen_at], weights, bias)


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_labels(labels: DataFrame, id_col: str = "doc_id", toxic_col: str = "toxic") -> tuple[DataFrame, float]:
    """The confirmed toxic ids outside the held-out part, and the class prior: their share among the
    labelled there (the only use of rows labelled clean)."""
    rows = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.col(toxic_col).alias("toxic"))
    prior = rows.where("toxic IS NOT NULL").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return rows.where("toxic = 1").select("doc_id"), float(prior or 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, name: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id) of every row and its score."""
    keep = keep or [id_col]
    text = fresh(keep, "text")
    inner = docs.select(F.col(f"`{text_col}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            got = [model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(got) if got else np.zeros(0))], [*keep, name])

    from pyspark.sql.types import DoubleType, StructType

    return inner.mapInArrow(released(run), StructType(inner.schema.fields[1:]).add(name, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Null and empty texts have no features and score the model's bias. Rows without an id are scored
    like others and count as not held out. Labels that are null, or of documents not in ``docs``,
    teach nothing; without any confirmed toxic example every score is near 0. Other columns are
    never read; an empty table gives no rows.
    """
    positives, prior = learning_labels(labels)
    learnable = docs.where(~held_out(F.col(id_col)))
    model = learn(learnable, positives, prior, id_col, text_col)
    scored = score(docs, model, id_col, text_col, name="score")
    return scored.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    positives, prior = learning_labels(labels)
    model = learn(docs.where(~held_out(F.col(id_col))), positives, prior, id_col, text_col)
    name = fresh(docs.columns, "score")
    return score(docs, model, id_col, text_col, name=name, keep=docs.columns).where(F.col(name) < threshold).drop(name)
