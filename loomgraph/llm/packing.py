"""Sequence packing by lexical retrieval: a sharded BM25 index gives each seed document its neighbours.

Texts are tokenized once, where they are read; ids and the number of documents that hold each token
(a table of the vocabulary's size) are written to the shared folder. Documents are then dealt to
shards by a hash. A shard keeps an inverted index of its documents: the seed's tokens are looked up,
BM25 over corpus-wide document frequencies ranks the documents not used yet, and the best fill the seed's
window; what the last one has too much begins the next window and is its seed. So windows are full,
and only a shard's last one is cut to powers of two. A document of a window or more fills windows of
its own, and its rest is packed with others.
"""

from __future__ import annotations

import functools
import math
import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textkit import byte_alphabet, fresh
from loomgraph.session import parallelism, shared_path

WINDOW = 4096
#: Tokens of an index, and of a task, which makes one index after another; a longer document makes them longer.
SHARD, TASK = 1 << 19, 1 << 24
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75
#: Texts in an output batch, pieces in each of the two generations that a worker remembers.
TEXTS, CACHE = 1024, 400_000


# Tokenizing ---------------------------------------------------------------------------------------


class Words(dict):
    """A tokenizer that drops white space and merges within words only, so that a text's ids are those of what
    stands between its blanks and newlines, one after another; the packed ids of each such piece are remembered.

    Pieces are looked up one by one, and a new one is encoded when it is missed. Of a Latin word, which the
    tokenizer's rules would leave whole, the library's model is asked straight away, in the lower case and the byte
    alphabet that those rules give it; stops after it are a word of their own. All others, and texts that could
    hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width, self.kind = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.before: dict[str, bytes] = {}
        if len(self._ids("a b")) != len(self._ids("a")) + len(self._ids("b")) or any(self._ids(x) != [t.id for t in self.model.tokenize(byte_alphabet(x.lower()))] for x in ("word", "Élève", "straße")):
            raise ValueError("a vocabulary of lower-case words over bytes is needed")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            core = piece.rstrip(string.punctuation)
            if core.isalpha() and (core.isascii() or max(core) < "ɐ" and "İ" not in core):
                lower = core.lower()
                if lower == piece:
                    found = array(self.kind, [t.id for t in self.model.tokenize(byte_alphabet(lower))]).tobytes()
                else:
                    found = self[lower] + self[piece[len(core) :]]
            else:
                found = array(self.kind, self._ids(piece)).tobytes()
        self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text, ``width`` bytes each."""
        if "<|" in text:
            return array(self.kind, self._ids(text)).tobytes()
        if len(self) > CACHE:
            self.before = dict(self)
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(4)
def words(path: str) -> Words:
    return Words(path)


def _encoded(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes a row for each document, ``(id, deal, n, ids)``, and one for each task, ``(terms, n_docs, n_ids)``, with the
    number of its documents that hold each token."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, deal long, n long, ids binary, terms binary, n_docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(vocabulary)
        end = np.array([end_id], w.width).tobytes()
        holding, n_docs, n_ids = np.zeros(max(w.size, end_id + 1), np.int64), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                ids: dict[str, bytes] = {}  # copies in a batch are encoded once
                out, size = [], np.dtype(w.width).itemsize
                for t in some.column(2).to_pylist():
                    if t not in ids:
                        ids[t] = w.encode(t) + end
                    out.append(ids[t])
                    x = np.sort(np.frombuffer(ids[t], w.width))
                    holding[x[:-1][x[1:] != x[:-1]]] += 1
                    holding[x[-1]] += 1
                    n_docs, n_ids = n_docs + 1, n_ids + len(x)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(x) // size for x in out], pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.int64())], ["id", "deal", "n", "ids", "terms", "n_docs"])
        if n_docs:
            have = np.flatnonzero(holding)
            terms = np.stack([have, holding[have]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.int64()), pa.array([n_ids]), pa.nulls(1, pa.binary()), pa.array([terms], pa.binary()), pa.array([n_docs])], ["id", "deal", "n", "ids", "terms", "n_docs"])

    docs.mapInArrow(run, schema).write.parquet(path)


def _frequencies(counted: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many documents hold each token, documents and ids in all; the table is as long as the vocabulary."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                term, n = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "n"])

    n_docs, n_ids = counted.agg(F.sum("n_docs"), F.sum("n")).first()
    rows = counted.select("terms").mapInArrow(unpack, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 + max((r.term for r in rows), default=0), np.int64)
    for r in rows:
        df[r.term] = r.n
    return df, n_docs or 0, n_ids or 0


# Packing ------------------------------------------------------------------------------------------


class Index:
    """An inverted index of documents' ids, and which of them are still unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n, self.idf, self.mean = len(ids), idf, max(mean, 1.0)
        self.lens = np.array([len(x) for x in ids], float)
        doc = np.repeat(np.arange(self.n), self.lens.astype(np.int64))
        pair, tf = np.unique(np.concatenate(ids).astype(np.int64) * self.n + doc if self.n else np.zeros(0, np.int64), return_counts=True)
        term, self.doc = np.divmod(pair, max(self.n, 1))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lens[self.doc] / self.mean))
        keep = self.weight > 0  # a token of over half the documents tells nothing
        term, self.doc, self.weight = term[keep], self.doc[keep], self.weight[keep]
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        order = np.argsort(self.doc, kind="stable")
        self.terms, self.of = term[order], np.searchsorted(self.doc[order], np.arange(self.n + 1))
        self.unused = np.ones(self.n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused documents by falling BM25 score for the seed's tokens, those without a common token last."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        lo, many = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        left = np.flatnonzero(self.unused)
        return left[np.argsort(-score[left], kind="stable")]


def pack_shard(ids: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that hold every id of the documents once.

    All sequences are ``window`` long but the last ones, whose lengths are powers of two.
    """
    out = [[(d, s * window, window)] for d, x in enumerate(ids) for s in range(len(x) // window)]
    rest = [(d, len(x) - len(x) % window, len(x) % window) for d, x in enumerate(ids) if len(x) % window]
    idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0.0)
    index = Index([ids[d][s:] for d, s, _ in rest], idf, mean)
    following, over = 0, None  # the first that may be unused; what a document had too much for the last window
    while True:
        if over is None:
            while following < len(rest) and not index.unused[following]:
                following += 1
            if following == len(rest):
                return out
            index.unused[following] = False
            over = (following, *rest[following][1:])
        seed, start, length = over
        pieces, room, over = [(rest[seed][0], start, length)], window - length, None
        for near in index.neighbours(seed).tolist() if room else ():
            d, s, m = rest[near]
            index.unused[near] = False
            pieces.append((d, s, min(m, room)))
            over = (near, s + room, m - room) if m > room else None
            room -= min(m, room)
            if not room:
                break
        out += [pieces] if not room else _powers(pieces, window - room)


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of an unfilled window, cut to sequences whose lengths are powers of two, which need no padding."""
    out, left = [], list(reversed(pieces))
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        own = []
        while size:
            d, s, m = left.pop()
            own.append((d, s, min(m, size)))
            if m > size:
                left.append((d, s + size, m - size))
            size -= min(m, size)
        out.append(own)
    return out


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """Packs the texts' ids, each text's followed by ``end_id``, into sequences of at most ``window`` ids.

    ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, a row a piece: ``length`` ids (little-endian, 32
    bits each, in ``ids``) from the document's ``start``-th on stand in the sequence from ``offset`` on. Every id stands
    in one piece. A null text is empty, so its document is ``end_id`` alone; documents that repeat an id, or
    an id and a text, are packed each for itself; ids may be null. An empty table gives no rows. Documents are dealt
    by a hash of id and text; rows alike in both meet in one task, which takes them in bounded shards. The same
    table gives the same sequences again as long as the number of partitions is the same.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = shared_path(spark, "packing")
    _encoded(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("deal"), text.alias("text")), path, vocabulary, end_id)
    written = spark.read.parquet(path)
    df, n_docs, n_ids = _frequencies(written.where("terms IS NOT NULL").select("terms", "n", "n_docs"))
    mean = n_ids / max(n_docs, 1)
    name = fresh(["start", "length", "ids", "doc_tokens", "sequence_id", "offset"], id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = words(vocabulary)
        all_df = np.zeros(max(w.size, end_id + 1), np.int64)
        all_df[: len(df)] = df
        sequence = TaskContext.get().partitionId() << 36
        ids, names, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in pack_shard(ids, all_df, n_docs, mean, window):
                at = 0
                for d, s, m in pieces:
                    rows.append((names[d], s, m, ids[d][s : s + m].astype("<u4").tobytes(), len(ids[d]), sequence, at))
                    at += m
                sequence += 1
            columns = list(zip(*rows, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for lo in range(0, len(rows), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 2048], t) for c, t in zip(columns, types, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(np.frombuffer(x, w.width))
                names.append(doc)
                held += len(ids[-1])
                if held >= SHARD:
                    yield from out()
                    ids, names, held = [], [], 0
        if ids:
            yield from out()

    parts = max(parallelism(spark), math.ceil(n_ids / TASK)) if n_ids else 1
    dealt = written.where("ids IS NOT NULL").select("id", "ids", "deal").repartition(parts, "deal").sortWithinPartitions("deal", "id", "ids").select("id", "ids")
    return dealt.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", name)
