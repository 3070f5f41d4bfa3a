"""SimHash near-duplicates of documents.

Fingerprints are made in Arrow batches from whole texts: lower-cased ASCII letters, words split at
ASCII white space, shingles of ``shingle`` words hashed with XXH64. Documents never shuffle with
their texts. Equal fingerprints are one class; classes are linked by tiled exact comparison and
joined into components.

A few bits tell copies with hardly a change. SimHash estimates the cosine of the texts' sets of shingles,
so for a similarity that is the measure: the number of shingles in common over the geometric mean of the
texts' numbers of different ones. The radius is then wide, and each link is confirmed by ``SKETCH``
min-hashes that travel with the fingerprint and give a closer estimate of the same cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.hamming import hamming_links
from loomgraph.llm.textkit import LOWER, Spans, fresh, mixed, released, slices, utf8, word_spans
from loomgraph.operators.components import connected_components
from loomgraph.session import checkpointed


def fingerprint(text: str | None, shingle: int, seed: int, distinct: bool = False) -> int:
    """The signed 64-bit SimHash of one text; 0 for a text without words. Repeated shingles count each
    time, or once if ``distinct``."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter([of(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])] if len(words) >= shingle else [of(joined, seed)], "<u8")  # noqa: B905
    if distinct:
        hashes = np.unique(hashes)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Min-hashes of a sketch, and the bits by which fingerprints of texts at a cosine of 0.8 differ at most (99 in 100).
SKETCH, WIDE = 128, 19
#: One standard error of a sketch's estimate at 0.8.
ALLOWED = 0.03
_FACTORS = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the ``SKETCH`` min-hashes of its shingles, 8 bits of each (zeros without words), how
    many different shingles it has, and a digest of their set."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    windows = Spans(Spans(data).hash(starts, ends))
    out, sizes, keys = np.zeros((len(offsets) - 1, SKETCH), np.uint8), np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for row, (a, b) in enumerate(pairwise(first.tolist())):
        if b > a:
            i = np.arange(a, max(a + 1, b - shingle + 1))
            h, least = np.unique(windows.hash(i, np.minimum(i + shingle, b))), np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
            sizes[row] = len(h)
            keys[row] = xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)
            for lo in range(0, len(h), 2048):
                np.minimum(least, (h[lo : lo + 2048, None] * _FACTORS).min(0), out=least)
            out[row] = mixed(least) >> np.uint64(56)
    return out, sizes, keys


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, seed: int = 42, sketched: bool = False) -> DataFrame:
    """``(doc_id, row, fp)``, and ``sketch``, ``size`` and ``key`` (a digest of the set of shingles) if asked for, of
    every row; null texts and texts without words have fingerprint 0. ``row`` is a digest of id and text. A
    fingerprint with a sketch is of the different shingles, as the sketch is."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, int] = {}
            out = []
            for text in batch.column(2).to_pylist():
                if text not in seen:
                    seen[text] = fingerprint(text, shingle, seed, sketched)
                out.append(seen[text])
            columns, names = [batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "row", "fp"]
            if sketched:
                data, offsets = utf8(batch.column(2))
                parts = [sketches(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle) for lo, hi in slices(offsets)]
                rows, sizes, keys = [r.tobytes() for x, _, _ in parts for r in x], [n for _, x, _ in parts for n in x.tolist()], [k for _, _, x in parts for k in x.tolist()]
                columns, names = [*columns, pa.array(rows, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], [*names, "sketch", "size", "key"]
            yield pa.RecordBatch.from_arrays(columns, names)

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _row_key(id_col, text).alias("row"), text.alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {kind}, row binary, fp long" + ", sketch binary, size long, key long" * sketched)


def _row_key(id_col: str, text: Column) -> Column:
    """16 bytes that tell rows apart by id and text, null ids among them."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))).cast("binary")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, radius: int, similarity: float | None) -> tuple[DataFrame, DataFrame, str]:
    """The rows' fingerprints, and for each class of them its component and the least row in it."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle=shingle, seed=seed, sketched=similarity is not None))
    key = "fp" if similarity is None else "key"
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = prints.groupBy(key).agg(least.alias("least"))
    groups = connected_components(hamming_links(prints, "fp", radius, **({} if similarity is None else {"sketch": "sketch", "size": "size", "similarity": similarity, "allowed": ALLOWED, "key": key})), "a", "b")
    grouped = classes.join(groups.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    return prints, checkpointed(grouped), key


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, seed: int = 42, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: documents whose fingerprints differ by at most
    ``radius`` bits (and which, if ``similarity`` is given, have that cosine of their sets of shingles by
    their sketches, equal fingerprints too) are linked, and ``component_id`` is the least document id
    that links reach. With a similarity only equal sets of shingles are one class from the start.

    Null texts and texts without words share fingerprint 0. Rows with a null id take part and get
    the component of their class (null if no row there has an id). Repeated rows stay repeated.
    Other columns are ignored; an empty table gives no rows.
    """
    prints, grouped, key = _grouped(docs, id_col, text_col, shingle, seed, radius, similarity)
    best = grouped.groupBy("component").agg(F.min("least.doc_id").alias("component_id"))
    named = checkpointed(grouped.join(best, "component").select(key, "component_id"))
    return prints.join(named, key).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, seed: int = 42, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """Of each component of ``near_duplicates`` the row with the least id stays (null ids come last; of
    rows that share that id, the one with the least digest of id and text). Of rows that repeat both
    id and text the one with the least hash of all its columns stays. Rows that share an id but whose
    texts are in different components are judged apart.
    """
    prints, grouped, _ = _grouped(docs, id_col, text_col, shingle, seed, radius, similarity)
    own, row = fresh(docs.columns, "own"), fresh(docs.columns, "row")
    best = checkpointed(grouped.groupBy("component").agg(F.min("least").alias("best")).select(F.col("best.row").alias(row)))
    kept = docs.withColumn(own, _row_key(id_col, F.col(f"`{text_col}`").cast("string"))).join(best, F.col(own) == F.col(row), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = checkpointed(prints.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").join(best.withColumnRenamed(row, "row"), "row", "left_semi").select(F.col("row").alias(row)))
    if several.isEmpty():
        return kept.select(*columns)
    again = kept.join(several, F.col(own) == F.col(row), "left_semi")
    one = again.groupBy(own).agg(F.min_by(F.struct(*columns), F.xxhash64(*[c.cast("string") for c in columns])).alias(row)).select(f"{row}.*")
    return kept.join(several, F.col(own) == F.col(row), "left_anti").select(*columns).unionByName(one)
