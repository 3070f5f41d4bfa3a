"""Token-id output: a concatenated id array with Elias-Fano document boundaries.

File format (a Parquet table, so that Spark commits and finds it in any store), one row a shard:

    shard       long    shards in ascending order hold documents in ascending order
    n_docs      long    documents in the shard
    n_ids       long    ids in the shard
    ids         binary  all ids, little-endian, ``width`` bytes each, documents one after another
    width       int     2 where the vocabulary has at most 65536 ids, else 4
    ends_low    binary  Elias-Fano of the documents' end offsets: the low ``low_bits`` bits of each, packed
    ends_high   binary  their high parts in unary: bit ``(end >> low_bits) + i`` is set for document i
    ends_select binary  32-bit positions of every 256th set bit of ``ends_high``
    low_bits    int     floor(log2(n_ids / n_docs)), at least 0
    id_base     long    the least document id; ids less this base are kept like the ends:
    ids_low, ids_high, ids_select binary, ids_low_bits int
    null_ids    long    documents without an id, which come first

Two bits and the low bits are kept for a document's end and for its id, no 64-bit tables. ``select(i)``
finds the i-th value from the sampled positions and one popcount scan of at most 256 set bits;
``selects`` finds many from one running popcount.
"""

from __future__ import annotations

import functools
import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.textkit import byte_alphabet, released, slices, utf8

SAMPLE = 256
SHARD = "shard long, n_docs long, n_ids long, ids binary, width int, ends_low binary, ends_high binary, ends_select binary, low_bits int, id_base long, ids_low binary, ids_high binary, ids_select binary, ids_low_bits int, null_ids long"
READ = "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"
#: A shard's ids; a document that is longer makes a longer shard.
SHARD_IDS = 1 << 22
#: Texts encoded together, bytes of them whose pieces are told apart together, and pieces in one call of the tokenizer.
TEXTS, RUN, CALL = 4096, 6 << 20, 128
#: Pieces whose ids a worker remembers, which bounds its memory: about 40 bytes each.
CACHE = 1 << 20


# Elias-Fano ---------------------------------------------------------------------------------------


def ef_encode(values: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """Low bits, high bits, select samples and the number of low bits of a non-decreasing sequence."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    low = max(0, int(v[-1] // np.uint64(n)).bit_length() - 1) if n else 0
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes(), low


class EliasFano:
    """Random access to an encoded sequence."""

    def __init__(self, low: bytes, high: bytes, samples: bytes, low_bits: int):
        self.low, self.high, self.low_bits = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), low_bits
        self.samples = np.frombuffer(samples, "<u4")

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[at >> 3] >> (at & 7)) & 1
        return (bit.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """The i-th value."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits still to pass, from the sampled one on
        byte = at >> 3
        head = int(self.high[byte]) >> (at & 7)
        if left >= head.bit_count():
            left -= head.bit_count()
            counts = np.cumsum(np.bitwise_count(self.high[byte + 1 : byte + 1 + SAMPLE * 8]), dtype=np.int64)
            while not len(counts) or counts[-1] <= left:  # long gaps between set bits
                byte, left = byte + len(counts), left - (int(counts[-1]) if len(counts) else 0)
                counts = np.cumsum(np.bitwise_count(self.high[byte + 1 : byte + 1 + (1 << 16)]), dtype=np.int64)
            step = int(np.searchsorted(counts, left, side="right"))
            left -= int(counts[step - 1]) if step else 0
            byte, at = byte + 1 + step, 0
            head = int(self.high[byte])
        else:
            at &= 7
        for _ in range(left):
            head &= head - 1
        place = byte * 8 + at + ((head & -head).bit_length() - 1)
        return ((place - i) << self.low_bits) + int(self._low(np.array([i]))[0])

    def selects(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        seen = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        byte = np.searchsorted(seen, i, side="right")
        left = i - np.where(byte > 0, seen[byte - 1], 0)
        return ((byte * 8 + _IN_BYTE[self.high[byte], left] - i) << self.low_bits) + self._low(i)


#: Where the k-th set bit of a byte is.
_IN_BYTE = np.array([(np.flatnonzero(bits).tolist() + [0] * 8)[:8] for bits in np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")])


# Tokenizing ---------------------------------------------------------------------------------------

_workers: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _workers[path] = (tokenizer, Known(tokenizer))
    return _workers[path]


class Known:
    """The ids of the pieces that a worker has met lately, in Arrow columns, and how a new piece is encoded.

    A piece is what stands between two blanks, with the newline before it; the first of a text begins with a carriage return.
    Of more than ``CACHE`` pieces only those of the last run of texts stay.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.newline = tokenizer, tokenizer.encode("\n", add_special_tokens=False).ids[-1]
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.plain = pa.array([], pa.large_string()), np.zeros(0, bool)
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of different pieces all ids, where each one's begin among them, their numbers, and whether the piece is plain."""
        at = pc.index_in(pieces, value_set=self.pieces)
        if at.null_count:
            new = pieces.filter(at.is_null())
            # no piece holds a blank
            found = self._encoded(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new), pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))
            size = np.array([-1 if x is None else len(x) >> 2 for x in found])
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = len(self.pieces) + np.arange(len(new))
            self.pieces, self.plain = pa.concat_arrays([self.pieces, new]), np.append(self.plain, size >= 0)
            self.ends = np.append(self.ends, np.cumsum(np.maximum(size, 0)) + len(self.ids))
            self.ids = np.append(self.ids, np.frombuffer(b"".join(filter(None, found)), "<u4"))
        at = np.asarray(at).astype(np.int64)
        begin = np.append(0, self.ends)[at]
        ids, size, plain = self.ids, self.ends[at] - begin, self.plain[at]
        if len(self.pieces) > CACHE:
            self._forget()
            self.pieces, self.plain, self.ids, self.ends = pieces, plain, ids[_ranges(begin, size)], np.cumsum(size)
        return ids, begin, size, plain

    def _encoded(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of new pieces, 4 bytes each; None where white space or a special token's mark is in a piece, which
        then depends on what is around it.

        The tokenizer's rules part a word of Latin letters from the stops after it and leave it whole, so of such words the
        library's model is asked straight away, in the byte alphabet that those rules give it.
        """
        tokenize, head = self.tokenizer.model.tokenize, array("I", [self.newline]).tobytes()
        out: list[bytes | None] = [None] * len(pieces)
        words: dict[str, bytes] = {}
        stops: dict[str, bytes] = {"": b""}
        other: list[int] = []
        for i, p in enumerate(pieces):
            first = p[:1]
            bare = p[1:] if first == "\n" or first == "\r" else p
            core = bare.rstrip(string.punctuation)
            if core.isalpha() and (core.isascii() or max(core) < "\u0250") and "<|" not in bare:
                word = byte_alphabet(core) if bare is not p else "\u0120" + byte_alphabet(core)
                ids = words.get(word)
                if ids is None:
                    ids = words[word] = array("I", [t.id for t in tokenize(word)]).tobytes()
                tail = bare[len(core) :]
                if tail not in stops:
                    stops[tail] = array("I", self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
                out[i] = head + ids + stops[tail] if first == "\n" else ids + stops[tail]
            elif "<|" not in bare and bare.split() == [bare]:
                other.append(i)
        for lo in range(0, len(other), CALL):
            some = other[lo : lo + CALL]
            # one call for many pieces, a newline after each; it is a token of its own
            joined = "".join([(p[1:] if p[0] in "\n\r" else " " + p) + "\n" for p in map(pieces.__getitem__, some)])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.newline) * 4
            flat = ids.tobytes()
            for i, a, b in zip(some, [0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True):
                out[i] = head + flat[a:b] if pieces[i][0] == "\n" else flat[a:b]
        return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after another."""
    ends = np.cumsum(size)
    at = np.repeat(begin - ends + size, size)
    at += np.arange(len(at))
    return at


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """The tokenizer's ids of each text.

    The byte-level tokenizer never merges over the border between a word and the single blank or
    newline before it, so a text's ids are its pieces' ids in a row, and a piece seen before need not
    be encoded again. Texts with other white space or with a special token's mark are encoded whole.
    Arrow cuts the texts and tells the pieces apart; each different one is looked up once for a run of texts.
    """
    column = pa.array(texts, pa.large_string())
    out: list[np.ndarray] = []
    for lo, hi in slices(utf8(column)[1], RUN):
        out += _encode_run(column.slice(lo, hi - lo), path)
    return out


def _encode_run(texts: pa.Array, path: str) -> list[np.ndarray]:
    tokenizer, known = _tokenizer(path)
    text = lambda x: pa.scalar(x, pa.large_string())
    cut = pc.split_pattern(pc.binary_join_element_wise(text("\r"), pc.replace_substring(texts, "\n", " \n"), text("")), " ")
    coded, heads = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()[:-1]
    of = coded.indices.to_numpy()
    ids, begin, size, plain = known.look_up(coded.dictionary)
    # a carriage return that isn't the mark of a text's first piece is the text's own
    odd = pc.starts_with(coded.dictionary, "\r").to_numpy(zero_copy_only=False)[of]
    odd[heads] = False
    whole = np.logical_or.reduceat(odd | ~plain[of], heads)
    n = size[of]
    found = np.split(ids[_ranges(begin[of], n)], np.cumsum(n)[heads[1:] - 1])
    for i in np.flatnonzero(whole).tolist():
        found[i] = np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
    return found


# Writing and reading ------------------------------------------------------------------------------


def _shard_row(shard: int, ids: list[np.ndarray], doc_ids: list, width: int) -> dict:
    nulls = sum(d is None for d in doc_ids)
    ends = np.cumsum([len(x) for x in ids])
    low, high, select, bits = ef_encode(ends)
    flat = np.concatenate(ids).astype(f"<u{width}")
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(named[0]) if len(named) else 0
    id_low, id_high, id_select, id_bits = ef_encode(named.view(np.uint64) - np.uint64(base % (1 << 64)))
    return {"shard": shard, "n_docs": len(ids), "n_ids": len(flat), "ids": flat.tobytes(), "width": width, "ends_low": low, "ends_high": high, "ends_select": select, "low_bits": bits, "id_base": base, "ids_low": id_low, "ids_high": id_high, "ids_select": id_select, "ids_low_bits": id_bits, "null_ids": nulls}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 2, partitions: int | None = None) -> None:
    """Encodes every text (null: empty) and writes the format above to ``path``.

    Documents are dealt by ranges of their id and sorted (null ids first), so shards follow one
    another in id order; a shard is closed at ``SHARD_IDS`` ids. There are as many ranges as the session
    has shuffle partitions, unless ``partitions`` says otherwise. Ids must be whole numbers. Repeated ids
    stand side by side in the order of their texts. An empty table writes a table without rows.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"'{id_col}' must hold whole numbers, in whose order the files are written")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    fields = [f.split() for f in SHARD.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check_width(vocabulary, width)
        shard = TaskContext.get().partitionId() << 32  # ranges ascend with the partition's number
        ids, doc_ids, held = [], [], 0
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                texts = some.column(1).to_pylist()
                new = [t for t in dict.fromkeys(texts) if t not in seen]  # copies in a batch are encoded once
                seen.update(zip(new, encode_texts(new, vocabulary), strict=True))
                for doc, x in zip(some.column(0).to_pylist(), map(seen.__getitem__, texts), strict=True):
                    if held and held + len(x) >= SHARD_IDS:
                        yield pa.RecordBatch.from_pylist([_shard_row(shard, ids, doc_ids, width)], schema)
                        shard, ids, doc_ids, held = shard + 1, [], [], 0
                    ids.append(np.append(x, np.uint32(end_id)).astype(np.uint16 if width == 2 else np.uint32))
                    doc_ids.append(doc)
                    held += len(x) + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_shard_row(shard, ids, doc_ids, width)], schema)

    dealt.mapInArrow(released(encode), SHARD).write.mode("overwrite").parquet(path)


@functools.lru_cache(8)
def vocabulary_size(path: str) -> int:
    return _tokenizer(path)[0].get_vocab_size(with_added_tokens=True)


def check_width(path: str, width: int) -> None:
    if vocabulary_size(path) > 1 << (8 * width):
        raise ValueError(f"ids of {vocabulary_size(path)} tokens need more than {width} bytes")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the files at ``path``."""
    shards = spark.read.parquet(path)
    # ids before a shard: those of earlier ranges (a row for each range) and those before it in its own
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("range"))
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n_ids")).select("range", upto(Window.orderBy("range")).alias("first"))
    within = sizes.withColumn("own", upto(Window.partitionBy("range").orderBy("shard")))
    before = within.join(ranges, "range").select("shard", (F.col("first") + F.col("own")).alias("before"))
    columns = [f.split()[0] for f in SHARD.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                n = r["n_docs"]
                ends = EliasFano(r["ends_low"], r["ends_high"], r["ends_select"], r["low_bits"]).selects(np.arange(n))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                named = EliasFano(r["ids_low"], r["ids_high"], r["ids_select"], r["ids_low_bits"]).selects(np.arange(n - r["null_ids"]))
                docs = [None] * r["null_ids"] + (named + r["id_base"]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"])), pa.array(docs, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    read = shards.select(*columns).mapInArrow(released(decode), READ)
    return read.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
