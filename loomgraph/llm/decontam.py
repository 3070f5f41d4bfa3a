"""Benchmark decontamination by template canonicalisation.

Words lose case and punctuation. A text is read in four ways: plain (all words as they are), with
numbers and units as typed placeholders, with names within sentences as placeholders too, and with
capitalised words at the start of sentences too; a run of number words or of name words is one
placeholder, so ``Mary Ann`` may stand for ``Tom``. Windows of ``window`` words of
the benchmark and of the documents meet in a hash join. An item is in a document

* exactly, if ``threshold`` of its plain windows are (whatever the case and punctuation), or
* with other parameters, if ``threshold`` of its placeholder windows are, along one stretch of the
  document, and the values in them answer to one another one to one; windows whose values don't fit
  the others' don't count.

A capital at a sentence's start says little, so both readings of it count; plain windows find a copy
in other case.

Documents are read once, in Arrow batches; only windows that may be in the benchmark (a bitmap of
fixed size) leave the scan, and the join itself is exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bloom import bitmap, maybe
from loomgraph.llm.textkit import LOWER, Spans, fresh, mixed, released, slices, utf8, word_spans

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit mph kmh kph watt watts volt volts".split()

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in '.!?:;"']] = True
#: What a word is, and the ways of reading a text.
LITERAL, NUMBER, NAME, UNIT = range(4)
PLAIN, NUMBERS, NAMES, CAPITALS = range(4)
_SLOTS = mixed(np.array([0, 1, 2, 3], np.uint64))
#: Items of fewer words say too little to be looked for inside documents; they are found as whole texts.
LEAST_WORDS = 3


def _hashes_of(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(words))
    return np.sort(Spans(data).hash(offsets[:-1], offsets[1:]))


_known: dict[str, np.ndarray] = {}


def _among(hashes: np.ndarray, kind: str, words: list[str]) -> np.ndarray:
    if kind not in _known:
        _known[kind] = _hashes_of(words)
    table = _known[kind]
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


class Templates:
    """The words of a run of texts and what they are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets)
        kept = _KEEP[data]
        at = np.concatenate([[0], np.cumsum(kept)])
        clean = data[kept]
        some = at[ends] > at[starts]
        head = np.zeros(len(starts), bool)  # the first word of a text, line or sentence
        head[1:] = _STOP[data[ends[:-1] - 1]]
        head[first[:-1][first[:-1] < first[1:]]] = True
        line = np.concatenate([[0], np.cumsum(data == 10)])
        head[1:] |= line[starts[1:]] > line[starts[:-1]]
        self.first = np.concatenate([[0], np.cumsum(some)])[first]
        self.starts, self.ends, head = at[starts][some], at[ends][some], head[some]
        self.text = LOWER[clean]
        self.hashes = Spans(self.text).hash(self.starts, self.ends)
        caps = np.concatenate([[0], np.cumsum(_UPPER[clean])])
        size = self.ends - self.starts
        spelled = _among(self.hashes, "numbers", NUMBER_WORDS)
        number = spelled | (_DIGIT[clean[self.starts]] if len(self.starts) else spelled)
        after = np.zeros(len(size), bool)
        after[1:] = number[:-1]
        unit = ~number & _among(self.hashes, "units", UNITS) & ((size > 3) | after)  # "in" is one only after a number
        name = ~number & ~unit & (caps[self.ends] - caps[self.starts] == 1) & (size > 1)
        if len(size):
            name &= _UPPER[clean[self.starts]]
        self.head = head & name
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL)))
        self._goes_on = np.zeros(len(size), bool)  # a word that belongs to the run before it
        self._goes_on[1:] = ~head[1:] & ((spelled[1:] & spelled[:-1]) | (name[1:] & name[:-1]))

    def read(self, way: int) -> Sequence:
        kind = self.kind
        if way < CAPITALS:
            kind = np.where((kind == NAME) & (self.head if way == NAMES else True) | (way == PLAIN), LITERAL, kind)
        word = np.flatnonzero(~(self._goes_on & (kind != LITERAL)))
        kind = kind[word]
        codes = np.where(kind == LITERAL, self.hashes[word], _SLOTS[kind])
        return Sequence(self, codes, kind, word, np.searchsorted(word, self.first))


class Sequence:
    """One reading of a run of texts: codes of words and placeholders, and where each row's begin."""

    def __init__(self, texts: Templates, codes: np.ndarray, kind: np.ndarray, word: np.ndarray, first: np.ndarray):
        self.texts, self.codes, self.kind, self.word, self.first = texts, codes, kind, word, first
        self.slots = np.concatenate([[0], np.cumsum(kind != LITERAL)])
        self.names = np.concatenate([[0], np.cumsum(kind == NAME)])
        self.heads = np.concatenate([[0], np.cumsum(texts.head[word])])
        self._spans = Spans(codes)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, rows and hashes of the windows of ``size`` places."""
        count = np.maximum(np.diff(self.first) - size + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        i = np.repeat(self.first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return i, row, self._spans.hash(i, i + size)

    def values(self, i: int, size: int) -> list[str]:
        """The words in the window's placeholders, one text for each placeholder."""
        t, out = self.texts, []
        for j in range(i, i + size):
            if self.kind[j] != LITERAL:
                end = self.word[j] + 1
                while end < len(t.starts) and t._goes_on[end] and t.kind[end] == self.kind[j]:
                    end += 1
                out.append(" ".join(t.text[t.starts[k] : t.ends[k]].tobytes().decode("utf-8", "replace") for k in range(self.word[j], end)))
        return out


def _told(t: Templates, sizes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, Sequence]]) -> Iterator[tuple]:
    """``(way, row, size, place, word, hash, values)`` of windows."""
    for way, size, i, row, h, seq in sizes:
        for a, r, x in zip(i.tolist(), row.tolist(), h.view(np.int64).tolist(), strict=True):
            yield way, r, size, a - int(seq.first[r]), int(seq.word[a] - t.first[r]), x, seq.values(a, size) if way else []


_WINDOW = pa.schema([("at", pa.int64()), ("n", pa.int32()), ("way", pa.int32()), ("place", pa.int64()), ("word", pa.int64()), ("total", pa.int64()), ("plain", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.string()))])


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, *, window: int, literals: int) -> DataFrame:
    """``(item_id, item, n, way, place, iword, total, plain, h, islots)``, ``n`` words each: an item's plain windows, and of its
    placeholder windows those with ``literals`` plain words at least (the others are of form only);
    ``total`` counts them by way, ``plain`` the plain ones. An item of fewer words than ``window`` is one plain window."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                t = Templates(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some = []
                for way in (PLAIN, NUMBERS, NAMES, CAPITALS):
                    seq = t.read(way)
                    i, row, h = seq.windows(window)
                    telling = (seq.slots[i + window] - seq.slots[i] <= window - literals) | (way == PLAIN)
                    some.append((way, window, i[telling], row[telling], h[telling], seq))
                    if way == PLAIN:
                        n = np.diff(seq.first)
                        short = np.flatnonzero((n > 0) & (n < window))
                        some += [(way, int(n[r]), seq.first[r : r + 1], np.array([r]), seq._spans.hash(seq.first[r : r + 1], seq.first[r : r + 1] + n[r]), seq) for r in short]
                rows = list(_told(t, some))
                totals = Counter((way, r) for way, r, *_ in rows)
                got = [(r + lo, n, way, place, word, totals[way, r], totals[PLAIN, r], h, values) for way, r, n, place, word, h, values in rows]
                table = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got, strict=True) if got else [[]] * 9, _WINDOW, strict=True)], schema=_WINDOW)
                at = table.column("at").combine_chunks()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(table.column(c).combine_chunks() for c in ("n", "way", "place", "word", "total", "plain", "h", "slots"))], ["item_id", "item", "n", "way", "place", "iword", "total", "plain", "h", "islots"])

    text = F.col(text_col).cast("string")
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("item"), text.alias("text"))
    return rows.mapInArrow(released(run), f"item_id {kind}, item long, n int, way int, place long, iword long, total long, plain long, h long, islots array<string>").distinct()


def document_windows(docs: DataFrame, id_col: str, text_col: str, *, window: int, short: list[int], bits: np.ndarray) -> DataFrame:
    """``(doc_id, row, word, h, slots)`` of the documents' windows that the bitmap lets pass: plain ones,
    those with a placeholder for a number or unit, for a name, and for a capitalised word that begins a sentence. ``row`` is a digest
    of the text. Of the lengths ``short`` there are plain windows too, and texts of fewer words than
    ``LEAST_WORDS`` are windows whole."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                t = Templates(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some = []

                def add(way: int, size: int, i: np.ndarray, row: np.ndarray, h: np.ndarray, seq: Sequence, some=some) -> None:
                    hit = maybe(bits, h)
                    some.append((way, size, i[hit], row[hit], h[hit], seq))

                for way in (PLAIN, NUMBERS, NAMES, CAPITALS):
                    seq = t.read(way)
                    i, row, h = seq.windows(window)
                    if way:  # windows without such a placeholder are told already
                        count = (seq.slots, seq.names, seq.heads)[way - 1]
                        own = count[i + window] > count[i]
                        i, row, h = i[own], row[own], h[own]
                    add(way, window, i, row, h, seq)
                    if way == PLAIN:
                        for size in short:
                            add(way, size, *seq.windows(size), seq)
                        n = np.diff(seq.first)
                        for size in range(1, LEAST_WORDS):
                            row = np.flatnonzero(n == size)
                            add(way, size, seq.first[row], row, seq._spans.hash(seq.first[row], seq.first[row] + size), seq)
                got = [(r + lo, word, h, values) for _, r, _, _, word, h, values in _told(t, some)]
                at, word, h, values = zip(*got, strict=True) if got else ((), (), (), ())
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(word, pa.int64()), pa.array(h, pa.int64()), pa.array(values, pa.list_(pa.string()))], ["doc_id", "row", "word", "h", "slots"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {kind}, row long, word long, h long, slots array<string>")


def bound(hits: list[tuple[int, int, list[str], list[str]]], span: int, fit: float) -> int:
    """How many of an item's places ``(place, shift, item's values, document's values)`` match along one
    stretch of a document with values that answer one to one.

    Shifts within ``span`` of one another are one stretch (each shift is in two, so that no copy is cut
    in half). A place counts by its hit of the shift that most places share. An item's value goes with
    the document's value that most places bear out; places with another value don't count, and if less
    than the share ``fit`` of the pairs of values is left so, the stretch doesn't.
    """
    most = 0
    for off in (0, span // 2):
        stretches: dict[int, list] = defaultdict(list)
        for hit in hits:
            stretches[(hit[1] + off) // span].append(hit)
        for some in stretches.values():
            support = Counter(shift for _, shift in {(place, shift) for place, shift, *_ in some})
            chosen: dict[int, tuple] = {}
            for hit in sorted(some, key=lambda h: (-support[h[1]], h[1])):
                chosen.setdefault(hit[0], hit)
            votes = Counter(pair for *_, a, b in chosen.values() for pair in set(zip(a, b, strict=True)))
            there: dict[str, str] = {}
            back: dict[str, str] = {}
            for a, b in sorted(votes, key=lambda p: (-votes[p], p)):
                if a not in there and b not in back:
                    there[a], back[b] = b, a
            if len(there) >= fit * len(votes):
                most = max(most, sum(all(there.get(x) == y for x, y in zip(a, b, strict=True)) for *_, a, b in chosen.values()))
    return most


def _found(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 5, literals: int = 3, threshold: float = 0.8,
) -> DataFrame:
    """``(doc_id, row, item_id, n_windows, n_matched, n_exact, kind)``, null ids included."""
    items = item_windows(benchmark, item_col, item_text, window=window, literals=literals)
    # lengths below the window's: at most window - LEAST_WORDS numbers
    short = sorted(r.n for r in items.where("way = 0").groupBy("n").count().where(F.col("n").between(LEAST_WORDS, window - 1)).collect())
    found = document_windows(docs, id_col, text_col, window=window, short=short, bits=bitmap(items, "h"))
    hits = found.join(items, "h").where(F.size("slots") == F.size("islots"))
    need = lambda way: F.ceil(F.max(F.when(F.col("way") == way, F.col("total"))) * F.lit(threshold))
    seen = lambda way: F.size(F.collect_set(F.when(F.col("way") == way, F.col("place"))))
    per = hits.groupBy("doc_id", "row", "item_id", "item").agg(
        F.collect_set(F.when(F.col("way") > 0, F.struct("way", "place", (F.col("word") - F.col("iword")).alias("shift"), "islots", "slots"))).alias("hits"),
        F.max("plain").alias("n_windows"), seen(PLAIN).cast("long").alias("n_exact"),
        *[need(way).alias(f"need{way}") for way in range(4)], *[seen(way).cast("long").alias(f"seen{way}") for way in (NUMBERS, NAMES, CAPITALS)],
    )
    exact = F.coalesce(F.col("n_exact") >= F.col("need0"), F.lit(False))
    likely = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"seen{way}") >= F.col(f"need{way}"), F.lit(False)) for way in (NUMBERS, NAMES, CAPITALS)])
    per = per.withColumn("exact", exact).where(F.col("exact") | likely).withColumn("hits", F.when(~F.col("exact"), F.col("hits")))
    kinds = {n: docs.schema[id_col].dataType.simpleString() if n == "doc_id" else benchmark.schema[item_col].dataType.simpleString() for n in ("doc_id", "item_id")}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, matched = [], []
            for i, r in enumerate(batch.select(["hits", "n_exact", "need1", "need2", "need3", "exact"]).to_pylist()):
                best = r["n_exact"] if r["exact"] else 0
                if not r["exact"]:
                    for way, need in ((NUMBERS, r["need1"]), (NAMES, r["need2"]), (CAPITALS, r["need3"])):
                        own = [(h["place"], h["shift"], h["islots"], h["slots"]) for h in r["hits"] if h["way"] == way]
                        n = bound(own, max(1, need or 1), threshold) if own and need else 0
                        if n and n >= need:
                            best = max(best, n)
                if best:
                    keep.append(i)
                    matched.append(best)
            some = batch.take(pa.array(keep, pa.int64()))
            kind = pa.array(["exact" if x else "reparameterised" for x in some.column("exact").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("row"), some.column("item_id"), some.column("n_windows"), pa.array(matched, pa.int64()), some.column("n_exact"), kind], ["doc_id", "row", "item_id", "n_windows", "n_matched", "n_exact", "kind"])

    return per.mapInArrow(released(judge), f"doc_id {kinds['doc_id']}, row long, item_id {kinds['item_id']}, n_windows long, n_matched long, n_exact long, kind string")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, n_exact, kind)`` of every document that holds a
    benchmark item: at least ``threshold`` of the item's windows are in it, plain (``exact``) or, along
    one stretch, with values that answer to the item's one to one (``reparameterised``). ``n_windows``
    and ``n_exact`` count plain windows, ``n_matched`` windows of the reading that decided.

    Null and empty texts and items hold nothing. An item of fewer than ``window`` words is one window of
    its own length; with fewer than ``LEAST_WORDS`` words it is found only in a text of just these
    words. Placeholder windows of fewer than ``literals`` plain words are of form only: they don't count,
    and items that have no others are found exactly or not at all. Rows without an id can't be named and
    are passed over here; repeated rows, and items repeated under one id, are told once (of different
    texts under one id the best match). Ids may be of any type. Other columns are ignored; an empty table
    on either side gives no rows.
    """
    rows = _found(docs, benchmark, **options).where("doc_id IS NOT NULL")
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("kind") == "exact").alias("sure"), (F.col("n_matched") / F.col("n_windows")).alias("share"), "n_windows", "n_matched", "n_exact", "kind")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.n_matched", "b.n_exact", "b.kind")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; of rows that share an id or have none only those go that hold one."""
    id_, own = fresh(docs.columns, "id"), fresh(docs.columns, "own")
    bad = _found(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(id_), F.col("row").alias(own)).distinct()
    digest = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (digest == F.col(own)), "left_anti")
