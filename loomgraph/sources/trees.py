"""Nested S-expressions as tables.

A line's tokens get their depth by a running sum (an opening bracket counts one, a closing one takes it
back); the list that a token belongs to is the last one opened a level up. A line is a row, so all of this happens
within its task, over the tokens of many lines at once, and nothing is shuffled; nothing recurses, and a line may be as
deep as it likes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.sexpr import plain

#: Tokens that are placed together, unless one line has more.
TOKENS = 1 << 20
_TOKEN = r"(\(|\)|(?:[^()\\\s]|\\.)+)"


def atoms(text: Column) -> Column:
    """A line's symbols depth first as an array of texts, without brackets and commas."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(_TOKEN)), lambda t: ~t.isin("(", ")", ",")), plain)


def parse_trees(lines: DataFrame, id_col: str = "id", column: str = "value") -> DataFrame:
    """``(id, node, parent, nth, depth, symbol, last)``, a row for each symbol and each list of each line.

    ``node`` is the place of the symbol's or the opening bracket's token in the line (from 0) and ``last`` that of its
    last token, so ``[node, last]`` is its span; ``parent`` is the node of the list around it (null at the top),
    ``nth`` its place among the parent's children (from 0), ``depth`` the number of lists around it; ``symbol`` is null
    for a list, and as written otherwise (``sexpr.plain`` gives its text). A line whose brackets don't match gives no rows; nor do blank lines and ``;`` comments.
    """
    line = F.col(column)
    rows = lines.where(line.isNotNull() & ~line.rlike(r"^\s*(;.*)?$")).select(F.col(id_col).alias("id"), F.regexp_extract_all(line, F.lit(_TOKEN)).alias("tokens"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            lo = 0
            while lo < batch.num_rows:  # lines of about ``TOKENS`` tokens together, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TOKENS, side="right")) - 1)
                ids, tokens = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                row, symbol, *numbers = _spans(tokens)
                yield pa.RecordBatch.from_arrays([ids.take(row), *[pa.array(x, t, mask=none) for x, t, none in numbers[:4]], symbol, pa.array(numbers[4][0], pa.int32())], names)
                lo = hi

    names = ["id", "node", "parent", "nth", "depth", "symbol", "last"]
    return rows.mapInArrow(parse, f"id {rows.schema['id'].dataType.simpleString()}, node int, parent int, nth int, depth long, symbol string, last int")


def _spans(lists: pa.Array) -> tuple:
    """Of these lines' tokens the symbols and lists: ``(row, symbol, node, parent, nth, depth, last)``, numbers as ``(values, type, nulls)``."""
    tokens, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    begin = np.repeat(np.cumsum(size) - size, size)
    opens, closes = (pc.equal(tokens, x).to_numpy(zero_copy_only=False) for x in "()")
    after = np.cumsum(opens.astype(np.int64) - closes)
    before = np.concatenate([[0], after])[begin]  # what the lines up to here add up to
    after -= before
    bad = np.zeros(len(size), bool)
    bad[row[after < 0]] = True
    some = np.flatnonzero(size)
    bad[some[after[np.cumsum(size)[some] - 1] != 0]] = True
    at = np.flatnonzero(~bad[row])
    row, node, opens, closes, after = row[at], (at - begin[at]), opens[at], closes[at], after[at]
    # a bracket pair and what is right inside it share a level: the depth between the brackets
    level = np.where(closes, after + 1, after)
    # within a line and level the last opening bracket is the list; a list itself looks for the one a level up
    n, lists_at = len(at), np.flatnonzero(opens)
    who = np.concatenate([np.arange(n), lists_at])
    where = np.concatenate([level, level[lists_at] - 1])
    asks = np.arange(len(who)) >= n
    order = np.lexsort((asks, who, where, row[who]))
    opened = np.where(opens[who[order]] & ~asks[order], who[order], -1)
    # tokens of one line and level follow one another, and from level 1 on the first of them is a bracket that opens
    last_open = np.empty(len(who), np.int64)
    last_open[order] = np.maximum.accumulate(np.where(opened >= 0, np.arange(len(who)), -1))
    held = np.where(where > 0, np.append(who[order], -1)[last_open], -1)
    own, up = held[:n], np.full(n, -1)
    up[lists_at] = held[n:]
    last = np.arange(n)
    last[own[closes]] = np.flatnonzero(closes)
    shown = np.flatnonzero(~closes)
    parent = np.where(opens, up, own)[shown]
    order = np.lexsort((shown, parent, row[shown]))
    first = np.append(True, (np.diff(parent[order]) != 0) | (np.diff(row[shown][order]) != 0))[: len(order)]
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    is_list = opens[shown]
    symbol = pc.if_else(pa.array(is_list), pa.scalar(None, pa.string()), tokens.take(pa.array(at[shown])).cast(pa.string()))
    depth = np.where(is_list, level[shown] - 1, level[shown])
    return pa.array(row[shown]), symbol, (node[shown], pa.int32(), None), (np.append(node, 0)[parent], pa.int32(), parent < 0), (nth, pa.int32(), None), (depth, pa.int64(), None), (node[last[shown]], pa.int32(), None)


def children(trees: DataFrame) -> DataFrame:
    """``(id, node, spans)``: for each list its children's spans ``(first, last)`` in order. A list's children meet in one row."""
    spans = F.sort_array(F.collect_list(F.struct(F.col("node").alias("first"), "last")))
    return trees.where("parent IS NOT NULL").groupBy("id", F.col("parent").alias("node")).agg(spans.alias("spans"))


def render(trees: DataFrame) -> DataFrame:
    """``(id, value)``: the lines that these trees were read from, with single blanks. A line's tokens meet in one row."""
    token = lambda at, text: F.struct(at.alias("at"), text.alias("text"))
    tokens = F.when(F.col("symbol").isNull(), F.array(token(F.col("node"), F.lit("(")), token(F.col("last"), F.lit(")")))).otherwise(F.array(token(F.col("node"), F.col("symbol"))))
    all_ = trees.select("id", F.explode(tokens).alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    text = F.array_join(F.transform("t", lambda t: t.text), " ")
    return all_.select("id", F.regexp_replace(F.regexp_replace(text, r"(?<!\\)\( ", "("), r" \)", ")").alias("value"))
