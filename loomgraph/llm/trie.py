"""A prefix trie of conversations: sorted sequences, their LCPs and range minima, no tree in memory.

Conversations become sequences of turn digests (SHA-256 of role and text). The distinct sequences are
sorted by range partitions; neighbours' common prefixes are the LCP array. A prefix is an interval of
the sorted sequences: from any sequence that has it, its ends are found by two binary searches over
a sparse table of range minima of the LCPs, each for itself, so no stack is kept and all prefixes of
a block are searched at once. Counts are then differences of running sums over the interval.

A partition is handled in blocks of a bounded number of turns. A prefix that reaches over the border
of a block or a partition gives a part in each; every figure is a sum or a minimum, so parts are
merged by the prefix's digest, and what a sequence adds to the sums depends on the LCP with the
sequence before it alone, also over a border. The first turn of a third of all conversations
is thus one row from each block, however many conversations start with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import checkpointed, parallelism

#: The digest of the prefix without turns; a longer one's is that of its parent's digest and its last turn's.
ROOT = bytes(32)
#: Turns in a block; a longer conversation makes a longer block.
BLOCK = 1 << 17
_PART = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: for each conversation the digests of its turns and the UTF-8 bytes of their texts.

    Turns are ordered by ``turn_col`` (null first), ties by role and text; rows that repeat others
    are turns of their own; a null role or text is empty; rows without a conversation's id are left out.
    A conversation's digests (32 bytes a turn) meet in one row, its texts don't.
    """
    own = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text"), 256))
    placed = own.select("conv_id", F.struct(place.alias("n"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")).alias("t"))
    lists = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.bytes.alias("bytes"))).alias("turns"))


def with_shared_heads(lists: DataFrame, *, every: int = 5, heads: int = 9) -> DataFrame:
    """The lists with each conversation ``c`` rebuilt: the first ``h`` turns of conversation ``c - c % every``
    (all if it has fewer, none if there is no such conversation) and then ``c``'s own from the ``h``-th on;
    ``h`` is the CRC-32 of ``c``'s decimal form modulo ``heads``. A rebuilt conversation may have no turns."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, heads - 1)).alias("head"))
    none = F.slice("turns", 1, 0)
    both = lists.withColumn("base", base).join(head, "base", "left")
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns") + 1)).alias("turns"))


# One block of sorted sequences --------------------------------------------------------------------


def adjacent_lcps(digests: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each sequence but the first the length of the prefix that it shares with the one before; ``digests`` has
    a row for each turn, ``at`` says where the sequences begin and the last ends."""
    lens = np.diff(at)
    common = np.minimum(lens[:-1], lens[1:])
    pair = np.repeat(np.arange(len(common)), common)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(common) - common, common)
    differ = (digests[at[pair] + step] != digests[at[pair + 1] + step]).any(1)
    lcp = common.copy()
    np.minimum.at(lcp, pair[differ], step[differ])
    return lcp


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all ranges whose length is a power of two: level ``k`` has those of ``values[i : i + 2**k]``."""
    levels = [values]
    while 2 * (1 << len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(last[: len(last) - half], last[half:]))
    return levels


def range_minimum(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minima of ``values[lo : hi + 1]``, from two overlapping ranges each."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for k in np.unique(level):
        some = level == k
        out[some] = np.minimum(table[k][lo[some]], table[k][hi[some] + 1 - (1 << k)])
    return out


def extents(table: list[np.ndarray], n: int, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of ``n`` sorted sequences that share ``depth`` leading items with sequence ``at``;
    ``table`` is over their LCPs (the j-th is that of sequences j and j + 1)."""
    left, right = at.copy(), at.copy()
    for k in reversed(range(len(table))):
        width = 1 << k
        fits = right + width < n
        more = fits.copy()
        more[fits] = table[k][right[fits]] >= depth[fits]
        right[more] += width
        fits = left - width >= 0
        more = fits.copy()
        more[fits] = table[k][left[fits] - width] >= depth[fits]
        left[more] -= width
    return left, right


def block_nodes(turns: list[list[tuple[bytes, int]]], copies: np.ndarray, least: np.ndarray, before: int, after: int) -> dict[str, list]:
    """The parts that a block of distinct sorted sequences has in the trie's nodes.

    ``copies`` conversations have each sequence, ``least`` is the smallest of their ids; ``before`` and ``after`` are
    the LCPs with the sequences next to the block, -1 where there is none.
    """
    n = len(turns)
    lens = np.array([len(t) for t in turns], np.int64)
    at = np.concatenate([[0], np.cumsum(lens)])
    flat = b"".join(d for t in turns for d, _ in t)
    digests = np.frombuffer(flat, np.uint64).reshape(-1, 4)
    lcp = adjacent_lcps(digests, at)
    table = sparse_table(lcp) if len(lcp) else []
    # cumulative bytes of each sequence at depths 0 .. len, one after another
    upto = np.concatenate([np.concatenate([[0], np.cumsum([b for _, b in t])]) for t in turns]).astype(np.int64)
    own = at[:-1] + np.arange(n)  # where a sequence's depth 0 stands in it
    before_each = np.concatenate([[before], lcp])
    new_from = np.maximum(before_each, -1) + 1  # a sequence is the first to have its prefixes from this depth on
    whole = upto[own + lens]
    fresh = whole - upto[own + np.maximum(new_from - 1, 0)]
    leaf = (np.concatenate([lcp, [after]]) < lens).astype(np.int64)
    # candidates: of the block's first sequence all prefixes, of the others those that the one before lacks
    first = new_from.copy()
    first[0] = 0
    each = lens + 1 - first
    seq = np.repeat(np.arange(n), each)
    depth = np.arange(len(seq)) - np.repeat(np.cumsum(each) - each, each) + first[seq]
    left, right = extents(table, n, seq, depth)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    over = lambda s, lo=left: s[right + 1] - s[lo]
    above = upto[own[seq] + np.maximum(depth - 1, 0)]  # bytes of the turns before the prefix's last
    convs = over(sums(copies))
    held = over(sums(copies * whole)) - convs * above  # bytes of all members' turns from the last on
    once = over(sums(fresh), left + 1) + whole[left] - upto[own[left] + np.maximum(np.maximum(depth - 1, new_from[left] - 1), 0)]
    # children: sequences in the interval that part from the one before just here, and its first if it is longer
    order = np.lexsort((np.arange(len(lcp)), lcp))
    ranked = lcp[order] * n + order
    split = np.searchsorted(ranked, depth * n + right, side="left") - np.searchsorted(ranked, depth * n + left, side="left")
    children = split + ((lens[left] > depth) & (new_from[left] <= depth + 1))
    keys = [list(accumulate((d for d, _ in t), lambda k, d: hashlib.sha256(k + d).digest(), initial=ROOT)) for t in turns]
    pairs = list(zip(seq.tolist(), depth.tolist(), strict=True))
    return {
        "node": [keys[i][d] for i, d in pairs],
        "parent": [keys[i][d - 1] if d else None for i, d in pairs],
        "depth": depth,
        "conv_id": range_minimum(sparse_table(least), left, right),
        "n_convs": convs,
        "n_children": children,
        "n_leaves": over(sums(leaf)),
        "saved_tokens": held - once,
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows ``(turns, copies, least)`` in blocks of about ``BLOCK`` turns."""
    block, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("digests", "bytes", "copies", "conv_id")), strict=True):
            block.append((list(zip(row[0], row[1], strict=True)), row[2], row[3]))
            held += len(row[0]) + 1
            if held >= BLOCK:
                yield block
                block, held = [], 0
    if block:
        yield block


def _common(a: list[tuple], b: list[tuple]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x[0] != y[0]), min(len(a), len(b)))


# All blocks ---------------------------------------------------------------------------------------


def prefix_trie(lists: DataFrame) -> DataFrame:
    """The nodes of the trie of ``lists(conv_id, turns)``, as ``turn_lists`` makes them, one row a node:

    ``conv_id`` smallest member (a conversation that starts with the node's turns), ``depth`` (the root 0),
    ``parent_conv_id`` (root: null), ``n_convs`` members, ``n_children``, ``n_leaves`` childless nodes in the subtree
    (a leaf is its own), ``saved_tokens`` the sum over the subtree of (members - 1) times the bytes of a
    node's last text, ``ends_sha256`` the digest of the ids of the members that end here, ascending and
    comma-joined. Conversations without turns are members of the root. No conversations give no rows.
    """
    key = F.aggregate("turns", F.lit(ROOT), lambda k, t: F.unhex(F.sha2(F.concat(k, t.digest), 256)))
    keyed = checkpointed(lists.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("bytes"), key.alias("node")))
    distinct = keyed.groupBy("node").agg(F.first("digests").alias("digests"), F.first("bytes").alias("bytes"), F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    ranged = checkpointed(distinct.repartitionByRange(parallelism(lists.sparkSession), "digests").sortWithinPartitions("digests"))
    before = _border_lcps(ranged)
    parts = sorted(before)
    after = {p: before[q] for p, q in zip(parts, parts[1:], strict=False)}
    fields = pa.schema([(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in (f.split() for f in _PART.split(", "))])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting, border = None, before.get(part, -1)

        def out(block: list[tuple], border: int, beyond: int) -> pa.RecordBatch:
            turns, copies, least = zip(*block, strict=True)
            found = block_nodes(list(turns), np.array(copies, np.int64), np.array(least, np.int64), border, beyond)
            return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in fields], schema=fields)

        for block in _blocks(batches):
            if waiting:
                common = _common(waiting[-1][0], block[0][0])
                yield out(waiting, border, common)
                border = common
            waiting = block
        if waiting:
            yield out(waiting, border, after.get(part, -1))

    merged = ranged.select("digests", "bytes", "copies", "conv_id").mapInArrow(nodes, _PART).groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = checkpointed(merged)
    up = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = merged.join(_ends(keyed.select("node", "conv_id")), "node", "left").join(up, "parent", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


def _border_lcps(ranged: DataFrame) -> dict[int, int]:
    """For each partition with rows the LCP of its first sequence with the last one before it (-1: none): two
    numbers a partition for the driver; the sequences themselves stay on the executors."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), first.column(0), last.column(0)], ["part", "head", "tail"])

    rows = ranged.select("digests").mapInArrow(ends, "part int, head array<binary>, tail array<binary>")
    tail = F.lag("tail").over(Window.orderBy("part"))
    same = F.zip_with("head", tail, lambda a, b: a.eqNullSafe(b))
    parted = F.array_position(same, False)
    lcp = F.when(parted > 0, parted - 1).otherwise(F.size(same))
    return {r.part: r.lcp for r in rows.select("part", F.when(tail.isNull(), -1).otherwise(lcp).cast("int").alias("lcp")).collect()}


def _ends(members: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the conversations' last nodes; ids are hashed as they stream by in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            nodes, digests = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == node:
                    running.update(b",%d" % conv)
                    continue
                if node is not None:
                    nodes.append(node)
                    digests.append(running.hexdigest())
                node, running = key, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])

    return members.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(digest, "node binary, ends_sha256 string")
