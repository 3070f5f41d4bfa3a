"""Numpy over the byte buffers of Arrow text columns, shared by the text operators.

Whole batches are handled at once; there is no Python loop over words. Word means a run of bytes
other than space and ``\\t\\n\\v\\f\\r``.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each; a longer row stands alone and whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


#: glibc's call that gives free memory in the middle of the heap back, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Memory that Arrow's and C's allocators hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, at whose end the worker gives back what its allocators hold free: a worker waits
    for its next task, perhaps through stages without Python, and until then that would count beside the JVM's memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each row's words begin among them."""
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
    first[head], last[tail] = inside[head], inside[tail]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factor = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), factor, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """Hashes of any spans of a byte or code array, from one pass of prefix sums modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=self.sums[1:])
        self.down = _power("down", n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


#: A byte's bits as the bytes of a 64-bit word, so that one addition counts eight bits.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view("<u8").ravel()


def bit_votes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the groups of hashes, which follow one another without a gap and none of which is
    empty, how many have each of the 64 bits set. Up to 255 are summed in bytes at a time."""
    pieces = -(-(ends - starts) // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    some = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8).reshape(-1, 64)
    return some if len(some) == len(starts) else np.add.reduceat(some, first, axis=0, dtype=np.int64)


#: Byte-level tokenizers show bytes that don't print as the characters from 256 on.
_SHOWN = dict(zip([*range(33), *range(127, 161), 173], range(256, 324), strict=True))


def byte_alphabet(word: str) -> str:
    """A word without blanks in the characters that byte-level vocabularies show its bytes by."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
