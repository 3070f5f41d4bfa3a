"""Embedding whitening: principal components of a covariance by FEAST contour integration.

Spark makes the distinct integer vectors, their sums and their centred second moments, all exact, so the
covariance is right to the last bit of a double however far the vectors lie from zero. The eigenproblem
(dimensions squared, whatever the number of vectors) is then solved by FEAST: counts of inertia (signs of
a symmetric factorization of V - s) place an interval around the wanted eigenvalues, a quadrature of
complex shifted solves on a circle through its ends projects a few vectors onto it, Rayleigh-Ritz takes
the components out of them, and the count of inertia says how many there must be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.textkit import fresh
from loomgraph.session import checkpointed

#: Nodes of the Gauss-Legendre quadrature on half a circle.
NODES = 8
_EXACT = pa.decimal128(38, 0)


# The eigenproblem ---------------------------------------------------------------------------------


def inertia_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` lie above ``shift``: by Sylvester's law as many as the
    factorization of ``a - shift`` into L D L' (pivots of one or two rows, as Bunch and Kaufman choose them) has above zero."""
    s = np.array(a, float)
    s[np.diag_indices_from(s)] -= shift
    alpha, above = (1 + math.sqrt(17)) / 8, 0

    def swap(i: int, j: int) -> None:
        s[[i, j]] = s[[j, i]]
        s[:, [i, j]] = s[:, [j, i]]

    while len(s):
        size, column = 1, np.abs(s[1:, 0])
        largest = column.max(initial=0.0)
        if max(abs(s[0, 0]), largest) == 0:
            s = s[1:, 1:]
            continue
        if abs(s[0, 0]) < alpha * largest:
            r = 1 + int(column.argmax())
            row = np.abs(s[r])
            row[r] = 0
            if abs(s[0, 0]) * row.max() < alpha * largest**2:
                if abs(s[r, r]) >= alpha * row.max():
                    swap(0, r)
                else:
                    swap(1, r)
                    size = 2
        pivot, under = s[:size, :size], s[size:, :size]
        above += 1 if size == 2 else int(pivot[0, 0] > 0)  # a pivot of two rows has one sign of each
        s = s[size:, size:] - under @ np.linalg.solve(pivot, under.T)
    return above


def top_interval(v: np.ndarray, k: int) -> tuple[float, float, int]:
    """``(low, high, m)``: the interval holds the ``m`` largest eigenvalues of ``v``, with ``m`` at least ``k`` (more where
    eigenvalues lie too close together to part them), or all positive ones; ``low`` lies in the gap under the least of them."""
    most = float(np.abs(v).sum(1).max(initial=0.0)) * (1 + 1e-12)
    least = most * len(v) * 1e-15
    m = inertia_above(v, least) if most > 0 else 0
    if not m:
        return 0.0, 0.0, 0
    k = min(k, m)
    low, high = least, most  # at least k lie above low, fewer above high
    while m > k and high - low > 1e-9 * most:
        mid = (low + high) / 2
        if (n := inertia_above(v, mid)) >= k:
            low, m = mid, n
        else:
            high = mid
    # the gap: the m-th lies above `low` still when it is raised, and one more above `under`
    under, up = 0.0, high
    for _ in range(24):
        if (mid := (low + up) / 2) and inertia_above(v, mid) == m:
            low = mid
        else:
            up = mid
    if m < len(v):
        at = low
        for _ in range(24):
            mid = (under + at) / 2
            if inertia_above(v, mid) > m:
                under = mid
            else:
                at = mid
    top, above = most, low
    for _ in range(24):
        mid = (above + top) / 2
        if inertia_above(v, mid):
            above = mid
        else:
            top = mid
    # the contour's lower end stands in the middle of the gap
    return max(least, (under + low) / 2), top + 1e-3 * (top - low) + least, m


def feast(v: np.ndarray, k: int, *, seed: int = 42, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric positive ``v``, falling, and their unit eigenvectors as columns; fewer
    where fewer are positive beyond rounding. An error where the count of inertia isn't met."""
    low, high, m = top_interval(v, k)
    d = len(v)
    if not m:
        return np.zeros(0), np.zeros((d, 0))
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * math.pi * (x + 1) / 2)
    center, radius = (low + high) / 2, (high - low) / 2
    random = np.random.default_rng(seed)
    size = min(d, 2 * m + 4)
    while True:
        basis, last = random.standard_normal((d, size)), np.inf
        for _ in range(rounds):
            projected = np.zeros((d, size))
            for t, w in zip(turn, weights, strict=True):
                shifted = (center + radius * t) * np.eye(d) - v
                projected += (w / 2) * (radius * t * np.linalg.solve(shifted, basis.astype(complex))).real
            q = np.linalg.qr(projected)[0]
            values, inner = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz, `size` rows
            basis = q @ inner
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(v @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == m and (residual <= 4e-16 * high or residual >= last and residual <= 1e-11 * high):
                order = np.argsort(-values[inside], kind="stable")[:k]
                return values[inside][order], basis[:, inside][:, order]
            last = residual if inside.sum() == m else np.inf
        if size == d:
            raise ArithmeticError(f"{m} eigenvalues lie in the interval, {int(inside.sum())} were found")
        size = min(d, 2 * size)


# Exact sums over the vectors ----------------------------------------------------------------------


def _integers(lists: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * c) of each vector, shorter ones filled up with zeros."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) >= 2.0**62:
        raise ValueError("entries are too large for whole numbers of 64 bits")
    x = np.zeros((len(lists), dims), np.int64)
    x[np.arange(dims) < lens[:, None]] = flat.astype(np.int64)
    return x


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 and 8 bytes a number that holds it, so equal rows have equal bytes."""
    most = np.maximum(x.max(1, initial=0), -x.min(1, initial=0))
    out: list[bytes] = [b""] * len(x)
    for width, rows in (("<i2", most < 1 << 15), ("<i4", (most >= 1 << 15) & (most < 1 << 31)), ("<i8", most >= 1 << 31)):
        at = np.flatnonzero(rows)
        data = x[at].astype(width).tobytes()
        step = len(data) // max(len(at), 1)
        for n, i in enumerate(at.tolist()):
            out[i] = data[n * step : (n + 1) * step]
    return out


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    x = np.zeros((len(column), dims), np.int64)
    for i, b in enumerate(column.to_pylist()):
        x[i] = np.frombuffer(b, f"<i{len(b) // dims}")
    return x


def _largest(*arrays: np.ndarray) -> int:
    return max(int(max(a.max(initial=0), -int(a.min(initial=0)))) for a in arrays)


def exact_products(y: np.ndarray) -> np.ndarray:
    """The sum over rows of the outer products, in whole numbers: by floats where each sum is exact in them."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    square = _largest(y) ** 2
    rows = (1 << 53) // max(square, 1)
    if not rows:
        return total + y.astype(object).T @ y.astype(object)
    for lo in range(0, len(y), rows):
        part = y[lo : lo + rows].astype(float)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(fit: DataFrame, dims: int, middle: list[int] | None) -> tuple[int, list[int], np.ndarray]:
    """The number of vectors, the sums of ``x - middle`` and, where a middle is given, of its outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            n += len(x)
            y = x if middle is None else x - np.array(middle, np.int64)
            total = total + (y.sum(0).astype(object) if _largest(y) * max(len(y), 1) < 1 << 62 else y.astype(object).sum(0))
            if middle is not None:
                products = products + exact_products(y)
        if n:
            cells = [(-1, -1, n), *((i, -1, int(t)) for i, t in enumerate(total))]
            if middle is not None:
                cells += [(i, j, int(products[i, j])) for i in range(dims) for j in range(i, dims)]
            i, j, value = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, _EXACT)], ["i", "j", "value"])

    cells = fit.mapInArrow(run, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    found = {(r.i, r.j): int(r.value) for r in cells}
    second = np.zeros((dims, dims), object)
    if middle is not None:
        for i in range(dims):
            for j in range(i, dims):
                second[i, j] = second[j, i] = found.get((i, j), 0)
    return found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(dims)], second


def covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """``(n, sums, V)`` of the distinct vectors ``fit(x)``: vectors are centred on the whole numbers next to their means before
    they are multiplied, and what is left of the means is taken off exactly."""
    n, sums, _ = _sums(fit, dims, None)
    middle = [round(s / n) if abs(s) < 1 << 53 else s // n for s in sums]
    _, off, second = _sums(fit, dims, middle)
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * second[i, j] - off[i] * off[j]) / (n * n)  # whole numbers, one rounding
    return n, sums, v


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, scale: float = 256, components: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every row and component.

    Rows whose vector is null or holds null or non-finite entries are left out; entries become floor(scale * c).
    The fit list has each distinct integer vector once, so repeated rows weigh nothing, and all rows get results.
    Shorter vectors count as filled up with zeros. Components without variance (beyond rounding) aren't given: a
    single distinct vector, empty vectors or an empty table give no rows. Entries that leave the range
    of long, and deviations that would, are an error. Where eigenvalues are equal, components are some basis of their space.
    """
    v = F.col(vec_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    name = fresh(["component", "n", "deviation", "whitened", "explained", "identity_error", "x"], id_col)
    rows = vectors.select(F.col(id_col).alias(name), v.alias("x")).where(v.isNotNull() & ~F.exists(v, bad))
    kind = vectors.schema[id_col].dataType.simpleString()
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    schema = f"`{name}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_integers(batch.column(0), dims, scale)), pa.binary())], ["x"])

    fit = checkpointed(rows.select("x").mapInArrow(pack, "x binary").distinct())
    n, sums, cov = covariance(fit, dims)
    values, vectors_of = feast(cov, components)
    k, trace = len(values), float(np.trace(cov))
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    to_white = vectors_of / np.sqrt(values)
    most_s = max(map(abs, sums))

    def apart(x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        if n * _largest(x) + most_s < 1 << 62:
            return x * n - np.array(sums, np.int64)
        return x.astype(object) * n - np.array(sums, object)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (apart(_unpacked(batch.column(0), dims)) / n).astype(float) @ to_white
            total[0] += w.sum(0)
            total[1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    total = np.zeros((k + 1, k))
    for r in fit.mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] = r.value / n
    error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = apart(_integers(batch.column(1), dims, scale))
            wide = y.dtype == object or _largest(y) ** 2 * dims >= 1 << 62
            deviation = (y.astype(object) ** 2).sum(1) if wide else (y * y).sum(1)
            if wide and len(deviation) and max(deviation) >= 1 << 63:
                raise ValueError("deviations are too large for whole numbers of 64 bits")
            w = (y / n).astype(float) @ to_white
            m = len(y)
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation.astype(np.int64)[again]), pa.array(w.ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
