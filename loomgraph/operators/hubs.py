"""Joins on keys of which a few have very many rows (hubs), without waiting for a skewed partition.

One pass over each side keeps a sketch of its frequent keys. A key that is frequent on either side
gets a grid: its left rows are dealt over the grid's rows and repeated along its columns, its right rows the
other way, so that each pair of rows meets in just one cell and no cell holds more than about
``chunk`` rows of a side. All other keys are joined plainly, in the same shuffle. The table of hubs is bounded by the
sketch, however many rows the sides have.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch reports at most, and counters that it keeps; its errors are a few in ``TRACKED`` parts of all rows.
REPORTED, TRACKED = 1000, 10_000
#: Rows of a side that one cell of a hub's grid holds, about.
CHUNK = 1 << 20


def frequent_keys(frame: DataFrame, key: str, least: int, *, reported: int = REPORTED, tracked: int = TRACKED) -> DataFrame:
    """``(key, n)``: keys with ``least`` rows or more by the estimate of one pass (a mergeable sketch of frequent items, combined
    on the map side); at most ``reported`` keys. Estimates are off by a few in ``tracked`` parts of all rows, which
    makes a grid a little coarser or finer and no result wrong; null keys are none."""
    top = frame.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {reported}, {max(tracked, reported)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("key"), F.col("t.count").alias("n")).where(F.col("n") >= least)


def hub_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, chunk: int = CHUNK, reported: int = REPORTED, tracked: int = TRACKED) -> DataFrame:
    """The inner join of ``left`` and ``right`` on one key each, with all columns of both.

    Rows with a null key match nothing. Column names must differ, as for any join by columns of two frames.
    The hubs are found when the join is made: the driver gets at most two times ``reported`` keys and their grids.
    """
    sizes: dict[object, list[int]] = {}
    for side, (frame, key) in enumerate(((left, left_key), (right, right_key))):
        for r in frequent_keys(frame, key, chunk + 1, reported=reported, tracked=tracked).collect():
            sizes.setdefault(r.key, [1, 1])[side] = math.ceil(r.n / chunk)
    if not sizes:
        return left.join(right, F.col(left_key) == F.col(right_key))
    kind = left.schema[left_key].dataType.simpleString()
    hubs = left.sparkSession.createDataFrame([(k, rows, columns) for k, (rows, columns) in sizes.items()], f"__hub {kind}, __rows int, __columns int")
    return dealt(left, left_key, hubs, own="__rows", other="__columns", at="__l").join(dealt(right, right_key, hubs, own="__columns", other="__rows", at="__r"), (F.col(left_key) == F.col(right_key)) & (F.col("__l_own") == F.col("__r_other")) & (F.col("__l_other") == F.col("__r_own"))).drop("__l_own", "__l_other", "__r_own", "__r_other")


def dealt(frame: DataFrame, key: str, hubs: DataFrame, *, own: str, other: str, at: str) -> DataFrame:
    """The rows with their place in their key's grid: ``{at}_own`` by a hash of the row, ``{at}_other`` each of the
    other side's places, a row for each; both 0 where the key is no hub. A retried task deals its rows alike."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in frame.dtypes if "map<" not in t and "variant" not in t])
    met = frame.join(F.broadcast(hubs), F.col(key) == F.col("__hub"), "left")  # as many rows as the sketches reported
    place = F.coalesce(F.pmod(row, F.col(own)).cast("int"), F.lit(0))
    there = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    return met.select(*frame.columns, place.alias(f"{at}_own"), there.alias(f"{at}_other"))
