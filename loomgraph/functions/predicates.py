"""Property predicates as columns. Values from a request only ever become literals."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVAL_KEYS = frozenset({"start", "end", "interval_type", "upstream_distance", "downstream_distance"})
_PLAIN = re.compile(r"[\w \-]*\Z", re.ASCII)


def regex_full(column: Column, value: object) -> Column:
    """Case-insensitive match of the whole value; a null never matches.

    A value without any regex character is compared in lower case instead, which needs no regex engine.
    """
    text = str(value)
    if _PLAIN.match(text):
        return F.lower(column.cast("string")) == text.lower()
    return column.cast("string").rlike(rf"(?i)\A(?:{text})\z")


def exact(column: Column, value: object, kind: str | None = None) -> Column:
    """Equality; the request's null asks for a missing property. With ``kind``, the column's type, the
    value is cast and not the column, so that the filter reaches the scan; a value that is none of that
    type equals nothing."""
    if value is None:
        return column.isNull()
    return column == (F.lit(value) if kind is None else F.lit(value).cast("string").try_cast(kind))


def has_id(column: Column, node_id: str, kind: str) -> Column:
    """Equality with an id given as text, cast to the column's type; only the id's own spelling counts."""
    wanted = F.lit(node_id).try_cast(kind)
    return (column == wanted) & (wanted.cast("string") == F.lit(node_id))


def to_integer(column: Column, kind: str | None = None) -> Column:
    """A whole number from text or number, decimals cut off; null where there is none. A column whose
    type is known to be integral stays as it is."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return column
    text = column.cast("string")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def interval(properties: Mapping[str, object], start: Column, end: Column, kinds: tuple[str | None, str | None] = (None, None)) -> Column | None:
    """The closed-interval condition of a request, or None unless it has both ends; ``kinds`` are the
    columns' types.

    Kinds: ``intersects``, ``upstream``, ``downstream``; any other means within.
    """
    if properties.get("start") in (None, "") or properties.get("end") in (None, ""):
        return None
    lo, hi = int(float(str(properties["start"]))), int(float(str(properties["end"])))
    s, e = to_integer(start, kinds[0]), to_integer(end, kinds[1])
    kind = properties.get("interval_type")
    if kind == "intersects":
        return (e >= lo) & (s <= hi)
    if kind == "upstream":
        return e <= lo - int(properties.get("upstream_distance") or 0)
    if kind == "downstream":
        return s >= hi + int(properties.get("downstream_distance") or 0)
    return (s >= lo) & (e <= hi)


def node_filters(vertices: DataFrame, node_id: str, properties: Mapping[str, object], *, matching: str = "regex") -> list[Column]:
    """All conditions on a vertex frame: an id stands alone, else every property and the interval. A
    property that the vertices don't have is missing on each: nothing matches it, but for an exact null."""
    kinds = dict(vertices.dtypes)
    if node_id != "":
        return [has_id(F.col("id"), node_id, kinds["id"])]
    found = []
    for k, v in properties.items():
        if k in INTERVAL_KEYS:
            continue
        if k not in kinds:
            found.append(F.lit(matching == "exact" and v is None))
        else:
            found.append(regex_full(F.col(f"`{k}`"), v) if matching == "regex" else exact(F.col(f"`{k}`"), v, kinds[k]))
    if {"start", "end"} <= properties.keys():
        if {"start", "end"} <= kinds.keys():
            near = interval(properties, F.col("start"), F.col("end"), (kinds["start"], kinds["end"]))
            found += [] if near is None else [near]
        elif interval(properties, F.lit(0), F.lit(0)) is not None:
            found.append(F.lit(False))
    return found


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals that share a point."""
    return (a_start < b_end) & (b_start < a_end)
