"""Property bags: properties that differ from row to row, in one column of Spark's variant type.

A filter extracts its property by path and type before anything else of the bag is looked at. A value that
isn't of the asked type is missing, as a property that a row doesn't have.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.predicates import INTERVAL_KEYS, interval, regex_full


def bag_of(json: Column) -> Column:
    """A bag from a JSON object; null where it is none."""
    return F.try_parse_json(json)


def bag_from(frame: DataFrame, columns: list[str]) -> Column:
    """A bag of these columns; a null is no property."""
    return F.parse_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def _path(key: str) -> str:
    quote = next((q for q in "'\"" if q not in key), None)
    if quote is None:
        raise ValueError(f"a property's name can't have quotes of both kinds: {key}")
    return f"$[{quote}{key}{quote}]"


def value_of(bag: Column, key: str, kind: str = "string") -> Column:
    """A property as ``kind``; null where it is missing or of another type. Numbers and truth values have a text, lists
    (also lists written in a text, as ``["a", "b"]`` or ``['a', 'b']``) are read by ``list_of``."""
    return F.try_variant_get(bag, _path(key), kind)


def list_of(bag: Column, key: str) -> Column:
    """A property as an array of texts: a list's items, the items of a list written in a text, and any other value as the
    one item; null where it is missing."""
    text = value_of(bag, key)
    quoted = F.when(text.rlike(r"^\s*\[.*\]\s*$"), F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.translate(text, "'", '"'), "array<string>")))
    return F.coalesce(value_of(bag, key, "array<string>"), quoted, F.when(text.isNotNull(), F.array(text)))


def keys_of(bag: Column) -> Column:
    """The names of a bag's properties."""
    return F.json_object_keys(F.to_json(bag))


def bag_filters(bag: Column, properties: Mapping[str, object], *, matching: str = "regex") -> list[Column]:
    """The conditions of a node's properties on a bag: full-match regexes in any case or exact values (of a list property
    one item must match), and the interval of ``start`` and ``end``. An exact null asks for a missing property."""

    def one(key: str, value: object) -> Column:
        if matching == "regex":
            return F.exists(list_of(bag, key), lambda x: regex_full(x, value))
        return list_of(bag, key).isNull() if value is None else F.exists(list_of(bag, key), lambda x: x == F.lit(_text(value)))

    found = [one(k, v) for k, v in properties.items() if k not in INTERVAL_KEYS]
    near = interval(properties, value_of(bag, "start"), value_of(bag, "end"))
    return found if near is None else [*found, near]


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def bag_description(bag: Column, keys: list[str]) -> Column:
    """``Key: value | Key: value`` of the properties that are set; of lists the first three items."""
    said = lambda k: F.array_join(F.slice(list_of(bag, k), 1, 3), ", ")
    return F.concat_ws(" | ", *[F.when(list_of(bag, k).isNotNull(), F.concat(F.lit(f"{k.capitalize()}: "), said(k))) for k in keys])
