"""Interval-overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.predicates import overlaps

#: Bin width; about the typical length of an interval makes one or two bins each.
WIDTH = 1 << 12
#: An interval over more bins than this goes to bins that are as many times wider.
WIDE = 64


def overlap_join(left: DataFrame, right: DataFrame, a: str, b: str, *, width: int = WIDTH) -> DataFrame:
    """Pairs of rows whose half-open intervals ``{x}__chr, {x}__start, {x}__end`` share a point.

    Both sides are dealt to the bins that their intervals touch and meet by an equi-join on
    chromosome, meeting and bin; a pair counts in its first common bin only, so nothing needs a distinct.
    There are two widths. Which two meet is part of the key: short intervals (up to ``WIDE`` narrow bins) of both
    sides meet in narrow bins, a long one and any other in wide bins. A short interval stands in wide bins
    for the other side's long ones alone, so two short ones never meet there. Rows with a
    null chromosome or end match nothing; an empty interval matches one around it.
    """

    def bins(frame: DataFrame, x: str, meets: tuple[str, str, str]) -> DataFrame:
        start, end = F.col(f"{x}__start"), F.col(f"{x}__end")
        last = F.greatest(start, end - 1)
        at = lambda p, w: F.floor(p / w).cast("long")
        role = lambda name, w: F.struct(F.lit(name).alias("meet"), at(start, w).alias("lo"), at(last, w).alias("hi"))
        short_short, short_long, long_short = meets
        wide = width * WIDE
        roles = F.when(at(last, width) - at(start, width) >= WIDE, F.array(role(long_short, wide), role("ll", wide))).otherwise(F.array(role(short_short, width), role(short_long, wide)))
        frame = frame.withColumn(f"{x}__at", F.explode(roles))
        return frame.withColumn(f"{x}__bin", F.explode(F.sequence(F.col(f"{x}__at.lo"), F.col(f"{x}__at.hi"))))

    known = lambda frame, x: frame.where(F.col(f"{x}__end").isNotNull() & F.col(f"{x}__start").isNotNull())
    l, r = bins(known(left, a), a, ("ss", "sl", "ls")), bins(known(right, b), b, ("ss", "ls", "sl"))  # noqa: E741
    c = F.col
    on = (c(f"{a}__chr") == c(f"{b}__chr")) & (c(f"{a}__bin") == c(f"{b}__bin")) & (c(f"{a}__at.meet") == c(f"{b}__at.meet")) & overlaps(c(f"{a}__start"), c(f"{a}__end"), c(f"{b}__start"), c(f"{b}__end"))
    first = c(f"{a}__bin") == F.greatest(c(f"{a}__at.lo"), c(f"{b}__at.lo"))
    return l.join(r, on & first).drop(*[f"{x}__{n}" for x in (a, b) for n in ("at", "bin")])


def overlap_join_plain(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """The same by an equi-join on chromosome alone; for few intervals on each."""
    return left.join(right, (F.col(f"{a}__chr") == F.col(f"{b}__chr")) & overlaps(F.col(f"{a}__start"), F.col(f"{a}__end"), F.col(f"{b}__start"), F.col(f"{b}__end")))
