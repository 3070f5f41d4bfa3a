"""Reachability along edges of one kind, such as ``subclass_of``: semi-naive rounds.

A round extends only the pairs that the round before found, by one join with the edges, and keeps those not
known yet, so each pair is made once for each edge that leads to it and cycles end by themselves. Without a
bound on the depth, the steps double instead: new pairs meet all pairs known, and the rounds grow with the
logarithm of the longest way. What a round finds is stored; the number of its tasks follows the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import dealt, stored

#: Pairs that a round handles, as a multiple of those known before; it sets the number of tasks alone.
GROWTH = 5


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", *, depth: int | None = None, starts: DataFrame | None = None, reflexive: bool = False) -> DataFrame:
    """``(child, ancestor, distance)``: what each child reaches in one step or more, with the least number of steps.

    At most ``depth`` steps (None: no bound). ``starts(child)`` restricts the children; then rounds go step by step
    from these alone. A node on a cycle reaches itself; with ``reflexive`` every node of the edges (or of ``starts``)
    does, at distance 0. Edges with a null end lead nowhere, repeated edges count once, self-loops are steps like others.
    """
    if depth is not None and depth < 0:
        raise ValueError("a depth is 0 or more")
    step = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child IS NOT NULL AND ancestor IS NOT NULL").distinct()
    step = stored(step)
    first = step if starts is None else step.join(starts.select(F.col(starts.columns[0]).alias("child")), "child", "left_semi")
    if depth == 0:
        found = first.limit(0).withColumn("distance", F.lit(0))
    elif depth is None and starts is None:
        found = _doubled(step)
    else:
        found = _stepwise(first, step, depth)
    if not reflexive:
        return found
    own = starts.select(F.col(starts.columns[0]).alias("child")).where("child IS NOT NULL") if starts is not None else step.select(F.explode(F.array("child", "ancestor")).alias("child"))
    own = own.distinct().select("child", F.col("child").alias("ancestor"), F.lit(0).alias("distance"))
    return own.unionByName(found.where("child <> ancestor"))


def _further(found: DataFrame, near: DataFrame, by: DataFrame, known: int) -> DataFrame:
    """The pairs not in ``found`` that a pair of ``near`` and then one of ``by`` make, with their least distance, which is over ``known``.

    A pair found is at most ``known`` steps apart, so the least distance tells old from new. Both are dealt by the
    child, to tasks whose number follows the pairs: a round made up to about four times as many as were known.
    """
    n = GROWTH * found.count()
    old = dealt(found.select("child", "ancestor", "distance"), n, "child")
    steps = old if by is found else dealt(by.select("child", "ancestor", "distance"), n, "child")
    near = dealt(near.select(F.col("child").alias("start"), F.col("ancestor").alias("child"), F.col("distance").alias("d")), n, "child")
    made = near.join(steps, "child").select(F.col("start").alias("child"), "ancestor", (F.col("d") + F.col("distance")).alias("distance"))
    least = old.unionByName(dealt(made, n, "child")).groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))
    return stored(least.where(F.col("distance") > known))


def _stepwise(first: DataFrame, step: DataFrame, depth: int | None) -> DataFrame:
    """Pairs by their distance, a step a round; what a round finds is at its distance and not nearer."""
    step = step.withColumn("distance", F.lit(1))
    new = found = stored(first.withColumn("distance", F.lit(1)))
    n = 1
    while (depth is None or n < depth) and not new.isEmpty():
        new = _further(found, new, step, n)
        found = found.unionByName(new)
        n += 1
    return found


def _doubled(step: DataFrame) -> DataFrame:
    """After round ``r`` all pairs at most ``2**r`` steps apart are known with their distance: a way of up to twice the known
    length is two known ways, of which the first is as long as the pairs known fully (or the pair is known)."""
    found = stored(step.withColumn("distance", F.lit(1)))
    known = 1  # all pairs up to this distance are in `found`
    while True:
        near = found.where(F.col("distance") == known)
        if near.isEmpty():  # no pair is farther apart either: a part of its way would be as long
            return found
        found, known = found.unionByName(_further(found, near, found, known)), 2 * known


def rolled_up(members: DataFrame, edges: DataFrame, *, depth: int | None = None) -> DataFrame:
    """``(member, term, distance)``: the terms of ``members(member, term)`` and all their ancestors along
    ``edges(child, parent)``, each once with the fewest steps from one of the member's terms."""
    own = stored(members.where("member IS NOT NULL AND term IS NOT NULL").select("member", "term").distinct())
    above = closure(edges, depth=depth)
    of = above.agg(F.count("*").alias("pairs"), F.approx_count_distinct("child").alias("children")).first()
    rows = own.count() * (of.pairs // max(1, of.children) + 2)  # those of a term on average, and itself
    most = max(rows, of.pairs)
    up = dealt(own, most, "term").join(dealt(above, most, "child").withColumnRenamed("ancestor", "above"), F.col("term") == F.col("child"))
    up = up.select("member", F.col("above").alias("term"), "distance")
    return dealt(own.withColumn("distance", F.lit(0)).unionByName(up), rows, "member", "term").groupBy("member", "term").agg(F.min("distance").alias("distance"))
