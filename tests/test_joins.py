"""Counts without bindings, generic joins, hub joins, closures and overlap candidates, with their plans and sizes."""

import random

import pytest
from pyspark.sql import functions as F
from test_graph import graph, q, rows

from loomgraph import session
from loomgraph.operators import closure, hubs, result
from loomgraph.operators.overlap import overlap_join, overlap_join_plain
from loomgraph.plans import compiler, counting, generic
from loomgraph.queries import _FOUR, _TRIANGLE, _TWIN, CHAIN
from loomgraph.testbed import star_graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small(spark, seed=1):
    r = random.Random(seed)
    some = lambda n: [(r.randrange(6), r.randrange(6)) for _ in range(n)]
    return graph(spark, {"a": [0, 1, 2, 3], "b": [1, 2, 3, 4, 5], "c": [0, 2, 4]}, {("a", "e", "b"): some(14), ("b", "f", "c"): some(14), ("a", "g", "c"): some(10), ("a", "l", "a"): some(12)})


TREES = {
    "one": q([("x", "a")]),
    "edge": q([("x", "a"), ("y", "b")], [("e", "x", "y")]),
    "path": q([("x", "a"), ("y", "b"), ("z", "c")], [("e", "x", "y"), ("f", "y", "z")]),
    "star": q([("x", "a"), ("y", "b"), ("z", "c"), ("w", "b")], [("e", "x", "y"), ("e", "x", "w"), ("g", "x", "z")]),
    "long": q([("v", "a"), ("w", "a"), ("x", "a"), ("y", "b"), ("z", "c"), ("u", "a")], [("l", "v", "w"), ("l", "w", "x"), ("e", "x", "y"), ("f", "y", "z"), ("g", "u", "z")]),
    "anchored": q([("x", "a", "1"), ("y", "b"), ("z", "c")], [("e", "x", "y"), ("f", "y", "z")]),
    "none": q([("x", "a", "77"), ("y", "b")], [("e", "x", "y")]),
    "two parts": q([("x", "a"), ("y", "b"), ("z", "c"), ("w", "a")], [("e", "x", "y"), ("g", "w", "z")]),
    "two parts, one empty": q([("x", "a"), ("y", "b"), ("z", "c", "99"), ("w", "a")], [("e", "x", "y"), ("g", "w", "z")]),
}


@pytest.mark.parametrize("name", TREES)
def test_counts_without_bindings(spark, name):
    g, query = small(spark), TREES[name]
    found = compiler.bindings(g, query)
    assert rows(counting.variable_counts(g, query)) == rows(result.variable_counts(found, query))
    assert rows(counting.total_counts(g, query)) == rows(result.total_counts(found, query))
    assert rows(counting.label_counts(g, query, ["a", "q"])) == rows(result.label_counts(found, query, ["a", "q"]))
    assert counting.match_count(g, query).first()[0] == found.count()


def test_matches_at_each_variable(spark):
    g, query = small(spark, 4), TREES["long"]
    found = compiler.bindings(g, query)
    for v in "vwxyzu":
        assert rows(counting.matches_at(g, query, v).select("id", F.col("matches").cast("long"))) == rows(found.groupBy(f"{v}__id").count())


def test_repeated_edge_rows_count_once(spark):
    g = graph(spark, {"a": [1, 2], "b": [1, 2]}, {("a", "e", "b"): [(1, 1), (1, 2), (2, 2), (2, 9)]})
    twice = type(g)(spark, {x: g.vertices(x) for x in "ab"}, {("a", "e", "b"): g.edges("a", "e", "b").unionAll(g.edges("a", "e", "b"))})
    assert rows(counting.total_counts(twice, TREES["edge"])) == [(4, 3)]
    assert counting.match_count(twice, TREES["edge"]).first()[0] == 6 == compiler.bindings(twice, TREES["edge"]).count()
    shared = type(g)(spark, {x: g.vertices(x) for x in "ab"}, {("a", "e", "b"): g.edges("a", "e", "b").withColumn("uid", F.col("uid") % 2)})
    assert rows(counting.variable_counts(shared, TREES["edge"])) == rows(result.variable_counts(compiler.bindings(shared, TREES["edge"]), TREES["edge"]))


def test_cycles_are_no_trees(spark):
    for query in (_TRIANGLE, _FOUR, q([("x", "a")], [("l", "x", "x")]), q([("x", "a"), ("y", "a")], [("l", "x", "y"), ("l", "y", "x")])):
        assert counting.trees(query) is None
    with pytest.raises(ValueError, match="cycle"):
        counting.variable_counts(small(spark), q([("x", "a")], [("l", "x", "x")]))
    loop = q([("x", "a")], [("l", "x", "x")])
    assert counting.match_count(small(spark), loop).first()[0] == compiler.bindings(small(spark), loop).count()


def test_counting_plans_have_semi_joins_and_no_expand(spark, data):
    g = star_graph(spark, data)
    for df in (counting.variable_counts(g, CHAIN), counting.total_counts(g, CHAIN), counting.label_counts(g, _TWIN, ["part"])):
        text = plan(df)
        joins = [line for line in text.splitlines() if "Join" in line]
        assert "Expand" not in text
        assert joins and all("LeftSemi" in j or "LeftAnti" in j for j in joins)  # the anti-join is of requested labels


# Generic joins ------------------------------------------------------------------------------------

CYCLES = {
    "triangle": q([("x", "a"), ("y", "b"), ("z", "c")], [("e", "x", "y"), ("f", "y", "z"), ("g", "x", "z")]),
    "four": q([("x", "a"), ("y", "b"), ("w", "a"), ("v", "b")], [("e", "x", "y"), ("e", "w", "y"), ("e", "w", "v"), ("e", "x", "v")]),
    "both ways": q([("x", "a"), ("y", "a")], [("l", "x", "y"), ("l", "y", "x")]),
    "loop": q([("x", "a"), ("y", "b")], [("l", "x", "x"), ("e", "x", "y")]),
    "anchored": q([("x", "a"), ("y", "b"), ("z", "c", "2")], [("e", "x", "y"), ("f", "y", "z"), ("g", "x", "z")]),
    "triangle and more": q([("x", "a"), ("y", "b"), ("z", "c"), ("w", "a")], [("e", "x", "y"), ("f", "y", "z"), ("g", "x", "z"), ("l", "w", "x")]),
    "two parts": q([("x", "a"), ("y", "a"), ("z", "c"), ("w", "b")], [("l", "x", "y"), ("l", "y", "x"), ("f", "w", "z")]),
    "no edges": q([("x", "a"), ("z", "c")]),
}


@pytest.mark.parametrize("name", CYCLES)
@pytest.mark.parametrize("seed", [1, 2])
def test_generic_join_finds_the_bindings(spark, name, seed):
    g, query = small(spark, seed), CYCLES[name]
    want = compiler.bindings(g, query)
    got = generic.cyclic_bindings(g, query)
    assert set(got.columns) == set(want.columns)
    assert rows(got.select(*want.columns)) == rows(want)


def test_generic_join_never_builds_the_open_path(spark):
    """A hub on one side of each vertex: the open path is quadratic, each proposal is not."""
    n = 300
    to_hub, from_hub = [(i, 0) for i in range(n)], [(0, i) for i in range(n)]
    g = graph(spark, {"t": list(range(n))}, {("t", "l", "t"): to_hub + from_hub})
    query = q([("x", "t"), ("y", "t"), ("z", "t")], [("l", "x", "y"), ("l", "y", "z"), ("l", "z", "x")])
    steps = []
    found = generic.node_bindings(g, query, steps=steps)
    largest = max(proposed.count() for _, proposed, _ in steps)
    e = g.edges("t", "l", "t").select("src", "dst").distinct()
    open_path = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").count()
    assert open_path > n * n and largest < 6 * n
    assert found.count() == compiler.bindings(g, query).select("x__id", "y__id", "z__id").distinct().count()


def test_generic_join_on_the_tables(spark, data):
    g = star_graph(spark, data)
    line = g.edges("orders", "contains", "part").select("src", "dst").distinct()
    other = line.select(F.col("src").alias("q"), "dst")
    placed = g.edges("customer", "placed", "orders").select(F.col("src").alias("c"), F.col("dst").alias("src"))
    steps = []
    generic.node_bindings(g, _FOUR, steps=steps)
    assert max(proposed.count() for _, proposed, _ in steps) < placed.join(line, "src").join(other, "dst").count()


def test_generic_join_deals_pairs_by_the_edges(spark, data, monkeypatch):
    """The tasks of pairs and confirmations follow the number of edges, and what is found doesn't depend on them."""
    g = star_graph(spark, data)
    want = rows(generic.node_bindings(g, _FOUR))
    edges = sum(g.edges(*ends).count() for ends in [("customer", "placed", "orders"), ("orders", "contains", "part")] * 2)
    monkeypatch.setattr(generic, "TASK_EDGES", edges // 23)
    own = generic.pairs(g, _FOUR, _FOUR.edges[1], "regex", edges)
    assert own.rdd.getNumPartitions() >= 23 and own.count() == own.distinct().count()
    assert rows(generic.node_bindings(g, _FOUR)) == want


def test_a_cycle_meets_at_the_ends_of_its_paths(spark, data):
    """Nothing is proposed that isn't found, and one path, dealt once, serves both sides."""
    g, steps = star_graph(spark, data), []
    found = generic.node_bindings(g, _FOUR, steps=steps)
    assert found.columns == ["c", "o", "p", "q"] and found.distinct().count() == found.count() == compiler.bindings(g, _FOUR).select("c__id", "o__id", "p__id", "q__id").distinct().count()
    assert max(proposed.count() for _, proposed, _ in steps) == found.count()
    found.collect()
    assert "ReusedExchange" in plan(found)


ODD_CYCLES = CYCLES | {
    "four, a filter": q([("x", "a", "1"), ("y", "b"), ("w", "a"), ("v", "b")], [("e", "x", "y"), ("e", "w", "y"), ("e", "w", "v"), ("e", "x", "v")]),
    "four, both filtered": q([("x", "a"), ("y", "b", "2"), ("w", "a"), ("v", "b", "3")], [("e", "x", "y"), ("e", "w", "y"), ("e", "w", "v"), ("e", "x", "v")]),
    "four kinds": q([("x", "a"), ("y", "b"), ("z", "c"), ("w", "a")], [("e", "x", "y"), ("f", "y", "z"), ("g", "w", "z"), ("l", "x", "w")]),
    "one type": q([("x", "a"), ("y", "a"), ("z", "a")], [("l", "x", "y"), ("l", "y", "z"), ("l", "z", "x")]),
}


@pytest.mark.parametrize("name", ["triangle", "four", "anchored", "four, a filter", "four, both filtered", "four kinds", "one type"])
def test_sides_of_a_cycle_find_the_matches(spark, name, monkeypatch):
    """Edges hang in the air or are parallel in these graphs; by sides, and one variable at a time."""
    g, query = small(spark, 3), ODD_CYCLES[name]
    names = generic.variable_order(query)
    want = rows(compiler.bindings(g, query).select(*[f"{v}__id" for v in names]).distinct())
    assert generic.cycle_sides(query) and generic.open_sides(g, query, 1000)
    monkeypatch.setattr(generic, "OPEN", 1000)
    assert rows(generic.node_bindings(g, query).select(*names)) == want
    monkeypatch.setattr(generic, "OPEN", 0)
    assert rows(generic.node_bindings(g, query).select(*names)) == want


@pytest.mark.parametrize("name", ["triangle", "four", "anchored", "four, a filter", "four, both filtered", "four kinds", "one type"])
def test_sides_of_a_cycle_find_the_bindings(spark, name, monkeypatch):
    """Edges, parallel ones too, and vertices, one of them there twice, bring their columns along."""
    made, query = small(spark, 3), ODD_CYCLES[name]
    named = {x: made.vertices(x).select("id", F.concat(F.lit(x), F.col("id")).alias("name")) for x in "abc"}
    g = type(made)(spark, named | {"a": named["a"].unionAll(named["a"].where("id = 1"))}, {t: made.edges(*t) for t in made.triples()})
    want = compiler.bindings(g, query)
    for most in (1000, 0):
        monkeypatch.setattr(generic, "OPEN", most)
        got = generic.cyclic_bindings(g, query)
        assert set(got.columns) == set(want.columns) and rows(got.select(*want.columns)) == rows(want)


def test_a_triangle_takes_its_edges_along(spark, data):
    """No join after the one that closes the cycle: two of lines, and one for each vertex."""
    found = generic.cyclic_bindings(star_graph(spark, data), _TRIANGLE)
    found = found.select("s__id", "o__id", "p__id", "p0__uid", "p1__uid", "p2__uid")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in text.splitlines()) == 5 and "Aggregate" not in text


def test_long_paths_and_other_patterns_have_no_open_sides(spark):
    hub = graph(spark, {"t": list(range(200))}, {("t", "l", "t"): [(i, 0) for i in range(200)] + [(0, i) for i in range(200)]})
    ring = q([("x", "t"), ("y", "t"), ("z", "t")], [("l", "x", "y"), ("l", "y", "z"), ("l", "z", "x")])
    assert generic.open_sides(hub, ring, 1200) is None
    assert not any(generic.cycle_sides(CYCLES[name]) for name in ("both ways", "loop", "triangle and more", "two parts", "no edges"))


def test_overlap_edges_are_refused(spark, data):
    with pytest.raises(ValueError, match="overlap"):
        generic.node_bindings(star_graph(spark, data), q([("a", "interval"), ("b", "interval")], [("overlaps_with", "a", "b")]))


# Hubs ---------------------------------------------------------------------------------------------


def test_hub_join_is_a_join_and_no_task_has_the_hub(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    right = spark.range(1500).select(F.when(F.col("id") < 60, 7).otherwise(F.col("id") % 400).alias("j"), (F.col("id") * 2).alias("w"))
    want = left.join(right, F.col("k") == F.col("j"))
    got = hubs.hub_join(left, right, "k", "j", chunk=50)
    assert got.columns == want.columns and rows(got) == rows(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        most = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        plain, dealt = most(left.join(right, F.col("k") == F.col("j"))), most(hubs.hub_join(left, right, "k", "j", chunk=50))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plain > 0.9 * want.where("k = 7").count() and dealt < 0.2 * plain


def test_hub_join_of_odd_tables(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 5.0), (None, 6.0), ("a", 5.0)], "j string, w double")
    want = [("a", 1, "a", 5.0)] * 4
    assert rows(hubs.hub_join(left, right, "k", "j", chunk=1)) == want == rows(hubs.hub_join(left, right, "k", "j"))
    assert hubs.hub_join(left.limit(0), right, "k", "j", chunk=1).count() == 0 == hubs.hub_join(left, right.limit(0), "k", "j", chunk=1).count()
    assert {r.key for r in hubs.frequent_keys(left, "k", 2).collect()} == {"a"}


def test_patterns_over_hubs(spark):
    g, query = small(spark, 3), TREES["star"]
    assert rows(compiler.bindings(g, query, hub_rows=1)) == rows(compiler.bindings(g, query))


# Closure ------------------------------------------------------------------------------------------


def reached(edges, depth=None):
    found = {}
    for start in {a for a, _ in edges}:
        now, d = {start}, 0
        while now and (depth is None or d < depth):
            d += 1
            now = {b for a, b in edges if a in now and (start, b) not in found}
            for b in now:
                found[start, b] = d
    return sorted((a, b, d) for (a, b), d in found.items())


@pytest.mark.parametrize("seed", range(3))
def test_closure_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(12), r.randrange(12)) for _ in range(14)] + [(20 + i, 21 + i) for i in range(9)] + [(5, 5)]
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "child long, parent long")
    for depth in (0, 1, 2, 3, None):
        assert rows(closure.closure(df, depth=depth)) == (reached(edges, depth) if depth != 0 else [])
    starts = spark.createDataFrame([(edges[0][0],), (20,), (99,)], "x long")
    for depth in (2, None):
        assert rows(closure.closure(df, depth=depth, starts=starts)) == [t for t in reached(edges, depth) if t[0] in (edges[0][0], 20)]
    nodes = {x for e in edges for x in e}
    assert rows(closure.closure(df, reflexive=True)) == sorted([t for t in reached(edges) if t[0] != t[1]] + [(x, x, 0) for x in nodes])


def test_closure_of_nothing(spark):
    none = spark.createDataFrame([], "child long, parent long")
    assert closure.closure(none).count() == closure.closure(none, depth=3).count() == closure.closure(none, reflexive=True).count() == 0
    with pytest.raises(ValueError):
        closure.closure(none, depth=-1)


def test_tasks_of_a_closure_follow_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "child long, parent long")
    for depth, pairs in ((None, 1830), (9, 504)):
        found = closure.closure(chain, depth=depth)
        assert found.count() == pairs and len(found.inputFiles()) > pairs / 50


def test_rolled_up_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "child long, parent long")
    found = closure.rolled_up(spark.createDataFrame([("m", 0), ("n", 30), ("o", 50)], "member string, term long"), chain)
    assert found.count() == 61 + 31 + 11
    assert plan(found).count("REPARTITION_BY_NUM") == 3


def test_rolled_up_terms(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "child string, parent string")
    members = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "x"), ("n", None), ("o", "z")], "member string, term string")
    assert rows(closure.rolled_up(members, up)) == [("m", "a", 0), ("m", "b", 0), ("m", "c", 1), ("n", "c", 1), ("n", "x", 0), ("o", "z", 0)]
    assert ("m", "c", 1) in rows(closure.rolled_up(members, up, depth=1))


# Overlap ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kinds", [("short", "short"), ("short", "long"), ("long", "short"), ("long", "long"), ("mixed", "mixed")])
def test_overlap_candidates(spark, kinds):
    """Pairs that share a bin's key against the pairs that overlap: two short intervals never meet in a wide bin."""
    r = random.Random(str(kinds))

    def side(x, kind):
        made = []
        for i in range(250):
            start = r.randrange(0, 60_000)
            length = r.randrange(1, 150) if kind == "short" or kind == "mixed" and i % 5 else r.randrange(6_500, 20_000)
            made.append((i, "c", start, start + length))
        return spark.createDataFrame(made, f"{x}__id long, {x}__chr string, {x}__start long, {x}__end long")

    a, b = side("a", kinds[0]), side("b", kinds[1])
    both = overlap_join(a, b, "a", "b", width=100)
    assert rows(both.select("a__id", "b__id")) == rows(overlap_join_plain(a, b, "a", "b").select("a__id", "b__id"))
    assert both.count() == both.distinct().count()
    if kinds == ("short", "short"):
        met = both._jdf.queryExecution().optimizedPlan().toString()
        assert "meet" in met
        narrow = lambda f, x: f.select(F.explode(F.sequence(F.floor(F.col(f"{x}__start") / 100), F.floor((F.col(f"{x}__end") - 1) / 100))).alias("bin"))
        assert narrow(a, "a").join(narrow(b, "b"), "bin").count() < 20 * both.count()


def test_optional_nodes_broadcast_nothing_large(spark, data):
    g = star_graph(spark, data)
    df = compiler.optional_nodes(g, q([("r", "region"), ("c", "customer", "", {"name": "nobody"})]))
    assert df.count() == 5 and df.where("c__id IS NULL").count() == 5
    assert rows(compiler.optional_nodes(g, q([("c", "customer", "-1")])).select("c__id")) == [(None,)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastNestedLoopJoin BuildRight, LeftOuter" not in plan(compiler.optional_nodes(g, q([("c", "customer")])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_new_end_is_filtered_before_the_fan_out(spark, data):
    """The last join is of two joins: the edges have met their filtered new end before they meet the matches so far."""
    top = compiler.bindings(star_graph(spark, data), _TWIN)._jdf.queryExecution().analyzed()
    assert top.nodeName() == "Join" and [top.children().apply(i).nodeName() for i in range(2)] == ["Join", "Join"]
