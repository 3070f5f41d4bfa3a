"""Predicates, patterns, result shaping and graph algebra on small hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.functions import text
from loomgraph.operators import algebra, history, result
from loomgraph.operators.components import connected_components
from loomgraph.operators.overlap import overlap_join, overlap_join_plain
from loomgraph.plans import compiler
from loomgraph.plans.model import QueryGraph
from loomgraph.sources.catalog import GraphCatalog, for_species


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def q(nodes, edges=()):
    return QueryGraph.of({"nodes": [{"node_id": n[0], "type": n[1], "id": n[2] if len(n) > 2 else "", "properties": n[3] if len(n) > 3 else {}} for n in nodes], "predicates": [{"type": e[0], "source": e[1], "target": e[2]} for e in edges]})


def graph(spark, vertices, edges):
    v = {k: spark.createDataFrame([(x,) if isinstance(x, int) else x for x in ids], "id long" if isinstance(ids[0], int) else "id long, name string") for k, ids in vertices.items()}
    e = {k: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, uid long") for k, pairs in edges.items()}
    return GraphCatalog(spark, v, e)


def test_regex_matches_whole_values_in_any_case(spark):
    df = spark.createDataFrame([("LAMP2",), ("LAMP20",), ("lamp2",), (None,)], "n string")
    assert rows(df.where(P.regex_full(F.col("n"), "lamp2"))) == [("LAMP2",), ("lamp2",)]
    assert rows(df.where(P.regex_full(F.col("n"), "lamp.*|x"))) == [("LAMP2",), ("LAMP20",), ("lamp2",)]
    assert rows(spark.createDataFrame([("ab",), ("ab\n",)], "n string").where(P.regex_full(F.col("n"), "a.|x"))) == [("ab",)]


def test_filters_reach_the_scan(spark, data):
    v = {"c": spark.read.parquet(f"{data}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("start"), (F.col("c_custkey") + 5).alias("end"), F.col("c_nationkey").alias("nation"))}
    g = GraphCatalog(spark, v, {})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in plan(compiler.bindings(g, q([("a", "c", "42")])))
    assert "EqualTo(c_nationkey,7)" in plan(compiler.bindings(g, q([("a", "c", "", {"nation": "7"})]), matching="exact"))
    assert compiler.bindings(g, q([("a", "c", "042")])).count() == compiler.bindings(g, q([("a", "c", "x1")])).count() == 0
    assert rows(spark.createDataFrame([("9007199254740993",)], "v string").select(P.to_integer(F.col("v")))) == [(9007199254740993,)]


def test_missing_properties_and_other_types_match_nothing(spark):
    g = graph(spark, {"t": [(1, "x"), (2, None)]}, {("t", "e", "t"): [(1, 2)]})
    for props in ({"other": "x"}, {"start": 1, "end": 2}):
        assert compiler.bindings(g, q([("a", "t", "", props)])).count() == 0
    assert compiler.bindings(g, q([("a", "t", "", {"other": None})]), matching="exact").count() == 2
    numbers = GraphCatalog(spark, {"n": spark.createDataFrame([(1, 7)], "id long, size int")}, {})
    assert compiler.bindings(numbers, q([("a", "n", "", {"size": "seven"})]), matching="exact").count() == 0
    assert compiler.bindings(numbers, q([("a", "n", "", {"size": "7"})]), matching="exact").count() == 1


def test_semi_join_plans_grow_with_the_predicates_only(spark):
    n = 5
    g = graph(spark, {f"t{i}": [1, 2] for i in range(n + 1)}, {(f"t{i}", "e", f"t{i + 1}"): [(1, 1), (2, 2)] for i in range(n)})
    scans = []
    for m in range(1, n + 1):
        chain = q([(f"v{i}", f"t{i}") for i in range(m + 1)], [("e", f"v{i}", f"v{i + 1}") for i in range(m)])
        plan = compiler.semijoin_edges(g, chain)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("LogicalRDD"))
    assert max(b - a for a, b in zip(scans, scans[1:], strict=False)) <= 6 and scans[-1] <= 30


def test_long_and_short_intervals_meet_in_two_widths(spark):
    import random

    rnd = random.Random(3)
    data = [(i, rnd.choice("ab"), s, s + rnd.choice((1, 30, 5_000, 200_000))) for i in range(80) for s in [rnd.randint(-50_000, 300_000)]]
    v = spark.createDataFrame(data, "id long, chr string, start long, end long")
    side = lambda x: v.select(*[F.col(c).alias(f"{x}__{c}") for c in v.columns])
    want = rows(overlap_join_plain(side("a"), side("b"), "a", "b").select("a__id", "b__id"))
    assert rows(overlap_join(side("a"), side("b"), "a", "b", width=64).select("a__id", "b__id")) == want


def test_data_sources_and_species(spark):
    e = spark.createDataFrame([(1, 2, 1, "A"), (1, 3, 2, "B")], "src long, dst long, uid long, source string")
    g = GraphCatalog(spark, {"t": spark.createDataFrame([(1,), (2,), (3,)], "id long")}, {("t", "e", "t"): e})
    assert g.of_sources(["B"]).edges("t", "e", "t").count() == 1 and g.of_sources(["B"]).vertices("t").count() == 3
    assert for_species({"fly": g}, "fly") is g
    with pytest.raises(ValueError, match="no graph of 'human'"):
        for_species({"fly": g}, "human")


@pytest.mark.parametrize(("kind", "distance", "want"), [("within", 0, "a"), ("intersects", 0, "abe"), ("upstream", 0, "c"), ("downstream", 0, "de"), ("upstream", 20, ""), ("downstream", 20, "")])
def test_interval_kinds(spark, kind, distance, want):
    df = spark.createDataFrame([("a", "110", "190"), ("b", "90", "110"), ("c", "50", "90"), ("d", "210", "260"), ("e", "200", "300")], "k string, start string, end string")
    props = {"start": 100, "end": 200, "interval_type": kind, "upstream_distance": distance, "downstream_distance": distance}
    assert "".join(r[0] for r in rows(df.where(P.interval(props, F.col("start"), F.col("end"))))) == want
    assert P.interval({"start": 100}, F.col("start"), F.col("end")) is None


def test_to_integer(spark):
    df = spark.createDataFrame([("12",), ("12.7",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(P.to_integer(F.col("v"))).collect()] == [12, 12, None, None]


def test_overlaps_are_half_open_and_bins_agree(spark):
    data = [(1, "1", 10, 20), (2, "1", 20, 30), (3, "1", 10, 21), (4, "2", 10, 30), (5, "1", 15, 15), (6, "1", 0, 5000), (7, None, 0, 9), (8, "1", None, 9)]
    v = spark.createDataFrame(data, "id long, chr string, start long, end long")
    side = lambda x: v.select(*[F.col(c).alias(f"{x}__{c}") for c in v.columns])
    plain = rows(overlap_join_plain(side("a"), side("b"), "a", "b").select("a__id", "b__id"))
    assert (1, 2) not in plain and (2, 3) in plain and (1, 4) not in plain and (1, 5) in plain
    for width in (1, 7, 4096):
        assert rows(overlap_join(side("a"), side("b"), "a", "b", width=width).select("a__id", "b__id")) == plain


def test_a_vertex_in_two_variables_counts_twice(spark):
    g = graph(spark, {"t": [1]}, {("t", "e", "t"): [(1, 1)]})
    pattern = q([("a", "t"), ("b", "t")], [("e", "a", "b")])
    found = compiler.bindings(g, pattern)
    assert rows(result.total_counts(found, pattern)) == [(2, 1)]
    assert rows(result.total_counts(found, pattern, distinct_entities=True)) == [(1, 1)]


def test_one_edge_may_match_twice_unless_isomorphic(spark):
    g = graph(spark, {"t": [1, 2]}, {("t", "e", "t"): [(1, 2)]})
    pattern = q([("a", "t"), ("b", "t"), ("c", "t")], [("e", "a", "b"), ("e", "c", "b")])
    assert compiler.bindings(g, pattern).count() == 1
    assert compiler.bindings(g, pattern, isomorphic=True).count() == 0


def test_self_loops_cycles_and_limits(spark):
    g = graph(spark, {"t": [1, 2, 3]}, {("t", "e", "t"): [(1, 1), (1, 2), (2, 3), (3, 1)]})
    assert rows(compiler.bindings(g, q([("a", "t")], [("e", "a", "a")])).select("a__id")) == [(1,)]
    cycle = q([("a", "t"), ("b", "t"), ("c", "t")], [("e", "a", "b"), ("e", "b", "c"), ("e", "c", "a")])
    assert rows(compiler.bindings(g, cycle).select("a__id", "b__id", "c__id")) == [(1, 1, 1), (1, 2, 3), (2, 3, 1), (3, 1, 2)]
    assert rows(compiler.bindings(g, cycle, limit=2).select("a__id")) == [(1,), (1,)]


def test_parallel_edges_show_once(spark):
    g = graph(spark, {"t": [1, 2]}, {("t", "e", "t"): [(1, 2), (1, 2)]})
    pattern = q([("a", "t"), ("b", "t")], [("e", "a", "b")])
    found = compiler.bindings(g, pattern)
    assert found.count() == 2 and result.shape_edges(found, pattern).count() == 1
    assert rows(result.variable_counts(found, pattern).where("kind = 'edge'").select("count")) == [(2,)]


def test_an_id_stands_alone(spark):
    g = graph(spark, {"t": [(1, "x"), (2, "y")]}, {})
    assert rows(compiler.bindings(g, q([("a", "t", "1", {"name": "nobody"})])).select("a__id")) == [(1,)]


def test_optional_nodes(spark):
    g = graph(spark, {"a": [1, 2], "b": [(1, "x")]}, {})
    assert rows(compiler.optional_nodes(g, q([("x", "a"), ("y", "b", "", {"name": "none"})])).select("x__id", "y__id")) == [(1, None), (2, None)]


def test_dangling_edges_go_only_in_full_mode(spark):
    g = graph(spark, {"u": [1, 2], "v": [1, 2], "w": [1]}, {("u", "e", "v"): [(1, 1), (2, 2)], ("v", "f", "w"): [(1, 1)]})
    pattern = q([("a", "u"), ("b", "v"), ("c", "w")], [("e", "a", "b"), ("f", "b", "c")])
    assert rows(compiler.semijoin_edges(g, pattern, mode="forward")) == [("p0", "1", "1"), ("p0", "2", "2"), ("p1", "1", "1")]
    assert rows(compiler.semijoin_edges(g, pattern)) == [("p0", "1", "1"), ("p1", "1", "1")]


def test_enrichment_keeps_what_lacks_a_property(spark):
    g = graph(spark, {"t": [(1, "x"), (2, None)]}, {})
    assert rows(result.enrich(spark.createDataFrame([(1,), (2,), (2,)], "id long"), g, "t")) == [(1, "x"), (2, None)]


def test_label_rollup_has_zeros(spark):
    g = graph(spark, {"t": [1, 2, 3]}, {("t", "e", "t"): [(1, 2), (1, 3)]})
    pattern = q([("a", "t"), ("b", "t")], [("e", "a", "b")])
    assert rows(result.label_counts(compiler.bindings(g, pattern), pattern, ["t", "z"])) == [("edge", "e", 2), ("node", "t", 3), ("node", "z", 0)]


def plain(spark, ids, edges):
    nodes = spark.createDataFrame([(i, i.split()[0], i) for i in ids], "id string, type string, name string")
    return nodes, spark.createDataFrame([(f"{a.split()[0]}_{e}_{b.split()[0]}", e, a, b) for a, e, b in edges], "edge_id string, label string, source string, target string")


def test_collapse_keeps_labels_apart(spark):
    nodes, edges = plain(spark, ["t h", "t x", "t y", "a 1", "b 1"], [("t h", "e", "t x"), ("t h", "e", "t y")])
    groups, between, members = algebra.collapse(nodes, edges)
    assert members.count() == 5
    assert rows(groups.select("name", "n")) == [("2 t nodes", 2), ("a 1", 1), ("b 1", 1), ("t h", 1)]
    assert between.count() == 1


def test_parents_and_back(spark):
    ids = ["t h1", "t h2", "t x", "t y", "t z"]
    nodes, edges = plain(spark, ids, [("t h1", "e", x) for x in ("t x", "t y", "t z")] + [("t h2", "e", x) for x in ("t x", "t y")])
    children, parents, regrouped = algebra.group_parents(nodes, edges)
    named = {r.parent: r.owner for r in parents.collect()}
    assert sorted((named[r.parent], r.child) for r in children.collect()) == [("t h1", "t x"), ("t h1", "t y"), ("t h1", "t z"), ("t x", "t h1"), ("t x", "t h2")]
    assert rows(regrouped.where("source = 't h2'").select("target")) == [("t y",)]
    assert regrouped.count() == 3
    assert {(r.source, r.target) for r in algebra.break_grouping(children, regrouped).collect()} >= {("t h1", "t x"), ("t h1", "t y"), ("t h1", "t z"), ("t h2", "t x"), ("t h2", "t y")}


def test_locations(spark):
    nodes = spark.createDataFrame([("p 1", "p", "one", "a, b"), ("p 2", "p", "two", "c"), ("p 3", "p", "three", None)], "id string, type string, name string, location string")
    out, alias = algebra.by_location(nodes)
    assert rows(out.where("main").select("id", "location").fillna("")) == [("p 1_loc_0", "a"), ("p 2", "c"), ("p 3", "")]
    assert rows(alias.select("source", "target")) == [("p 1_loc_1", "p 1_loc_0")]


def test_merge_policies_and_reverse_edges(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, name string")
    b = spark.createDataFrame([("1", "z"), ("3", "w")], "id string, name string")
    assert rows(algebra.merge_nodes(a, b)) == [("1", "both", True, "x"), ("2", "G1", False, "y"), ("3", "G2", False, "w")]
    assert rows(algebra.merge_nodes(a, b, "prefer_G2"))[0] == ("1", "both", True, "z")
    _, one = plain(spark, ["t u"], [("t u", "e", "t v")])
    _, two = plain(spark, ["t u"], [("t v", "e", "t u")])
    assert rows(algebra.reverse_pairs(one, two)) == [("t u", "t v")]
    assert rows(algebra.diff(*plain(spark, ["t u"], [("t u", "e", "t v")]), *plain(spark, ["t v"], [("t u", "f", "t v")])))[0] == ("edge", "added", "t u|t v|f")


def test_limit_is_greedy_by_whole_stars(spark):
    nodes, edges = plain(spark, ["t a", "t b", "t c", "t z"], [("t a", "e", "t 1"), ("t a", "e", "t 2"), ("t a", "e", "t 3"), ("t b", "e", "t c")])
    kept, held = algebra.limit_graph(nodes, edges, 3)
    assert rows(kept.select("id")) == [("t b",), ("t c",), ("t z",)] and rows(held.select("source", "target")) == [("t b", "t c")]


def test_shapes_of_different_graphs_differ(spark):
    line = plain(spark, ["t a", "t b", "t c"], [("t a", "e", "t b"), ("t b", "e", "t c")])
    same = plain(spark, ["t p", "t q", "t r"], [("t q", "e", "t r"), ("t p", "e", "t q")])
    star = plain(spark, ["t a", "t b", "t c"], [("t a", "e", "t b"), ("t a", "e", "t c")])
    assert algebra.maybe_isomorphic(*line, *same) and not algebra.maybe_isomorphic(*line, *star)


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, None), (200, 201), (200, 201), (201, 200)]
    got = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(999,), (1000,), (60_000,), (3_600_000,), (None,)], "ms long")
    assert [r[0] for r in df.select(text.duration_text(F.col("ms"))).collect()] == ["999 ms", "1.00 sec", "1.00 min", "1.00 hr", None]
    pattern = q([("g", "gene", "", {"gene_name": "igf1"}), ("t", "pathway")], [("child_of", "g", "t")])
    assert text.title(pattern) == "Igf1 child of a Pathway"
    assert text.title(q([("g", "gene")])) == "Selection: Unnamed Gene"
    assert text.title(q([("a", "snp"), ("b", "snp")], [("in_ld_with", "a", "b")])) == "A SNP in ld with another SNP"
    assert text.title(q([("a", "gene", "", {"gene_name": "igf1"}), ("b", "tad", "", {})], [("in_tad_region", "a", "b")])) == "Igf1 in tad region"
    assert text.title(q([("a", "pathway"), ("b", "gene", "", {"gene_name": ["tp53"]})], [("includes", "a", "b")])) == "A Pathway includes Tp53"
    assert text.title(q([("a", "snp", "", {"chr": "7"}), ("b", "gene", "", {"gene_name": "x"})], [("near", "a", "b")]), generic=["chr", "gene_name"]) == "Chromosome 7 near X"
    assert text.batches(["a", "b", "c"], [5, 5, 20], 10) == [["a", "b"], ["c"]]
    assert spark.range(1).select(text.middle(F.lit("a_b_c_d"))).first()[0] == "b_c"


def test_history(spark):
    df = spark.createDataFrame([(1, "u", ["v"], "f", "COMPLETE"), (2, "w", ["u"], "f", "COMPLETE"), (3, "x", None, "g", "PENDING")], "id long, user_id string, participants array<string>, fingerprint string, status string")
    assert rows(df.where(history.may_see("u")).select("id")) == [(1,), (2,)]
    assert rows(history.page(df, "id", 2, 2).select("id")) == [(1,)]
    assert rows(history.reusable(df).select("id")) == [(1,)]
    assert history.with_participant(df, "z").where("id = 3").first().participants == ["z"]


def test_localised_part_of_a_grouped_graph(spark):
    nodes, edges = plain(spark, ["protein a", "protein b", "protein c", "gene g"], [("protein a", "e", "protein b"), ("protein a", "e", "protein c"), ("gene g", "f", "protein a")])
    children, _, grouped = algebra.group_parents(nodes, edges)
    places = spark.createDataFrame([("protein a", "T1"), ("protein b", "T2"), ("protein b", "T3")], "member string, term string")
    parents = spark.createDataFrame([("T2", "T0"), ("T3", "T1")], "child string, parent string")
    where, inside = algebra.localised(grouped, children, places, parents)
    assert sorted((r.id, r.location or "") for r in where.collect()) == [("protein a", "T1"), ("protein b", "T0,T1"), ("protein c", "")]
    assert rows(inside.select("source", "target")) == [("protein a", "protein b"), ("protein a", "protein c")]


def test_edges_known_once_are_not_told_apart_again(spark):
    nodes = spark.createDataFrame([(x, "p") for x in "abcd"], "id string, place string")
    edges = spark.createDataFrame([("e", "a", "c"), ("e", "b", "c"), ("f", "a", "c"), ("e", "c", "c"), ("e", "c", "a"), ("e", "c", "b"), ("f", "b", "c")], "edge_id string, source string, target string")
    plain, once = (algebra._signed(nodes, edges, ["place"], once=x) for x in (False, True))
    assert rows(plain) == rows(once) and len({r.group_id for r in once.collect() if r.id in "ab"}) == 1
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id")
    assert shuffles(once) < shuffles(plain)


def test_no_distinct_of_the_edges_before_a_location_collapses(spark, monkeypatch):
    told, signed = [], algebra._signed
    monkeypatch.setattr(algebra, "_signed", lambda *a, **k: told.append(k) or signed(*a, **k))
    nodes = spark.createDataFrame([("a", "t", "A", "x,y"), ("b", "t", "B", "x")], "id string, type string, name string, location string")
    edges = spark.createDataFrame([("e", "l", "a", "b"), ("e", "l", "a", "b")], "edge_id string, label string, source string, target string")
    assert algebra.collapse_location(nodes, edges)[1].count() == 2
    assert told == [{"once": True}]
