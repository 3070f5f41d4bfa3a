"""Registered queries of the graph operators over the star-schema graph, each with its oracle SQL.

Results hold integers and strings, so both engines agree to the bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import bags, predicates, text
from loomgraph.operators import algebra, closure, history, hubs, isomorphism, result, statistics
from loomgraph.operators.overlap import overlap_join
from loomgraph.plans import answer, compiler, counting, generic
from loomgraph.plans.model import QueryGraph
from loomgraph.plans.rewrite import canonical, fingerprint, names_from_ids
from loomgraph.session import shared_path, table
from loomgraph.sources import compiled, completion, files, schema, scripts, sexpr, snapshots, trees
from loomgraph.sources.catalog import GraphCatalog
from loomgraph.testbed import star_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def pattern(nodes: list[tuple], edges: list[tuple] = ()) -> QueryGraph:
    """``(variable, type[, id or properties])`` and ``(type, source, target[, properties])``."""
    return QueryGraph.of({
        "nodes": [{"node_id": n[0], "type": n[1], "id": n[2] if len(n) > 2 and isinstance(n[2], str) else "", "properties": n[2] if len(n) > 2 and isinstance(n[2], dict) else {}} for n in nodes],
        "predicates": [{"type": e[0], "source": e[1], "target": e[2], "properties": e[3] if len(e) > 3 else {}} for e in edges],
    })


def ids(frame: DataFrame, *variables: str) -> DataFrame:
    return frame.select(*[F.col(f"{v}__id").alias(v) for v in variables])


#: customers of a market segment, their orders, the parts of one brand in them.
CHAIN = pattern([("c", "customer", {"mktsegment": "building"}), ("o", "orders"), ("p", "part", {"brand": "brand#13"})], [("placed", "c", "o"), ("contains", "o", "p")])
_CHAIN = """customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
    WHERE lower(c.c_mktsegment) = 'building' AND lower(p.p_brand) = 'brand#13'"""
_UID = "l.l_orderkey * 16 + l.l_linenumber"
#: customers and suppliers in nations in regions: the graph that the algebra works on.
_PLACE_NODES = """SELECT 'region ' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region UNION ALL SELECT 'nation ' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'customer ' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'supplier ' || s_suppkey, 'supplier', s_name FROM supplier"""
_PLACE_EDGES = """SELECT 'nation_in_region_region' AS edge_id, 'in_region' AS label, 'nation ' || n_nationkey AS source, 'region ' || n_regionkey AS target FROM nation
    UNION ALL SELECT 'customer_in_nation_nation', 'in_nation', 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer
    UNION ALL SELECT 'supplier_in_nation_nation', 'in_nation', 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier"""
_BITS = "sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(d, 16, 15))::BIGINT)::VARCHAR"
_SIGNED = f"""n AS ({_PLACE_NODES}), e AS ({_PLACE_EDGES}),
    i AS (SELECT DISTINCT id, sha256(concat_ws('|', way, edge_id, other)) AS d FROM (SELECT source AS id, 'out' AS way, edge_id, target AS other FROM e UNION ALL SELECT target, 'in', edge_id, source FROM e)),
    s AS (SELECT id, count(*) || ':' || {_BITS} AS signature FROM i GROUP BY id),
    g AS (SELECT n.*, sha256(concat_ws('|', type, coalesce(signature, ''))) AS group_id FROM n LEFT JOIN s USING (id))"""


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = star_graph(spark, sf_dir)
    nodes = [g.vertices(x).select(result.key(x, F.col("id")).alias("id"), F.lit(x).alias("type"), "name") for x in ("region", "nation", "customer", "supplier")]
    edges = [g.edges(*t).select(F.lit("_".join(t)).alias("edge_id"), F.lit(t[1]).alias("label"), result.key(t[0], F.col("src")).alias("source"), result.key(t[2], F.col("dst")).alias("target")) for t in (("nation", "in_region", "region"), ("customer", "in_nation", "nation"), ("supplier", "in_nation", "nation"))]
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).unionByName(nodes[3]), edges[0].unionByName(edges[1]).unionByName(edges[2])


# Scans and filters --------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS mktsegment FROM customer")
def scan_label(spark, d):
    return star_graph(spark, d).vertices("customer").select("id", "name", "mktsegment")


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey = 42")
def scan_anchor(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("c", "customer", "42")])), "c")


@query("SELECT c_custkey AS c FROM customer WHERE regexp_full_match(c_mktsegment, '(?i)b.*|MACH.*')")
def filter_regex_ci(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("c", "customer", {"mktsegment": "b.*|MACH.*"})])), "c")


@query("SELECT p_partkey AS p FROM part WHERE p_brand = 'Brand#13' AND p_size = 7")
def filter_exact(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("p", "part", {"brand": "Brand#13", "size": 7})]), matching="exact"), "p")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_in_list(spark, d):
    g = star_graph(spark, d)
    wanted = g.vertices("customer").where("acctbal < 0").select(F.col("id").alias("src"))
    return g.edges("customer", "placed", "orders").join(wanted, "src", "left_semi").select(F.col("dst").alias("id"))


@query(f"SELECT o_orderkey AS o, p_partkey AS p, {_UID} AS uid FROM orders JOIN lineitem l ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def filter_edge_prop(spark, d):
    found = compiler.bindings(star_graph(spark, d), pattern([("o", "orders"), ("p", "part")], [("contains", "o", "p", {"returnflag": "R"})]))
    return found.select(F.col("o__id").alias("o"), F.col("p__id").alias("p"), F.col("p0__uid").alias("uid"))


_INTERVALS = "(SELECT event_id AS id, event_type AS chr, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS s, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) + floor(value)::BIGINT * 20 AS e FROM events) i"


def _interval(kind: str, **more):
    def run(spark, d):
        g = star_graph(spark, d)
        lo, hi = g.vertices("interval").agg(F.min("start"), F.max("start")).first()
        a, b = lo + (hi - lo) // 3, lo + 2 * (hi - lo) // 3
        return ids(compiler.bindings(g, pattern([("i", "interval", {"chr": "click", "start": a, "end": b, "interval_type": kind, **more})])), "i")

    return run


for _kind, _more, _sql in (("within", {}, "s >= a AND e <= b"), ("intersects", {}, "e >= a AND s <= b"), ("upstream", {"upstream_distance": 5000}, "e <= a - 5000"), ("downstream", {"downstream_distance": 5000}, "s >= b + 5000")):
    QUERIES[f"interval_{_kind}"] = _interval(_kind, **_more)
    ORACLE_SQL[f"interval_{_kind}"] = f"WITH i AS (SELECT * FROM {_INTERVALS}), r AS (SELECT min(s) + (max(s) - min(s)) // 3 AS a, min(s) + 2 * (max(s) - min(s)) // 3 AS b FROM i) SELECT id AS i FROM i, r WHERE lower(chr) = 'click' AND {_sql}"


@query("SELECT event_id AS id, trunc(try_cast(value::VARCHAR AS DOUBLE))::BIGINT AS whole, trunc(try_cast(event_type AS DOUBLE))::BIGINT AS none FROM events")
def to_integer(spark, d):
    e = star_graph(spark, d).vertices("event")
    return e.select("id", predicates.to_integer(F.col("value").cast("string")).alias("whole"), predicates.to_integer(F.col("event_type")).alias("none"))


# Patterns -----------------------------------------------------------------------------------------


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'building'")
def match_one_hop(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("c", "customer", {"mktsegment": "building"}), ("o", "orders")], [("placed", "c", "o")])), "c", "o")


@query(f"SELECT c.c_custkey AS c, o.o_orderkey AS o, p.p_partkey AS p, {_UID} AS uid FROM {_CHAIN}")
def match_two_hop(spark, d):
    found = compiler.bindings(star_graph(spark, d), CHAIN)
    return found.select(F.col("c__id").alias("c"), F.col("o__id").alias("o"), F.col("p__id").alias("p"), F.col("p1__uid").alias("uid"))


@query(f"SELECT DISTINCT 'customer_placed_orders' AS edge_id, 'placed' AS label, 'customer ' || c.c_custkey AS source, 'orders ' || o.o_orderkey AS target FROM {_CHAIN} UNION SELECT 'orders_contains_part', 'contains', 'orders ' || o.o_orderkey, 'part ' || p.p_partkey FROM {_CHAIN}")
def shape_edges(spark, d):
    return result.shape_edges(compiler.bindings(star_graph(spark, d), CHAIN), CHAIN)


@query(f"SELECT DISTINCT 'customer ' || c.c_custkey AS id, 'customer' AS type, c.c_name AS name FROM {_CHAIN} UNION SELECT 'orders ' || o.o_orderkey, 'orders', 'orders ' || o.o_orderkey FROM {_CHAIN} UNION SELECT 'part ' || p.p_partkey, 'part', p.p_name FROM {_CHAIN}")
def shape_nodes(spark, d):
    return result.shape_nodes(compiler.bindings(star_graph(spark, d), CHAIN), CHAIN)


@query(f"SELECT 'orders_contains_part' AS edge_id, 'orders ' || o_orderkey AS source, 'part ' || p_partkey AS target, arg_min(l_quantity, ({_UID}, l_quantity, l_extendedprice, l_discount, l_returnflag))::BIGINT AS quantity, arg_min(l_returnflag, ({_UID}, l_quantity, l_extendedprice, l_discount, l_returnflag)) AS returnflag FROM orders JOIN lineitem l ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def edge_properties(spark, d):
    q = pattern([("o", "orders"), ("p", "part")], [("contains", "o", "p")])
    return result.edge_properties(compiler.bindings(star_graph(spark, d), q), q, "p0").select("edge_id", "source", "target", F.col("quantity").cast("long").alias("quantity"), "returnflag")


_BRANCH = pattern([("c", "customer"), ("n", "nation"), ("r", "region", {"name": "asia|europe"}), ("o", "orders", {"priority": "1-urgent"})], [("placed", "c", "o"), ("in_nation", "c", "n"), ("in_region", "n", "r")])


@query("SELECT c_custkey AS c, n_nationkey::BIGINT AS n, r_regionkey::BIGINT AS r, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE regexp_full_match(r_name, '(?i)asia|europe') AND lower(o_orderpriority) = '1-urgent'")
def match_branch(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), _BRANCH), "c", "n", "r", "o")


@query(f"SELECT s_suppkey AS s, o_orderkey AS o, p_partkey AS p, a.l_orderkey * 16 + a.l_linenumber AS supplied, {_UID} AS contained, b.l_orderkey * 16 + b.l_linenumber AS shipped FROM supplier JOIN lineitem a ON a.l_suppkey = s_suppkey JOIN lineitem l ON l.l_partkey = a.l_partkey JOIN lineitem b ON b.l_suppkey = s_suppkey AND b.l_orderkey = l.l_orderkey JOIN orders ON o_orderkey = l.l_orderkey JOIN part ON p_partkey = l.l_partkey WHERE s_suppkey = 3")
def match_cycle(spark, d):
    q = pattern([("s", "supplier", "3"), ("o", "orders"), ("p", "part")], [("supplies", "s", "p"), ("contains", "o", "p"), ("ships", "s", "o")])
    found = compiler.bindings(star_graph(spark, d), q)
    return found.select(F.col("s__id").alias("s"), F.col("o__id").alias("o"), F.col("p__id").alias("p"), F.col("p0__uid").alias("supplied"), F.col("p1__uid").alias("contained"), F.col("p2__uid").alias("shipped"))


#: suppliers of a part that is in an order which they ship too: no end is anchored.
_TRIANGLE = pattern([("s", "supplier"), ("o", "orders"), ("p", "part")], [("supplies", "s", "p"), ("contains", "o", "p"), ("ships", "s", "o")])
#: customers who have one part in two orders.
_FOUR = pattern([("c", "customer"), ("o", "orders"), ("p", "part"), ("q", "orders")], [("placed", "c", "o"), ("contains", "o", "p"), ("placed", "c", "q"), ("contains", "q", "p")])


@query(f"SELECT a.l_suppkey AS s, l.l_orderkey AS o, l.l_partkey AS p, a.l_orderkey * 16 + a.l_linenumber AS supplied, {_UID} AS contained, b.l_orderkey * 16 + b.l_linenumber AS shipped FROM lineitem a JOIN lineitem l ON l.l_partkey = a.l_partkey JOIN lineitem b ON b.l_suppkey = a.l_suppkey AND b.l_orderkey = l.l_orderkey JOIN orders ON o_orderkey = l.l_orderkey JOIN part ON p_partkey = l.l_partkey JOIN supplier ON s_suppkey = a.l_suppkey")
def match_triangle(spark, d):
    found = generic.cyclic_bindings(star_graph(spark, d), _TRIANGLE)
    return found.select(F.col("s__id").alias("s"), F.col("o__id").alias("o"), F.col("p__id").alias("p"), F.col("p0__uid").alias("supplied"), F.col("p1__uid").alias("contained"), F.col("p2__uid").alias("shipped"))


@query("SELECT DISTINCT c_custkey AS c, a.o_orderkey AS o, l.l_partkey AS p, b.o_orderkey AS q FROM customer JOIN orders a ON a.o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = a.o_orderkey JOIN part ON p_partkey = l.l_partkey JOIN orders b ON b.o_custkey = c_custkey JOIN lineitem m ON m.l_orderkey = b.o_orderkey AND m.l_partkey = l.l_partkey")
def match_four_cycle(spark, d):
    return generic.node_bindings(star_graph(spark, d), _FOUR).select("c", "o", "p", "q")


#: lines of an order's first two go to one supplier, which so has half of all rows.
_HUB = "CASE WHEN l_linenumber <= 2 THEN 1 ELSE l_suppkey END"


@query(f"SELECT {_UID} AS uid, s_suppkey AS s, s_name AS name FROM lineitem l JOIN supplier ON s_suppkey = {_HUB}")
def hub_join(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("long").alias("uid"), F.expr(_HUB).cast("long").alias("key"))
    makers = star_graph(spark, d).vertices("supplier").select(F.col("id").alias("s"), "name")
    return hubs.hub_join(lines, makers, "key", "s", chunk=2000).select("uid", "s", "name")


@query("SELECT c_custkey AS c, o_orderkey AS o, n_nationkey::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'")
def match_over_hubs(spark, d):
    """Nations are hubs of customers: the pattern's joins go over grids."""
    q = pattern([("c", "customer"), ("n", "nation"), ("o", "orders", {"priority": "1-urgent"})], [("in_nation", "c", "n"), ("placed", "c", "o")])
    return ids(compiler.bindings(star_graph(spark, d), q, hub_rows=50), "c", "o", "n")


_TWIN = pattern([("a", "customer", {"mktsegment": "building"}), ("b", "customer", {"mktsegment": "building"}), ("n", "nation")], [("in_nation", "a", "n"), ("in_nation", "b", "n")])


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey JOIN nation ON n_nationkey = a.c_nationkey WHERE lower(a.c_mktsegment) = 'building' AND lower(b.c_mktsegment) = 'building' AND a.c_custkey <> b.c_custkey")
def match_edge_isomorphic(spark, d):
    """Pairs of customers of a nation: nations are hubs, whose pairs are dealt over grids."""
    return ids(compiler.bindings(star_graph(spark, d), _TWIN, isomorphic=True, hub_rows=2000), "a", "b")


_PAIRS = f"FROM {_INTERVALS} JOIN {_INTERVALS.replace(') i', ') j')} ON i.chr = j.chr AND i.s < j.e AND j.s < i.e"


def _two(spark, d):
    v = star_graph(spark, d).vertices("interval")
    side = lambda x: v.select(*[F.col(c).alias(f"{x}__{c}") for c in v.columns])
    return side("a"), side("b")


@query(f"SELECT i.id AS a, j.id AS b {_PAIRS}")
def overlap_join_binned(spark, d):
    return ids(overlap_join(*_two(spark, d), "a", "b"), "a", "b")


@query(f"SELECT i.id AS a, j.id AS b {_PAIRS} WHERE lower(i.chr) = 'purchase'")
def match_overlap(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("a", "interval", {"chr": "purchase"}), ("b", "interval")], [("overlaps_with", "a", "b")])), "a", "b")


@query("SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region, nation")
def cartesian_nodes(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("r", "region"), ("n", "nation")])), "r", "n")


@query("SELECT r_regionkey::BIGINT AS r, c_custkey AS c FROM (SELECT 1) LEFT JOIN region ON TRUE LEFT JOIN (SELECT * FROM customer WHERE lower(c_name) = 'nobody') ON TRUE")
def optional_nodes(spark, d):
    return ids(compiler.optional_nodes(star_graph(spark, d), pattern([("r", "region"), ("c", "customer", {"name": "nobody"})])), "r", "c")


_SEMI = pattern([("c", "customer", {"mktsegment": "building"}), ("o", "orders"), ("p", "part", {"brand": "Brand#13"})], [("placed", "c", "o"), ("contains", "o", "p")])


@query("WITH o1 AS (SELECT c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'building') SELECT 'p0' AS predicate_id, c_custkey::VARCHAR AS source, o_orderkey::VARCHAR AS target FROM o1 UNION SELECT 'p1', l_orderkey::VARCHAR, l_partkey::VARCHAR FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_brand) = 'brand#13' AND l_orderkey IN (SELECT o_orderkey FROM o1)")
def forward_semijoin(spark, d):
    return compiler.semijoin_edges(star_graph(spark, d), _SEMI, mode="forward")


@query("WITH m AS (SELECT c_custkey, o_orderkey, p_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE lower(c_mktsegment) = 'building' AND lower(p_brand) = 'brand#13') SELECT 'p0' AS predicate_id, c_custkey::VARCHAR AS source, o_orderkey::VARCHAR AS target FROM m UNION SELECT 'p1', o_orderkey::VARCHAR, p_partkey::VARCHAR FROM m")
def full_semijoin(spark, d):
    return compiler.semijoin_edges(star_graph(spark, d), _SEMI)


@query("SELECT * FROM (SELECT 'nation ' || n_nationkey AS id, 'nation' AS type, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'customer ' || c_custkey, 'customer', 'customer ' || c_custkey FROM customer)")
def patch_missing_edges(spark, d):
    nodes, edges = places(spark, d)
    return result.patch_missing(nodes.where("type = 'nation'"), edges.where("edge_id = 'customer_in_nation_nation'"))


@query("SELECT DISTINCT n_nationkey::BIGINT AS target, c_custkey AS node_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def list_by_target(spark, d):
    g = star_graph(spark, d)
    wanted = g.edges("nation", "in_region", "region").where("dst = 1").select(F.col("src").alias("id"))
    return result.list_by_target(g.edges("customer", "in_nation", "nation"), wanted)


@query("SELECT p_partkey AS target, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS node_ids FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size = 7 AND s_acctbal > 0 GROUP BY 1")
def list_both(spark, d):
    g = star_graph(spark, d)
    found = result.list_by_target(g.edges("supplier", "supplies", "part"), g.vertices("part").where("size = 7"), g.vertices("supplier").where("acctbal > 0"), arrays=True)
    return found.select("target", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"))


@query("SELECT c_custkey AS member, string_agg(DISTINCT n_regionkey::VARCHAR, ',' ORDER BY n_regionkey::VARCHAR) AS terms FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def ontology_rollup(spark, d):
    g = star_graph(spark, d)
    members = g.edges("customer", "in_nation", "nation").select(F.col("src").alias("member"), F.col("dst").alias("term"))
    return result.roll_up(members, g.edges("nation", "in_region", "region").select(F.col("src").alias("child"), F.col("dst").alias("parent")))


#: a hierarchy of parts with two parents each, and a cycle of three at its top.
_ABOVE = "SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 5 + 1 FROM part UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey < 3"
_REACHED = f"WITH RECURSIVE e AS ({_ABOVE}), r AS (SELECT child, parent AS ancestor, 1 AS distance FROM e UNION SELECT r.child, e.parent, r.distance + 1 FROM r JOIN e ON e.child = r.ancestor WHERE r.distance < {{}})"


def _above(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("child"))
    at = lambda sql: p.withColumn("parent", F.expr(sql))
    return at("child div 3").where("child >= 3").unionByName(at("child div 5 + 1")).unionByName(at("child + 1").where("child < 3"))


def _closed(depth: int | None):
    return lambda spark, d: closure.closure(_above(spark, d), depth=depth)


for _name, _depth in (("closure_one", 1), ("closure_three", 3), ("closure_all", None)):
    QUERIES[_name] = _closed(_depth)
    ORACLE_SQL[_name] = f"{_REACHED.format(_depth or 20)} SELECT child, ancestor, min(distance)::INT AS distance FROM r GROUP BY ALL"


@query(f"{_REACHED.format(20)}, m AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS term FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) SELECT member, term, min(distance)::INT AS distance FROM (SELECT member, term, 0 AS distance FROM m UNION ALL SELECT member, ancestor, distance FROM m JOIN r ON r.child = m.term) GROUP BY ALL")
def ontology_rollup_all(spark, d):
    members = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_suppkey").cast("long").alias("member"), F.col("l_partkey").cast("long").alias("term"))
    return closure.rolled_up(members, _above(spark, d))


@query("SELECT o_custkey AS id, any_value(c_name) AS name, any_value(c_mktsegment) AS mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def enrich_properties(spark, d):
    g = star_graph(spark, d)
    keys = g.edges("customer", "placed", "orders").join(g.vertices("orders").where("priority = '1-URGENT'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return result.enrich(keys, g, "customer").select("id", "name", "mktsegment")


# Counts -------------------------------------------------------------------------------------------


@query(f"SELECT count(DISTINCT c.c_custkey) + count(DISTINCT o.o_orderkey) + count(DISTINCT p.p_partkey) AS total_nodes, count(DISTINCT o.o_orderkey) + count(DISTINCT {_UID}) AS total_edges FROM {_CHAIN}")
def total_count(spark, d):
    return counting.total_counts(star_graph(spark, d), CHAIN)


@query(f"WITH m AS (SELECT c.c_custkey AS c, o.o_orderkey AS o, p.p_partkey AS p, {_UID} AS u FROM {_CHAIN}) SELECT 'node' AS kind, 'c' AS variable, 'customer' AS label, count(DISTINCT c) AS count FROM m UNION ALL SELECT 'node', 'o', 'orders', count(DISTINCT o) FROM m UNION ALL SELECT 'node', 'p', 'part', count(DISTINCT p) FROM m UNION ALL SELECT 'edge', 'p0', 'placed', count(DISTINCT o) FROM m UNION ALL SELECT 'edge', 'p1', 'contains', count(DISTINCT u) FROM m")
def label_count(spark, d):
    return counting.variable_counts(star_graph(spark, d), CHAIN)


@query("WITH m AS (SELECT a.c_custkey AS a, b.c_custkey AS b, n_nationkey AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey JOIN nation ON n_nationkey = a.c_nationkey WHERE lower(a.c_mktsegment) = 'building' AND lower(b.c_mktsegment) = 'building') SELECT 'node' AS kind, 'customer' AS label, count(DISTINCT a) + count(DISTINCT b) AS count FROM m UNION ALL SELECT 'node', 'nation', count(DISTINCT n) FROM m UNION ALL SELECT 'edge', 'in_nation', count(DISTINCT a) + count(DISTINCT b) FROM m UNION ALL SELECT 'node', 'part', 0")
def label_count_rollup(spark, d):
    return counting.label_counts(star_graph(spark, d), _TWIN, ["customer", "part"])


@query(f"SELECT c.c_custkey AS id, count(*) AS matches FROM {_CHAIN} GROUP BY 1")
def matches_by_customer(spark, d):
    return counting.matches_at(star_graph(spark, d), CHAIN, "c").select("id", F.col("matches").cast("long").alias("matches"))


@query("SELECT count(*) AS matches FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey JOIN nation ON n_nationkey = a.c_nationkey WHERE lower(a.c_mktsegment) = 'building' AND lower(b.c_mktsegment) = 'building'")
def match_count(spark, d):
    return counting.match_count(star_graph(spark, d), _TWIN).select(F.col("matches").cast("long").alias("matches"))


@query(f"SELECT count(DISTINCT c.c_custkey) AS c, count(DISTINCT o.o_orderkey) AS o, count(DISTINCT p.p_partkey) AS p, count(DISTINCT {_UID}) AS contained FROM {_CHAIN}")
def counts_of_bindings(spark, d):
    """The same counts as ``label_count`` from the bindings, as patterns with cycles are counted."""
    counts = result.variable_counts(compiler.bindings(star_graph(spark, d), CHAIN), CHAIN)
    of = lambda v: F.max(F.when(F.col("variable") == v, F.col("count")))
    return counts.agg(of("c").alias("c"), of("o").alias("o"), of("p").alias("p"), of("p1").alias("contained"))


@query("""WITH m AS (SELECT a.c_custkey AS a, b.c_custkey AS b, n_nationkey AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey JOIN nation ON n_nationkey = a.c_nationkey WHERE lower(a.c_mktsegment) = 'building' AND lower(b.c_mktsegment) = 'building')
    SELECT 'node' AS kind, 'customer' AS label, (SELECT count(*) FROM (SELECT a FROM m UNION SELECT b FROM m)) AS count UNION ALL SELECT 'node', 'nation', count(DISTINCT n) FROM m UNION ALL SELECT 'edge', 'in_nation', 2 * count(*) FROM m""")
def occurrence_counts(spark, d):
    """Vertices once, edges as often as matches show them, in a pattern with more matches than edges."""
    return counting.occurrence_counts(star_graph(spark, d), _TWIN).withColumn("count", F.col("count").cast("long"))


@query("SELECT (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey) * (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS matches")
def match_count_apart(spark, d):
    """Two parts without a common variable: the number is a product, their bindings are never paired."""
    two = pattern([("c", "customer"), ("n", "nation"), ("o", "orders"), ("p", "part")], [("in_nation", "c", "n"), ("contains", "o", "p")])
    return counting.match_count(star_graph(spark, d), two).select(F.col("matches").cast("long").alias("matches"))


@query(f"WITH n AS ({_PLACE_NODES}), e AS ({_PLACE_EDGES}) SELECT 'node' AS kind, type AS label, count(*) AS count FROM n GROUP BY 2 UNION ALL SELECT 'edge', label, count(*) FROM e GROUP BY 2")
def graph_count(spark, d):
    return result.graph_counts(*places(spark, d))


_ALL_V = "SELECT 'region' AS type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'user', count(DISTINCT user_id) FROM events UNION ALL SELECT 'event', count(*) FROM events UNION ALL SELECT 'interval', count(*) FROM events"
_ALL_E = "SELECT 'in_region' AS type, 'nation' AS source_type, 'region' AS target_type, count(*) AS n FROM nation UNION ALL SELECT 'in_nation', 'customer', 'nation', count(*) FROM customer UNION ALL SELECT 'in_nation', 'supplier', 'nation', count(*) FROM supplier UNION ALL SELECT 'placed', 'customer', 'orders', count(*) FROM orders UNION ALL SELECT 'contains', 'orders', 'part', count(*) FROM lineitem UNION ALL SELECT 'supplies', 'supplier', 'part', count(*) FROM lineitem UNION ALL SELECT 'ships', 'supplier', 'orders', count(*) FROM lineitem UNION ALL SELECT 'emits', 'user', 'event', count(user_id) FROM events"


@query(f"SELECT sum(n)::BIGINT AS entities FROM ({_ALL_V})")
def kg_entities(spark, d):
    return statistics.entities(star_graph(spark, d))


@query(f"SELECT sum(n)::BIGINT AS connections FROM ({_ALL_E})")
def kg_connections(spark, d):
    return statistics.connections(star_graph(spark, d))


@query(_ALL_V)
def kg_label_hist(spark, d):
    return statistics.label_histogram(star_graph(spark, d))


@query(_ALL_E)
def kg_triple_hist(spark, d):
    return statistics.triple_histogram(star_graph(spark, d))


@query(f"SELECT type, sum(n)::BIGINT AS n FROM ({_ALL_E}) GROUP BY 1")
def kg_type_hist(spark, d):
    return statistics.type_histogram(star_graph(spark, d))


@query(f"WITH n AS ({_PLACE_NODES}) SELECT n.type, count(*) OVER (PARTITION BY n.type) || ' ' || n.type || ' nodes' AS \"group\", id, name FROM n")
def node_only_group(spark, d):
    groups, members = result.grouped_nodes(places(spark, d)[0])
    return members.join(groups.withColumnRenamed("name", "group"), "type")


# Graph algebra ------------------------------------------------------------------------------------


@query(f"WITH {_SIGNED} SELECT group_id AS id, type, CASE WHEN count(*) = 1 THEN min(name) ELSE count(*) || ' ' || type || ' nodes' END AS name, count(*) AS n FROM g GROUP BY group_id, type")
def collapse_nodes(spark, d):
    return algebra.collapse(*places(spark, d))[0]


@query(f"WITH {_SIGNED} SELECT group_id AS parent, id AS child FROM g")
def collapse_members(spark, d):
    return algebra.collapse(*places(spark, d))[2]


@query(f"WITH {_SIGNED} SELECT DISTINCT edge_id, label, a.group_id AS source, b.group_id AS target FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target WHERE a.group_id <> b.group_id")
def collapse_nodes_hash(spark, d):
    return algebra.compound(*places(spark, d))[1]


def _parents_sql(nodes: str, edges: str) -> str:
    return f"""pn AS ({nodes}), pe AS ({edges}),
    pi AS (SELECT source AS id, 'out' AS way, edge_id, target AS other FROM pe UNION ALL SELECT target, 'in', edge_id, source FROM pe),
    po AS (SELECT id, edge_id, other, max(way) AS way, sha256(other) AS d FROM pi GROUP BY 1, 2, 3),
    pa AS (SELECT id, edge_id, max(way) = 'out' AS is_source, count(*) AS n, sha256(count(*) || ':' || {_BITS}) AS parent FROM po GROUP BY 1, 2 HAVING count(*) >= 2),
    c AS (SELECT parent, id AS owner, edge_id, is_source, n FROM pa QUALIFY row_number() OVER (PARTITION BY parent ORDER BY id, edge_id) = 1),
    m AS (SELECT c.parent, c.is_source, c.n, c.owner, po.other AS child FROM c JOIN po ON po.id = c.owner AND po.edge_id = c.edge_id),
    k AS (SELECT * FROM m WHERE parent NOT IN (SELECT m.parent FROM m JOIN (SELECT child, is_source, max(n) AS top FROM m GROUP BY 1, 2) t USING (child, is_source) WHERE t.top > m.n) AND child IN (SELECT id FROM pn)),
    b AS (SELECT parent, child FROM k QUALIFY row_number() OVER (PARTITION BY child ORDER BY n DESC, owner, parent) = 1),
    f AS (SELECT parent FROM b GROUP BY 1 HAVING count(*) > 1),
    p AS (SELECT * FROM c WHERE parent IN (SELECT parent FROM f)), h AS (SELECT p.owner, p.edge_id, p.is_source, po.other AS child FROM p JOIN po ON po.id = p.owner AND po.edge_id = p.edge_id),
    out AS (SELECT edge_id, label, source, target FROM pe WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.edge_id = pe.edge_id AND ((h.is_source AND h.owner = pe.source AND h.child = pe.target) OR (NOT h.is_source AND h.owner = pe.target AND h.child = pe.source)))
        UNION ALL SELECT edge_id, array_to_string(list_slice(string_split(edge_id, '_'), 2, -2), '_'), CASE WHEN is_source THEN owner ELSE parent END, CASE WHEN is_source THEN parent ELSE owner END FROM p)"""


_PARENTS = _parents_sql(_PLACE_NODES, _PLACE_EDGES)
_BETWEEN = "SELECT DISTINCT edge_id, label, a.group_id AS source, b.group_id AS target FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target WHERE a.group_id <> b.group_id"


@query(f"WITH {_PARENTS} SELECT parent, child FROM b WHERE parent IN (SELECT parent FROM f)")
def group_parents(spark, d):
    return algebra.group_parents(*places(spark, d))[0]


@query(f"WITH {_PARENTS} SELECT * FROM out")
def group_parents_edges(spark, d):
    return algebra.group_parents(*places(spark, d))[2]


@query(f"WITH {_SIGNED}, {_parents_sql('SELECT DISTINCT group_id AS id FROM g', _BETWEEN)} SELECT * FROM out")
def group_graph(spark, d):
    return algebra.group_graph(*places(spark, d))[3]


@query(f"WITH {_SIGNED}, {_parents_sql('SELECT DISTINCT group_id AS id FROM g', _BETWEEN)} SELECT parent, child FROM b WHERE parent IN (SELECT parent FROM f)")
def group_graph_children(spark, d):
    return algebra.group_graph(*places(spark, d))[2]


@query(f"SELECT DISTINCT edge_id, source, target FROM ({_PLACE_EDGES})")
def break_grouping(spark, d):
    nodes, edges = places(spark, d)
    children, _, grouped = algebra.group_parents(nodes, edges)
    return algebra.break_grouping(children, grouped).select("edge_id", "source", "target")


@query("WITH x AS (SELECT 'part ' || p_partkey AS id, string_split(replace(p_type, ' ', ','), ',') AS places FROM part), y AS (SELECT id, places, unnest(range(len(places))) AS i FROM x) SELECT CASE WHEN len(places) > 1 THEN id || '_loc_' || i ELSE id END AS id, id AS original, places[i + 1] AS location, i = 0 AS main FROM y")
def collapse_location(spark, d):
    parts = star_graph(spark, d).vertices("part").select(result.key("part", F.col("id")).alias("id"), F.lit("part").alias("type"), "name", F.translate("type", " ", ",").alias("location"))
    return algebra.by_location(parts)[0].select("id", "original", "location", "main")


_SPREAD = """x AS (SELECT 'part ' || p_partkey AS original, p_name AS name, string_split(replace(p_type, ' ', ','), ',') AS places FROM part), y AS (SELECT *, unnest(range(len(places))) AS i FROM x),
    l AS (SELECT CASE WHEN len(places) > 1 THEN original || '_loc_' || i ELSE original END AS id, original, 'part' AS type, name, places[i + 1] AS location, i = 0 AS main FROM y
        UNION ALL SELECT 'supplier ' || s_suppkey, 'supplier ' || s_suppkey, 'supplier', s_name, '', TRUE FROM supplier),
    t AS (SELECT 'supplier_supplies_part' AS edge_id, 'supplies' AS label, 'supplier ' || l_suppkey AS source, l.id AS target FROM lineitem JOIN l ON l.original = 'part ' || l_partkey AND l.main
        UNION ALL SELECT 'location_alias', 'location_alias', id, original || '_loc_0' FROM l WHERE NOT main),
    e AS (SELECT min(edge_id) AS edge_id, min(label) AS label, source, target FROM t GROUP BY source, target),
    i AS (SELECT DISTINCT id, sha256(concat_ws('|', way, edge_id, other)) AS d FROM (SELECT source AS id, 'out' AS way, edge_id, target AS other FROM e UNION ALL SELECT target, 'in', edge_id, source FROM e)),
    s AS (SELECT id, count(*) || ':' || """ + _BITS + """ AS signature FROM i GROUP BY id),
    q AS (SELECT l.*, sha256(concat_ws('|', location, coalesce(signature, ''))) AS digest FROM l LEFT JOIN s USING (id)),
    g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY digest) = 1 THEN id ELSE digest END AS group_id FROM q)"""


def _located(spark, d):
    g = star_graph(spark, d)
    parts = g.vertices("part").select(result.key("part", F.col("id")).alias("id"), F.lit("part").alias("type"), "name", F.translate("type", " ", ",").alias("location"))
    makers = g.vertices("supplier").select(result.key("supplier", F.col("id")).alias("id"), F.lit("supplier").alias("type"), "name", F.lit(None).cast("string").alias("location"))
    edges = g.edges("supplier", "supplies", "part").select(F.lit("supplier_supplies_part").alias("edge_id"), F.lit("supplies").alias("label"), result.key("supplier", F.col("src")).alias("source"), result.key("part", F.col("dst")).alias("target"))
    return algebra.collapse_location(parts.unionByName(makers), edges)


@query(f"WITH {_SPREAD} SELECT group_id AS id, arg_min(type, id) AS type, CASE WHEN count(*) = 1 THEN min(name) ELSE count(*) || ' ' || arg_min(type, id) || ' nodes' END AS name, count(*) AS n FROM g GROUP BY group_id")
def collapse_location_nodes(spark, d):
    return _located(spark, d)[0]


@query(f"WITH {_SPREAD} {_BETWEEN}")
def collapse_location_edges(spark, d):
    return _located(spark, d)[1]


@query("WITH RECURSIVE e AS (SELECT 'nation ' || n_nationkey AS a, 'region ' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier UNION ALL SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), h AS (SELECT 'region ' || r_regionkey AS id, 'region ' || r_regionkey AS root FROM region UNION SELECT u.b, h.root FROM h JOIN u ON u.a = h.id), m AS (SELECT root, min(id) AS component FROM h GROUP BY 1) SELECT h.id, m.component FROM h JOIN m USING (root)")
def components(spark, d):
    nodes, edges = places(spark, d)
    return algebra.components(nodes, edges)


@query("SELECT n + 1 AS n_nodes, n AS n_edges, count(*) AS components FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1) GROUP BY n")
def component_classes(spark, d):
    """Components of users and their events by isomorphism: stars of one size have one canonical form."""
    g = star_graph(spark, d)
    edges = g.edges("user", "emits", "event").select(F.concat(F.lit("user "), "src").alias("source"), F.concat(F.lit("event "), "dst").alias("target"))
    nodes = g.vertices("user").select(F.concat(F.lit("user "), "id").alias("id"))
    forms = isomorphism.component_forms(nodes, edges)
    return forms.groupBy("form", "n_nodes", "n_edges").agg(F.count("*").alias("components")).select("n_nodes", "n_edges", "components")


def _graphs(spark, d):
    g = star_graph(spark, d)
    e = g.edges("orders", "contains", "part")
    shaped = lambda x: x.select(F.lit("orders_contains_part").alias("edge_id"), F.lit("contains").alias("label"), result.key("orders", F.col("src")).alias("source"), result.key("part", F.col("dst")).alias("target")).distinct()
    both = [shaped(e.where("returnflag = 'R'")), shaped(e.where("quantity > 25"))]
    nodes = [x.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.substring_index("id", " ", 1).alias("type"), F.col("id").alias("name")) for x in both]
    nodes[1] = nodes[1].withColumn("name", F.when(F.col("type") == "part", F.upper("name")).otherwise(F.col("name")))
    return nodes[0], both[0], nodes[1], both[1]


_TWO = """e1 AS (SELECT DISTINCT 'orders ' || l_orderkey AS source, 'part ' || l_partkey AS target FROM lineitem WHERE l_returnflag = 'R'), e2 AS (SELECT DISTINCT 'orders ' || l_orderkey AS source, 'part ' || l_partkey AS target FROM lineitem WHERE l_quantity > 25),
    n1 AS (SELECT source AS id FROM e1 UNION SELECT target FROM e1), n2 AS (SELECT source AS id FROM e2 UNION SELECT target FROM e2), k1 AS (SELECT source || '|' || target || '|contains' AS key FROM e1), k2 AS (SELECT source || '|' || target || '|contains' AS key FROM e2)"""


@query(f"WITH {_TWO} SELECT 'node' AS kind, 'added' AS change, id AS key FROM n2 WHERE id NOT IN (SELECT id FROM n1) UNION ALL SELECT 'node', 'removed', id FROM n1 WHERE id NOT IN (SELECT id FROM n2) UNION ALL SELECT 'edge', 'added', key FROM k2 WHERE key NOT IN (SELECT key FROM k1) UNION ALL SELECT 'edge', 'removed', key FROM k1 WHERE key NOT IN (SELECT key FROM k2)")
def graph_diff(spark, d):
    return algebra.diff(*_graphs(spark, d))


@query(f"WITH {_TWO} SELECT coalesce(n1.id, n2.id) AS id, CASE WHEN n1.id IS NULL THEN 'G2' WHEN n2.id IS NULL THEN 'G1' ELSE 'both' END AS origin, n1.id IS NOT NULL AND n2.id IS NOT NULL AND n1.id LIKE 'part %' AS conflict, CASE WHEN n1.id IS NOT NULL OR n2.id NOT LIKE 'part %' THEN coalesce(n1.id, n2.id) ELSE upper(n2.id) END AS name FROM n1 FULL JOIN n2 ON n1.id = n2.id")
def graph_merge(spark, d):
    n1, _, n2, _ = _graphs(spark, d)
    return algebra.merge_nodes(n1, n2).select("id", "origin", "conflict", "name")


@query(f"WITH {_TWO} SELECT 'orders_contains_part' AS edge_id, coalesce(e1.source, e2.source) AS source, coalesce(e1.target, e2.target) AS target, 1 AS nth, CASE WHEN e1.source IS NULL THEN 'G2' WHEN e2.source IS NULL THEN 'G1' ELSE 'both' END AS origin FROM e1 FULL JOIN e2 ON e1.source = e2.source AND e1.target = e2.target")
def graph_merge_edges(spark, d):
    _, e1, _, e2 = _graphs(spark, d)
    return algebra.merge_edges(e1, e2)


@query(f"WITH {_TWO} SELECT DISTINCT least(e1.source, e1.target) AS u, greatest(e1.source, e1.target) AS v FROM e1 JOIN e2 ON e1.source = e2.source AND e1.target = e2.target")
def reverse_edges(spark, d):
    _, e1, _, e2 = _graphs(spark, d)
    return algebra.reverse_pairs(e1, e2.select("edge_id", "label", F.col("target").alias("source"), F.col("source").alias("target")))


@query("SELECT 'part ' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def isolated_nodes(spark, d):
    g = star_graph(spark, d)
    parts = g.vertices("part").select(result.key("part", F.col("id")).alias("id"))
    edges = g.edges("orders", "contains", "part").where("quantity > 45").select(result.key("orders", F.col("src")).alias("source"), result.key("part", F.col("dst")).alias("target"))
    return algebra.out_index(parts, edges)[1]


@query(f"SELECT source AS id, target FROM ({_PLACE_EDGES})")
def map_graph(spark, d):
    return algebra.out_index(*places(spark, d))[0]


_LIMIT = f"""WITH RECURSIVE n AS ({_PLACE_NODES}), e AS ({_PLACE_EDGES}), stars AS MATERIALIZED (SELECT source AS id, count(*) AS n, row_number() OVER (ORDER BY source) AS i FROM e GROUP BY 1),
    fold AS (SELECT 0::BIGINT AS i, 200::BIGINT AS rest, NULL::VARCHAR AS id UNION ALL SELECT stars.i, CASE WHEN stars.n < rest THEN rest - stars.n - 1 ELSE rest END, CASE WHEN stars.n < rest THEN stars.id END FROM fold JOIN stars ON stars.i = fold.i + 1),
    held AS (SELECT e.* FROM e WHERE source IN (SELECT id FROM fold WHERE id IS NOT NULL)),
    lone AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM n WHERE id NOT IN (SELECT source FROM e) AND id NOT IN (SELECT target FROM e))"""


@query(f"{_LIMIT} SELECT * FROM n WHERE id IN (SELECT source FROM held UNION SELECT target FROM held UNION SELECT id FROM lone WHERE i <= (SELECT min(rest) FROM fold))")
def limit_graph(spark, d):
    return algebra.limit_graph(*places(spark, d), 200)[0]


@query(f"{_LIMIT} SELECT edge_id, label, source, target FROM held")
def limit_graph_edges(spark, d):
    return algebra.limit_graph(*places(spark, d), 200)[1]


# Requests: guards, names, limits, spans ------------------------------------------------------------


@query("SELECT event_id AS i FROM events WHERE lower(event_type) = 'click'")
def interval_guard(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("i", "interval", {"chr": "click", "start": 5})])), "i")


@query("SELECT c_custkey AS c FROM customer WHERE FALSE")
def filter_unknown_property(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("c", "customer", {"shoe_size": "4.*"})])), "c")


@query("SELECT p_partkey AS p FROM part WHERE FALSE")
def filter_exact_other_type(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("p", "part", {"size": "seven"})]), matching="exact"), "p")


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower(c_name) = 'customer#000000042'")
def id_or_name(spark, d):
    q = names_from_ids(pattern([("c", "customer", "Customer#000000042"), ("o", "orders")], [("placed", "c", "o")]), {"customer": ("CUST-", "name")})
    return ids(compiler.bindings(star_graph(spark, d), q), "c", "o")


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY c_custkey, o_orderkey LIMIT 50")
def limit_bindings(spark, d):
    return ids(compiler.bindings(star_graph(spark, d), pattern([("c", "customer"), ("o", "orders")], [("placed", "c", "o")]), limit=50), "c", "o")


@query(f"SELECT 'orders_contains_part' AS edge_id, 'orders ' || o_orderkey AS source, 'part ' || p_partkey AS target, arg_min(l_returnflag, ({_UID}, l_returnflag)) AS source_data FROM orders JOIN lineitem l ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def edge_source_data(spark, d):
    g = star_graph(spark, d)
    own = g.edges("orders", "contains", "part").select("src", "dst", "uid", F.col("returnflag").alias("source"))
    named = GraphCatalog(spark, {x: g.vertices(x) for x in ("orders", "part")}, {("orders", "contains", "part"): own})
    q = pattern([("o", "orders"), ("p", "part")], [("contains", "o", "p")])
    return result.edge_properties(compiler.bindings(named, q), q, "p0")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'u1,' END || CASE WHEN o_orderkey % 2 = 0 THEN 'u2,u7' WHEN o_orderkey % 3 = 0 THEN 'u7' ELSE 'u7' END AS participants FROM orders")
def add_participant(spark, d):
    k = F.col("o_orderkey")
    had = F.array_compact(F.array(F.when(k % 3 != 0, F.lit("u1")), F.when(k % 2 == 0, F.lit("u2"))))
    rows = table(spark, d, "orders").select(k.alias("id"), had.alias("participants"))
    return history.with_participant(rows, "u7").select("id", F.array_join("participants", ",").alias("participants"))


_NEXT = "SELECT DISTINCT 'part ' || a.l_partkey AS source, 'part ' || b.l_partkey AS target FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"


@query(f"WITH e AS ({_NEXT}) SELECT id, CASE WHEN p_brand = 'Brand#13' THEN 'Brand' ELSE p_brand END AS location FROM (SELECT source AS id FROM e UNION SELECT target FROM e) JOIN part ON id = 'part ' || p_partkey")
def localised_nodes(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), result.key("part", F.col("l_partkey")).alias("p"))
    after = line.select("o", (F.col("n") - 1).alias("n"), F.col("p").alias("q"))
    near = line.join(after, ["o", "n"]).select(F.lit("part_next_part").alias("edge_id"), F.lit("next").alias("label"), F.col("p").alias("source"), F.col("q").alias("target"))
    beside = star_graph(spark, d).edges("orders", "contains", "part").select(F.lit("orders_contains_part").alias("edge_id"), F.lit("contains").alias("label"), result.key("orders", F.col("src")).alias("source"), result.key("part", F.col("dst")).alias("target"))
    terms = star_graph(spark, d).vertices("part").select(result.key("part", F.col("id")).alias("member"), F.col("brand").alias("term"))
    return algebra.localised(near.unionByName(beside), spark.createDataFrame([], "parent string, child string"), terms, spark.createDataFrame([("Brand#13", "Brand")], "child string, parent string"), "part")[0]


@query("SELECT id, label, name FROM (SELECT p_partkey::VARCHAR AS id, 'part' AS label, p_name AS name FROM part UNION ALL SELECT c_custkey::VARCHAR, 'customer', c_name FROM customer)")
def completion_index(spark, d):
    g = star_graph(spark, d)
    part = g.vertices("part").select(F.col("id").cast("string").alias("id"), F.lit("part").alias("label"), F.col("name").alias("part_name"), F.lit(None).cast("string").alias("customer_name"))
    customer = g.vertices("customer").select(F.col("id").cast("string").alias("id"), F.lit("customer").alias("label"), F.lit(None).cast("string").alias("part_name"), F.col("name").alias("customer_name"))
    return files.completion_index(part.unionByName(customer))


@query("SELECT c_custkey::VARCHAR AS id, 'customer' AS label, c_name AS name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%' ORDER BY c_name, id LIMIT 10")
def complete_prefix(spark, d):
    v = star_graph(spark, d).vertices("customer").select(F.col("id").cast("string").alias("id"), F.lit("customer").alias("label"), F.col("name").alias("customer_name"))
    return files.complete(files.completion_index(v), "CUSTOMER#00000001")


def _index(spark, d) -> str:
    v = star_graph(spark, d).vertices("customer").select(F.col("id").cast("string").alias("id"), F.lit("customer").alias("label"), F.col("name").alias("customer_name"))
    path = shared_path(spark, "completion")
    completion.write_index(files.completion_index(v), path)
    return path


@query("SELECT c_custkey::VARCHAR AS id, 'customer' AS label, c_name AS name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%' ORDER BY c_name, id LIMIT 10")
def complete_from_index(spark, d):
    return completion.search(spark, _index(spark, d), "Customer#00000001")


@query("SELECT c_custkey::VARCHAR AS id, 'customer' AS label, c_name AS name FROM customer WHERE lower(c_name) LIKE 'cu%' ORDER BY c_name, id LIMIT 5")
def complete_short_prefix(spark, d):
    return completion.search(spark, _index(spark, d), "CU", 5)


@query(f"""WITH n AS ({_PLACE_NODES}), e AS ({_PLACE_EDGES}) SELECT 'nodes' AS part, '{{"data":{{"id":"' || id || '","type":"' || type || '","name":"' || name || '"}}}}' AS json FROM n
    UNION ALL SELECT 'edges', '{{"data":{{"edge_id":"' || edge_id || '","label":"' || label || '","source":"' || source || '","target":"' || target || '"}}}}' FROM e""")
def graph_json(spark, d):
    return files.graph_json_rows(*places(spark, d))


@query("SELECT 'customer ' || c_custkey AS source, 'Name: ' || c_name AS about, 'in_nation -> Target Node (nation ' || n_nationkey || '): Name: ' || n_name AS line FROM customer JOIN nation ON n_nationkey = c_nationkey")
def source_summaries(spark, d):
    nodes, edges = places(spark, d)
    return result.source_summaries(nodes, edges.where("edge_id = 'customer_in_nation_nation'"), text.description(["name"]))


_SUPPLIED = """l AS (SELECT DISTINCT 'supplier ' || l_suppkey AS source, s_name AS about, 'supplies -> Target Node (part ' || l_partkey || '): Name: ' || p_name AS line
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
    n AS (SELECT source, min(about) AS about, ceil(count(*) / 20)::BIGINT AS pages FROM l GROUP BY 1),
    b AS (SELECT source, ('0x' || substr(md5(line), 1, 8))::BIGINT % pages AS page, string_agg(line, chr(10) ORDER BY line) AS body FROM l JOIN n USING (source) GROUP BY 1, 2)"""


@query(f"WITH {_SUPPLIED} SELECT source, page, concat_ws(chr(10), CASE WHEN page = 0 THEN 'Source Node (' || split_part(source, ' ', 2) || '): Name: ' || about END, body) AS text FROM (SELECT source, 0 AS page, about FROM n) FULL JOIN b USING (source, page)")
def source_texts(spark, d):
    """Every supplier and the parts it supplies, as texts of about 20 lines."""
    g = star_graph(spark, d)
    nodes = g.vertices("supplier").select(result.key("supplier", F.col("id")).alias("id"), "name").unionByName(g.vertices("part").select(result.key("part", F.col("id")).alias("id"), "name"))
    supplied = g.edges("supplier", "supplies", "part")
    edges = supplied.select(F.lit("supplies").alias("label"), result.key("supplier", F.col("src")).alias("source"), result.key("part", F.col("dst")).alias("target"))  # a line for each; equal ones are told apart once, as lines
    return result.source_texts(result.source_summaries(nodes, edges, text.description(["name"])), page=20, rows=supplied.count())


@query(f"""WITH n AS ({_PLACE_NODES}), e AS ({_PLACE_EDGES}) SELECT 'node' AS kind, type, '{{"id":"' || id || '","type":"' || type || '","name":"' || name || '"}}' AS data FROM n
    UNION ALL SELECT 'edge', label, '{{"edge_id":"' || edge_id || '","label":"' || label || '","source":"' || source || '","target":"' || target || '"}}' FROM e""")
def rows_by_type(spark, d):
    nodes, edges = places(spark, d)
    return result.by_type(nodes, edges.unionAll(edges.limit(5)))


@query(f"WITH {_SIGNED} SELECT substr(type, 1, 31) AS sheet, group_id AS id, type, id AS member, name FROM g")
def workbook_nodes(spark, d):
    nodes, edges = places(spark, d)
    groups, _, members = algebra.collapse(nodes, edges)
    return files.node_sheets(groups, members, nodes)


@query(f"WITH {_SIGNED} SELECT DISTINCT substr(a.type || '-relationship-' || b.type, 1, 31) AS sheet, edge_id, label, a.group_id AS source, b.group_id AS target FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target WHERE a.group_id <> b.group_id")
def workbook_edges(spark, d):
    groups, edges, _ = algebra.collapse(*places(spark, d))
    return files.edge_sheets(groups, edges)


@query("""WITH v AS (SELECT 'name' AS name, p_name AS option FROM part UNION SELECT 'brand', p_brand FROM part UNION SELECT 'type', p_type FROM part), n AS (SELECT name, count(option) AS n FROM v GROUP BY 1)
    SELECT name, 'combobox' AS input, option FROM v JOIN n USING (name) WHERE n <= 30 AND option IS NOT NULL UNION ALL SELECT name, 'input', NULL FROM n WHERE n > 30 OR n = 0 UNION ALL SELECT 'size', 'number', NULL""")
def form_inputs(spark, d):
    return schema.form_inputs(star_graph(spark, d).vertices("part").select("id", "name", "brand", "type", "size"), most=30)


# Compiled graphs -----------------------------------------------------------------------------------


def _compiled(spark, d):
    c = F.col
    own = lambda source, /, **columns: compiled.Source.parquet(f"{d}/{source}.parquet", columns=[c(v).alias(k) for k, v in columns.items()])
    vertices = {"customer": own("customer", id="c_custkey", name="c_name", mktsegment="c_mktsegment"), "orders": own("orders", id="o_orderkey", priority="o_orderpriority"), "part": own("part", id="p_partkey", brand="p_brand")}
    line = compiled.Source.parquet(f"{d}/lineitem.parquet", columns=[c("l_orderkey").alias("src"), c("l_partkey").alias("dst"), (c("l_orderkey") * 16 + c("l_linenumber")).alias("uid")])
    edges = {("customer", "placed", "orders"): own("orders", src="o_custkey", dst="o_orderkey", uid="o_orderkey"), ("orders", "contains", "part"): line}
    base = shared_path(spark, "compiled")
    compiled.build(spark, base, vertices, edges)
    return compiled.CompiledGraph.open(spark, base)


@query(f"SELECT c.c_custkey AS c, o.o_orderkey AS o, p.p_partkey AS p, {_UID} AS uid FROM {_CHAIN}")
def compiled_pattern(spark, d):
    """The two-hop pattern over dense ids, with the original ids read back from the dictionaries."""
    found = compiler.bindings(_compiled(spark, d).catalog(), CHAIN)
    return found.select(F.col("c__original").alias("c"), F.col("o__original").alias("o"), F.col("p__original").alias("p"), F.col("p1__uid").alias("uid"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS src, (sum(n) OVER (ORDER BY c_custkey) - n)::BIGINT AS first, n FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) QUALIFY n > 0")
def compiled_offsets(spark, d):
    return _compiled(spark, d).offsets("customer", "placed", "orders")


# Answers -----------------------------------------------------------------------------------------


def _answered(spark, d):
    return answer.answer(star_graph(spark, d), CHAIN.request(), shared_path(spark, "answers"))


@query(f"SELECT DISTINCT 'customer_placed_orders' AS edge_id, 'placed' AS label, 'customer ' || c.c_custkey AS source, 'orders ' || o.o_orderkey AS target FROM {_CHAIN} UNION SELECT 'orders_contains_part', 'contains', 'orders ' || o.o_orderkey, 'part ' || p.p_partkey FROM {_CHAIN}")
def answer_edges(spark, d):
    return _answered(spark, d).edges


@query(f"SELECT DISTINCT 'customer ' || c.c_custkey AS id, 'customer' AS type, c.c_name AS name FROM {_CHAIN} UNION SELECT 'orders ' || o.o_orderkey, 'orders', 'orders ' || o.o_orderkey FROM {_CHAIN} UNION SELECT 'part ' || p.p_partkey, 'part', p.p_name FROM {_CHAIN}")
def answer_nodes(spark, d):
    return _answered(spark, d).nodes


# History, exports, texts --------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_custkey = 7 OR o_orderkey % 10 = 7 ORDER BY o_orderkey DESC LIMIT 10 OFFSET 10")
def history_page(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_custkey").cast("string").alias("user_id"), F.array((F.col("o_orderkey") % 10).cast("string")).alias("participants"))
    return history.page(rows.where(history.may_see("7")), "id", 2).select("id", "owner")


@query("SELECT sha256(o_custkey || '|' || o_orderpriority) AS fingerprint, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def fingerprint_dedup(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256).alias("fingerprint"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("PENDING").alias("status"))
    return history.reusable(rows).select("fingerprint", "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 300000 THEN NULL ELSE o_orderpriority END AS priority FROM orders UNION ALL SELECT -c_custkey, 'new', NULL FROM customer WHERE c_acctbal < 0")
def upsert_merges(spark, d):
    """Three merges: all orders; finished ones, without a priority, and new rows; large orders, whose priority comes back."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    base = shared_path(spark, "annotations")
    snapshots.create(spark, base, orders.drop("o_totalprice").schema, ["id"], n_buckets=8)
    snapshots.upsert(spark, base, orders.drop("o_totalprice"))
    fresh = table(spark, d, "customer").where("c_acctbal < 0").select((-F.col("c_custkey")).cast("long").alias("id"), F.lit("new").alias("status"), F.lit(None).cast("string").alias("priority"))
    snapshots.upsert(spark, base, orders.where("status = 'F'").select("id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("priority")).unionByName(fresh))
    snapshots.upsert(spark, base, orders.where("o_totalprice > 300000").select("id", "priority", F.lit("large").alias("status")))
    return snapshots.current(spark, base).rows()


@query(f"SELECT source, target, label FROM ({_PLACE_EDGES})")
def export_tsv_rows(spark, d):
    return files.tsv_edges(places(spark, d)[1])


@query(f"SELECT chr, s AS start, concat_ws(chr(9), chr, s, 'interval_' || id, '.', '.', '.', 'PASS', 'NAME=' || chr || '_' || id) AS line FROM {_INTERVALS}")
def vcf_rows(spark, d):
    v = star_graph(spark, d).vertices("interval").select("chr", "start", result.key("interval", F.col("id")).alias("id"), F.concat_ws(";", "chr", F.col("id").cast("string")).alias("name"))
    return files.vcf_rows(v)


@query("SELECT o_orderkey AS id, c_name || ' placed orders ' || o_orderkey AS title FROM customer JOIN orders ON o_custkey = c_custkey")
def title_text(spark, d):
    g = star_graph(spark, d)
    found = compiler.bindings(g, pattern([("c", "customer"), ("o", "orders")], [("placed", "c", "o")]))
    return found.select(F.col("o__id").alias("id"), text.edge_sentence(F.col("c__name"), F.lit("placed"), result.key("orders", F.col("o__id"))).alias("title"))


@query("SELECT p_partkey AS id, 'Name: ' || p_name || ' | Brand: ' || p_brand || ' | Size: ' || p_size AS description FROM part")
def description_text(spark, d):
    return star_graph(spark, d).vertices("part").select("id", text.description(["name", "brand", "size"]).alias("description"))


_TWO_DECIMALS = "((ms * 200 + {0}) // (2 * {0})) // 100 || '.' || lpad(((ms * 200 + {0}) // (2 * {0}) % 100)::VARCHAR, 2, '0')"


@query(f"WITH x AS (SELECT event_id AS id, event_id * 977 AS ms FROM events) SELECT id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN {_TWO_DECIMALS.format(1000)} || ' sec' WHEN ms < 3600000 THEN {_TWO_DECIMALS.format(60000)} || ' min' ELSE {_TWO_DECIMALS.format(3600000)} || ' hr' END AS duration FROM x")
def duration_text(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), text.duration_text(F.col("event_id") * 977).alias("duration"))


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS at,
    array_to_string(list_filter(string_split(regexp_replace(regexp_replace(event_type || ': ' || ts::DATE || ', (#' || user_id || ')', '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), '-') || '-' || user_id AS file FROM events""")
def time_and_file_name(spark, d):
    e = table(spark, d, "events")
    title = F.concat("event_type", F.lit(": "), F.date_format("ts", "yyyy-MM-dd"), F.lit(",  (#"), F.col("user_id").cast("string"), F.lit(")"))
    return e.select(F.col("event_id").alias("id"), text.iso_time(F.col("ts")).alias("at"), text.file_name(title, F.col("user_id")).alias("file"))


@query("SELECT p_partkey AS id, 'go_' || lpad(p_partkey::VARCHAR, 7, '0') AS term, 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS name FROM part")
def term_names(spark, d):
    named = star_graph(spark, d).vertices("part").select("id", text.term_id(F.format_string("GO:%07d", "id")).alias("term"))
    return named.withColumn("name", text.term_name(F.col("term")))


@query("SELECT 'vertex' AS kind, NULL AS property, 'part' AS label, p_partkey::VARCHAR AS id, NULL AS value FROM part UNION ALL SELECT 'vertex_property', 'part_type', 'part', p_partkey::VARCHAR, p_type FROM part")
def sexpr_roundtrip(spark, d):
    p = star_graph(spark, d).vertices("part")
    vertex = F.format_string("(part %d)", "id")
    lines = p.select(F.explode(F.array(vertex, F.concat(F.lit("(part_type "), vertex, F.lit(" "), F.translate("type", " ", "_"), F.lit(")")))).alias("value"))
    return sexpr.parse_lines(lines).select("kind", "property", F.col("source_label").alias("label"), F.col("source").alias("id"), F.array_join("value", " ").alias("value"))


@query("""SELECT p_partkey AS id, '(name (part ' || p_partkey || ') ' || CASE WHEN contains(p_name, ' ') THEN '"' || p_name || '"' ELSE p_name END || ')' AS line FROM part
    UNION ALL SELECT p_partkey, '(size (part ' || p_partkey || ') ' || p_size || ')' FROM part
    UNION ALL SELECT p_partkey, '(words (part ' || p_partkey || ') "[\\"' || array_to_string(string_split(p_type, ' '), '\\",\\"') || '\\"]")' FROM part""")
def sexpr_values(spark, d):
    """Every part's text, number and list as property expressions."""
    p = star_graph(spark, d).vertices("part").select("id", "name", "size", F.split("type", " ").alias("words"))
    return sexpr.property_lines(p, "part")


@query("SELECT p_partkey AS p, p_name AS name, p_size AS size, p_type AS type FROM part")
def script_roundtrip(spark, d):
    """Every part written as a creation statement and read back, its type's words as a list."""
    p = star_graph(spark, d).vertices("part").select("id", "name", "size", F.split("type", " ").alias("type"))
    parsed = scripts.parse_statements(scripts.statements_of(p, "part"))
    back = scripts.vertices_of(parsed, "part", {"name": "string", "size": "int", "type": "array<string>"})
    return back.select(F.col("id").cast("long").alias("p"), "name", "size", F.array_join("type", " ").alias("type"))


@query("SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem")
def script_edges(spark, d):
    e = star_graph(spark, d).edges("orders", "contains", "part").select("src", "dst", "returnflag")
    parsed = scripts.parse_statements(scripts.statements_of(e, ("orders", "contains", "part")))
    return scripts.edges_of(parsed, "orders", "contains", "part").select(F.col("src").cast("long").alias("o"), F.col("dst").cast("long").alias("p"))


@query("SELECT p_partkey AS p, 'Brand: ' || p_brand || ' | Words: ' || p_type || ', ' || p_brand AS description FROM part WHERE regexp_full_match(p_brand, '(?i)brand#[12].') AND lower(p_type) = 'promo'")
def filter_bag(spark, d):
    """Properties in a variant column: a regex on one, an item of a list written in a text on another."""
    p = star_graph(spark, d).vertices("part").select("id", "brand", "size", F.concat(F.lit("['"), "type", F.lit("', '"), "brand", F.lit("']")).alias("words"))
    bag = p.select("id", bags.bag_from(p, ["brand", "size", "words"]).alias("bag"))
    for condition in bags.bag_filters(F.col("bag"), {"brand": "brand#[12].", "words": "promo"}):
        bag = bag.where(condition)
    return bag.select(F.col("id").alias("p"), bags.bag_description(F.col("bag"), ["brand", "words"]).alias("description"))


@query("SELECT p_partkey AS p FROM part WHERE p_size = 7 AND p_brand = 'Brand#13'")
def filter_bag_exact(spark, d):
    p = star_graph(spark, d).vertices("part")
    bag = p.select("id", bags.bag_from(p, ["brand", "size"]).alias("bag"))
    for condition in bags.bag_filters(F.col("bag"), {"brand": "Brand#13", "size": 7, "colour": None}, matching="exact"):
        bag = bag.where(condition)
    return bag.select(F.col("id").alias("p"))


@query("""WITH p AS (SELECT p_partkey AS id, string_split(p_type, ' ') AS words, p_size AS size FROM part), l AS (SELECT *, len(words) AS k FROM p)
    SELECT id, 0 AS node, NULL::INT AS parent, 0 AS depth, NULL AS symbol, (k + 10)::INT AS last FROM l UNION ALL SELECT id, 1, 0, 1, 'part', 1 FROM l
    UNION ALL SELECT id, 2, 0, 1, NULL, (k + 5)::INT FROM l UNION ALL SELECT id, 3, 2, 2, 'type', 3 FROM l
    UNION ALL SELECT id, (3 + i)::INT, 2, 2, words[i], (3 + i)::INT FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM l)
    UNION ALL SELECT id, (k + 4)::INT, 2, 2, 'x', (k + 4)::INT FROM l UNION ALL SELECT id, (k + 6)::INT, 0, 1, NULL, (k + 9)::INT FROM l
    UNION ALL SELECT id, (k + 7)::INT, (k + 6)::INT, 2, 'size', (k + 7)::INT FROM l UNION ALL SELECT id, (k + 8)::INT, (k + 6)::INT, 2, size::VARCHAR, (k + 8)::INT FROM l""")
def sexpr_trees(spark, d):
    """``(part (type WORDS... x) (size N))`` for every part, as a table of spans."""
    p = star_graph(spark, d).vertices("part")
    lines = p.select("id", F.format_string("(part (type %s x) (size %d))", "type", "size").alias("value"))
    return trees.parse_trees(lines).select("id", "node", "parent", "depth", "symbol", "last")


def chain_fingerprint() -> str:
    """The fingerprint under which the flagship query's result would be kept."""
    return fingerprint(canonical(CHAIN)[0])
