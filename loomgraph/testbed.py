"""A property graph over the star-schema tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table
from loomgraph.sources.catalog import GraphCatalog

#: Seconds of an interval for each whole unit of an event's value.
STRETCH = 20


def star_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col

    def vertices(source: str, id_: str, /, **properties: str) -> DataFrame:
        return t(source).select(c(id_).cast("long").alias("id"), *[c(v).alias(k) for k, v in properties.items()])

    def edges(source: str, src: str, dst: str, uid, /, **properties: str) -> DataFrame:
        return t(source).where(c(src).isNotNull() & c(dst).isNotNull()).select(c(src).cast("long").alias("src"), c(dst).cast("long").alias("dst"), uid.cast("long").alias("uid"), *[c(v).alias(k) for k, v in properties.items()])

    line = c("l_orderkey") * 16 + c("l_linenumber")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return GraphCatalog(
        spark,
        {
            "region": lambda: vertices("region", "r_regionkey", name="r_name"),
            "nation": lambda: vertices("nation", "n_nationkey", name="n_name"),
            "customer": lambda: vertices("customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
            "supplier": lambda: vertices("supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
            "orders": lambda: vertices("orders", "o_orderkey", status="o_orderstatus", priority="o_orderpriority", totalprice="o_totalprice"),
            "part": lambda: vertices("part", "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size"),
            "user": lambda: t("events").where("user_id IS NOT NULL").select(c("user_id").alias("id")).distinct(),
            "event": lambda: vertices("events", "event_id", event_type="event_type", value="value"),
            "interval": lambda: t("events").select(c("event_id").cast("long").alias("id"), c("event_type").alias("chr"), start.alias("start"), (start + F.floor("value") * STRETCH).alias("end")),
        },
        {
            ("nation", "in_region", "region"): lambda: edges("nation", "n_nationkey", "n_regionkey", c("n_nationkey")),
            ("customer", "in_nation", "nation"): lambda: edges("customer", "c_custkey", "c_nationkey", c("c_custkey")),
            ("supplier", "in_nation", "nation"): lambda: edges("supplier", "s_suppkey", "s_nationkey", c("s_suppkey")),
            ("customer", "placed", "orders"): lambda: edges("orders", "o_custkey", "o_orderkey", c("o_orderkey")),
            ("orders", "contains", "part"): lambda: edges("lineitem", "l_orderkey", "l_partkey", line, quantity="l_quantity", price="l_extendedprice", discount="l_discount", returnflag="l_returnflag"),
            ("supplier", "supplies", "part"): lambda: edges("lineitem", "l_suppkey", "l_partkey", line),
            ("supplier", "ships", "orders"): lambda: edges("lineitem", "l_suppkey", "l_orderkey", line),
            ("user", "emits", "event"): lambda: edges("events", "user_id", "event_id", c("event_id")),
        },
    )
