"""A versioned graph over the relational sample tables: months for trade, days for users, turns for conversations."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import ranges as R
from ..plans.graph import Elements, Graph, Lazy
from ..plans.schema import Edge, Node, Property, Schema

P = Property
SCHEMA = Schema(
    nodes=(
        Node("Region", (P("r_regionkey", "int"), P("r_name", "string")), ("r_regionkey",)),
        Node("Nation", (P("n_nationkey", "int"), P("n_name", "string")), ("n_nationkey",)),
        Node("Customer", (P("c_custkey", "long"), P("c_name", "string"), P("c_mktsegment", "string"), P("c_acctbal", "double")), ("c_custkey",)),
        Node("Supplier", (P("s_suppkey", "long"), P("s_name", "string"), P("s_acctbal", "double")), ("s_suppkey",)),
        Node("Part", (P("p_partkey", "long"), P("p_name", "string"), P("p_brand", "string"), P("p_size", "int")), ("p_partkey",)),
        Node("Order", (P("o_orderkey", "long"), P("o_orderstatus", "string"), P("o_totalprice", "double"), P("o_orderpriority", "string")), ("o_orderkey",)),
        Node("User", (P("user_id", "long"), P("event_type", "string"), P("value", "double")), ("user_id",)),
        Node("Turn", (P("conv_id", "long"), P("turn", "long"), P("role", "string")), ("conv_id", "turn")),
    ),
    edges=(
        Edge("placed_by", "Order", "Customer"), Edge("in_nation", "Customer", "Nation"), Edge("from_nation", "Supplier", "Nation"), Edge("in_region", "Nation", "Region"),
        Edge("contains", "Order", "Part", (P("qty", "double"), P("price", "double")), "*", "*"), Edge("is_customer", "User", "Customer", (), "?", "?"),
        Edge("next_turn", "Turn", "Turn", (), "?", "?"), Edge("ring", "Region", "Region", (), "1", "1"),
    ),
    name="trade",
)


def month(c: Column) -> Column:
    return ((F.year(c) - 1995) * 12 + F.month(c) - 1).cast("int")


def user_rows(events: DataFrame) -> DataFrame:
    """A user's last event of a day holds until the next day with events; a day that ends in an error is a gap."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    last = events.groupBy("user_id", day.alias("f")).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e"))
    following = F.lead("f").over(Window.partitionBy("user_id").orderBy("f"))
    rows = last.select("user_id", "f", F.coalesce(following - 1, F.lit(R.HEAD)).alias("t"), "e.event_type", "e.value")
    return rows.filter("event_type <> 'error'")


def sample_graph(spark: SparkSession, sf_dir: str, recorded: bool = False) -> Graph:
    """The graph; with ``recorded`` a user's histories have an entry for each day of ``user_rows``, neighbours of one value too."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    long = lambda c: F.col(c).cast("long")
    always = [F.lit(0).alias("f"), F.lit(R.HEAD).alias("t")]

    def node(df: DataFrame, id_: Column, props: list[str], span=always) -> Elements:
        return Elements(df.select(id_.alias("id"), *(F.col(p).alias(f"p_{p}") for p in props), *span), True, frozenset(props), tuple(props))

    def edge(df: DataFrame, id_: Column, src: Column, dst: Column, span=always, props=()) -> Elements:
        return Elements(df.select(id_.alias("id"), src.alias("src"), dst.alias("dst"), *(F.col(p).alias(f"p_{p}") for p in props), *span), True, frozenset(props), tuple(props))


    @cache
    def orders() -> DataFrame:
        df = table("orders").withColumn("f", month(F.col("o_orderdate")))
        return df.withColumn("t", F.when(F.col("o_orderstatus") == "F", F.col("f") + (F.col("o_orderkey") % 12).cast("int")).otherwise(F.lit(R.HEAD)))

    @cache
    def lines() -> DataFrame:
        order = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
        df = table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct(*order)).alias("x")).select("l_orderkey", "l_partkey", "x.*")
        return df.withColumn("f", month(F.col("l_shipdate"))).select("l_orderkey", "l_partkey", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), "f", F.when(F.col("l_returnflag") == "R", F.col("f") + 6).otherwise(F.lit(R.HEAD)).alias("t"))

    @cache
    def users() -> DataFrame:
        order = F.sort_array if recorded else R.history
        entry = lambda v: order(F.collect_list(F.struct("f", "t", F.col(v).alias("v")))).alias(f"p_{v}")
        return user_rows(table("events")).groupBy("user_id").agg(R.normalize(F.collect_list(F.struct("f", "t"))).alias("rs"), entry("event_type"), entry("value")).select(long("user_id").alias("id"), F.col("user_id").alias("p_user_id"), "p_event_type", "p_value", "rs")

    @cache
    def turns() -> DataFrame:
        return table("conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))

    @cache
    def steps() -> DataFrame:
        following = turns().select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("id").alias("id2"))
        return turns().join(following, (turns()["conv_id"] == following["c2"]) & (turns()["turn"] + 1 == following["t2"]))

    span = [F.col("f"), F.col("t")]
    nodes = Lazy({
        "Region": lambda: node(table("region"), long("r_regionkey"), ["r_regionkey", "r_name"]),
        "Nation": lambda: node(table("nation"), long("n_nationkey"), ["n_nationkey", "n_name"]),
        "Customer": lambda: node(table("customer"), long("c_custkey"), ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]),
        "Supplier": lambda: node(table("supplier"), long("s_suppkey"), ["s_suppkey", "s_name", "s_acctbal"]),
        "Part": lambda: node(table("part"), long("p_partkey"), ["p_partkey", "p_name", "p_brand", "p_size"]),
        "Order": lambda: node(orders(), long("o_orderkey"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], span),
        "User": lambda: Elements(users(), False, frozenset(["user_id"]), ("user_id", "event_type", "value")),
        "Turn": lambda: node(turns(), F.col("id"), ["conv_id", "turn", "role"]),
    })
    edges = Lazy({
        "placed_by": lambda: edge(orders(), long("o_orderkey"), long("o_orderkey"), long("o_custkey"), span),
        "in_nation": lambda: edge(table("customer"), long("c_custkey"), long("c_custkey"), long("c_nationkey")),
        "from_nation": lambda: edge(table("supplier"), long("s_suppkey"), long("s_suppkey"), long("s_nationkey")),
        "in_region": lambda: edge(table("nation"), long("n_nationkey"), long("n_nationkey"), long("n_regionkey")),
        "contains": lambda: edge(lines(), F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey"), F.col("l_orderkey"), F.col("l_partkey"), span, ("qty", "price")),
        "is_customer": lambda: Elements(users().select("id", F.col("id").alias("src"), F.col("id").alias("dst"), "rs"), False, frozenset(), ()),
        "next_turn": lambda: edge(steps(), F.col("id"), F.col("id"), F.col("id2")),
        "ring": lambda: edge(table("region"), long("r_regionkey"), long("r_regionkey"), (F.col("r_regionkey") + 1).cast("long") % 5, [F.col("r_regionkey").cast("int").alias("f"), (90 - F.col("r_regionkey")).cast("int").alias("t")]),
    })
    return Graph(SCHEMA, nodes, edges, spark)
