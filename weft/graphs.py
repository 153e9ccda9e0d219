"""The graphs over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from weft.functions.ids import plain_id
from weft.plans.catalog import Catalog, tagged
from weft.sources.tables import table

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, ITEM, USER, EVENT = range(1, 10)


def trade_graph(spark: SparkSession, d: str) -> Catalog:
    """Regions to line items, and users with events. A line item has no key, so each row gets a number of its own."""
    g = Catalog(spark)
    t = lambda name: table(spark, d, name)
    key = lambda number, c: tagged(number, F.col(c))
    region, nation, customer, supplier, part, orders = (t(n) for n in ("region", "nation", "customer", "supplier", "part", "orders"))
    g.register_nodes("Region", region.selectExpr("r_regionkey AS key", "r_name AS name"), key(REGION, "key"))
    g.register_nodes("Nation", nation.selectExpr("n_nationkey AS key", "n_name AS name"), key(NATION, "key"))
    g.register_nodes("Customer", customer.selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"), key(CUSTOMER, "key"))
    g.register_nodes("Supplier", supplier.selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance"), key(SUPPLIER, "key"))
    g.register_nodes("Part", part.selectExpr("p_partkey AS key", "p_name AS name", "p_brand AS brand", "p_type AS type", "p_size AS size", "p_retailprice AS price"), key(PART, "key"))
    g.register_nodes("Order", orders.selectExpr("o_orderkey AS key", "o_orderstatus AS status", "o_totalprice AS total", "o_orderdate AS date", "o_orderpriority AS priority"), key(ORDER, "key"))
    g.register_edges("IN_REGION", nation.select(key(NATION, "n_nationkey").alias("a"), key(REGION, "n_regionkey").alias("b")), "a", "b", "Nation", "Region", True)
    g.register_edges("IN_NATION", customer.select(key(CUSTOMER, "c_custkey").alias("a"), key(NATION, "c_nationkey").alias("b")), "a", "b", "Customer", "Nation", True)
    g.register_edges("IN_NATION", supplier.select(key(SUPPLIER, "s_suppkey").alias("a"), key(NATION, "s_nationkey").alias("b")), "a", "b", "Supplier", "Nation", True)
    g.register_edges("PLACED", orders.select(key(CUSTOMER, "o_custkey").alias("a"), key(ORDER, "o_orderkey").alias("b")), "a", "b", "Customer", "Order", True)
    # a purchase joins an order and a part; rows of one pair are summed, since there is one edge a pair
    bought = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("lines"))
    g.register_edges("CONTAINS", bought.select(key(ORDER, "l_orderkey").alias("a"), key(PART, "l_partkey").alias("b"), "quantity", "price", "lines"), "a", "b", "Order", "Part", True)
    events = t("events")
    g.register_nodes("User", events.selectExpr("user_id AS key").distinct(), key(USER, "key"))
    g.register_nodes("Event", events.selectExpr("event_id AS key", "ts", "event_type AS kind", "value"), key(EVENT, "key"))
    g.register_edges("DID", events.select(key(USER, "user_id").alias("a"), key(EVENT, "event_id").alias("b")), "a", "b", "User", "Event", True)
    return g


def social_graph(spark: SparkSession, d: str) -> Catalog:
    """Persons, posts and comments with the current edges: of each (type, src, dst) the last row, unless a tombstone."""
    g = Catalog(spark)
    nodes = table(spark, d, "graph_nodes").where("node_id IS NOT NULL").withColumn("node_id", plain_id("node_id"))
    kinds = dict(nodes.dtypes)
    first = nodes.groupBy("node_id", "label").agg(F.min(F.struct(*[c for c in kinds if c not in ("node_id", "label")])).alias("x")).select("node_id", "label", "x.*")
    for label in ("Person", "Post", "Comment"):
        own = first.where(F.col("label") == label)
        cols = ["firstname", "lastname", "age"] if label == "Person" else ["content_chars"]
        g.register_nodes(label, own.select("node_id", *cols, "creationdate"), "node_id")
    rels = table(spark, d, "rels").where("src IS NOT NULL AND dst IS NOT NULL").select("edge_type", plain_id("src").alias("s"), plain_id("dst").alias("t"), F.struct("lsn", F.coalesce("tombstone", F.lit(False)).alias("gone"), "since", "weight").alias("v"))
    for kind in ("KNOWS", "LIKES", "HAS_CREATOR", "REPLY_OF", "LINKS_TO", "SAME_AS"):
        last = rels.where(F.col("edge_type") == kind).groupBy("s", "t").agg(F.max("v").alias("v")).where("NOT v.gone")
        g.register_edges(kind, last.select("s", "t", "v.since", "v.weight"), "s", "t", unique=True)
    return g


__all__ = ["social_graph", "trade_graph"]
