"""Weak and strong components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.algo.projection import dense_index, project
from weft.plans.catalog import Catalog
from weft.storage import Scratch


def weak_roots(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root: the least id of each weak component. Alternating star contraction: the edges shrink to stars.

    A round hangs every larger neighbour of a vertex, then every smaller one, below the least it knows; the number of
    rounds grows with the logarithm of the component's diameter.
    """
    pairs = scratch.write(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(pairs)
    while seen[0]:
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct()
        new = scratch.write(small)
        now = mark(new)
        scratch.drop(pairs)
        pairs = new
        if now == seen:
            break
        seen = now
    roots = pairs.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, F.col("id") == F.col("a"), "left").select("id", F.coalesce("root", "id").alias("root"))


def numbered(found: DataFrame, scratch: Scratch) -> DataFrame:
    """node_id, component: components numbered in the order of their least node."""
    found = scratch.write(found)
    order = dense_index(found.select("root").distinct(), "root", scratch)
    return found.join(order, "root").select(F.col("id").alias("node_id"), F.col("index").alias("component"))


def wcc(g: Catalog, config: dict | None = None) -> DataFrame:
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "wcc")
    return numbered(weak_roots(scratch.write(nodes), edges, scratch), scratch)


def scc(g: Catalog, config: dict | None = None) -> DataFrame:
    """Colouring: the greatest id that reaches a vertex is its colour; what reaches the colour's own vertex inside it is
    a strong component. Vertices without an edge in or out are cut off first."""
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "scc")
    nodes = scratch.write(nodes)
    left_nodes, left_edges = nodes, scratch.write(edges.where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    while not left_nodes.isEmpty():
        live = left_edges.select(F.col("src").alias("id")).distinct().join(left_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        live = scratch.write(left_nodes.join(live, "id", "left_semi"))
        cut = scratch.write(left_nodes.join(live, "id", "left_anti"))
        if not cut.isEmpty():
            done.append(cut.select("id", F.col("id").alias("root")))
            left_nodes, left_edges = live, _inside(left_edges, live, scratch)
            continue
        colours = scratch.write(left_nodes.select("id", F.col("id").alias("colour")))
        while True:
            sent = left_edges.join(colours, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("colour").alias("c"))
            new = scratch.write(colours.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("moved")))
            stable = new.where("moved").isEmpty()
            scratch.drop(colours)
            colours = new.select("id", "colour")
            if stable:
                break
        inner = left_edges.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst")
        inner = scratch.write(inner)
        reached = scratch.write(colours.where("id = colour"))
        frontier = reached
        while not frontier.isEmpty():
            back = inner.join(frontier, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "colour").distinct()
            frontier = scratch.write(back.join(reached, "id", "left_anti"))
            reached = scratch.write(reached.select("id", "colour").unionByName(frontier))
        groups = reached.join(reached.groupBy("colour").agg(F.min("id").alias("root")), "colour").select("id", "root")
        done.append(scratch.write(groups))
        left_nodes = scratch.write(left_nodes.join(reached, "id", "left_anti"))
        left_edges = _inside(left_edges, left_nodes, scratch)
    found = nodes.select("id", F.col("id").alias("root")).limit(0)
    for d in done:
        found = found.unionByName(d)
    return numbered(found, scratch)


def _inside(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    ids = nodes.select("id")
    return scratch.write(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
