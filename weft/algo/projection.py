"""The part of a graph that an algorithm runs on, and the steps that algorithms share."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from weft.cypher.ast import CypherError
from weft.plans.catalog import Catalog
from weft.storage import Scratch

COMMON = {"labels", "edge_types", "direction"}


def project(g: Catalog, config: dict[str, Any] | None, also: set[str] = frozenset(), undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst, weight) of the induced subgraph.

    Unknown labels, edge types and settings are errors. ``weight`` is that numeric property, else (also if it isn't finite) 1. Undirected gives
    each edge both ways, a self-loop once.
    """
    config = dict(config or {})
    if extra := set(config) - COMMON - set(also):
        raise CypherError(f"unknown setting {sorted(extra)[0]}")
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x or ())
    labels, types = as_tuple(config.get("labels")), as_tuple(config.get("edge_types"))
    for x in labels:
        if x not in g.labels():
            raise CypherError(f"unknown label {x}")
    for x in types:
        if x not in g.types():
            raise CypherError(f"unknown edge type {x}")
    nodes = g.scan(labels, True, set()).select("id").distinct()
    tables = g.edge_tables(types)
    parts = g.edge_scan(tables)
    numeric = "weight" in parts.columns and dict(parts.dtypes)["weight"] in ("double", "bigint")
    w = F.col("weight").cast("double") if numeric else F.lit(1.0)
    weight = F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(w)
    edges = parts.select("src", "dst", weight.alias("weight"))
    edges = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    direction = "undirected" if undirected else config.get("direction", "natural")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    if direction == "reverse":
        edges = back
    elif direction == "undirected":
        edges = edges.unionByName(back.where("src <> dst"))
    elif direction != "natural":
        raise CypherError(f"unknown direction {direction}")
    return nodes, edges


def dense_index(ids: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """column, index: 0, 1, 2 … in the order of the values, which must be distinct. No task sees more than its own range."""
    ranged = scratch.write(ids.select(column).orderBy(column).select(column, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("part").collect()
    offsets, total = [], 0
    for r in sizes:  # one row a partition
        offsets.append((r["part"], total - r["first"]))
        total += r["n"]
    if not offsets:
        return ranged.select(column, F.lit(0).cast("long").alias("index"))
    shift = F.broadcast(ids.sparkSession.createDataFrame(offsets, "part int, shift long"))
    return ranged.join(shift, "part").select(column, (F.col("at") + F.col("shift")).alias("index"))
