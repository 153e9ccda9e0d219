"""Degree, triangles, rank, paths and embeddings."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.algo.projection import dense_index, project
from weft.cypher.ast import CypherError
from weft.plans.catalog import Catalog
from weft.storage import Scratch


def degree(g: Catalog, config: dict | None = None) -> DataFrame:
    """Stored edges; a self-loop counts in both."""
    nodes, edges = project(g, config)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return nodes.join(counts, "id", "left").select(F.col("id").alias("node_id"), zero("in_degree"), zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def triangle_count(g: Catalog, config: dict | None = None) -> DataFrame:
    """Triangles of the simple undirected graph. Edges point from the vertex of lower degree to that of higher, so that
    even a hub has few edges out and wedges stay of the order of m * sqrt(m)."""
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "triangles")
    pairs = scratch.write(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degrees = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    with_d = pairs.join(degrees.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degrees.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = scratch.write(with_d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = out.join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(pairs, (F.col("v") == F.col("a")) & (F.col("w") == F.col("b")), "left_semi")
    counts = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0)).cast("long")
    return nodes.join(degrees, "id", "left").join(counts, "id", "left").select(F.col("id").alias("node_id"), t.alias("triangles"), F.when(d >= 2, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def pagerank(g: Catalog, config: dict | None = None) -> DataFrame:
    """Scores add up to 1. Weights not above 0 are left out; what a vertex without edges out holds goes to all alike."""
    config = dict(config or {})
    damping, most, tolerance = config.pop("damping", 0.85), config.pop("max_iterations", 100), config.pop("tolerance", 1e-6)
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "pagerank")
    nodes = scratch.write(nodes)
    n = nodes.count()
    edges = edges.where("weight > 0")
    totals = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = scratch.write(edges.join(totals, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("total")).alias("share")))
    ends = shares.select(F.col("src").alias("id")).distinct().withColumn("flows", F.lit(True))
    rank = scratch.write(nodes.join(ends, "id", "left").select("id", F.coalesce("flows", F.lit(False)).alias("flows"), F.lit(1.0 / max(1, n)).alias("score")))
    loose = rank.where("NOT flows").count() / max(1, n)
    for _ in range(most if n else 0):
        sent = shares.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)
        new = scratch.write(rank.join(sent, F.col("id") == F.col("dst"), "left").select("id", "flows", score.alias("score"), F.abs(score - F.col("score")).alias("moved")))
        moved, loose = new.agg(F.sum("moved"), F.coalesce(F.sum(F.when(~F.col("flows"), F.col("score"))), F.lit(0.0))).first()
        scratch.drop(rank)
        rank = new.select("id", "flows", "score")
        if moved < tolerance:
            break
    return rank.select(F.col("id").alias("node_id"), "score")


def shortest_path(g: Catalog, config: dict | None = None) -> DataFrame:
    """Distance and hops from one source to all that it reaches; weighted by relaxing until nothing gets nearer."""
    config = dict(config or {})
    source, weighted = config.pop("source", None), config.pop("weighted", False)
    if source is None:
        raise CypherError("algo.shortest_path needs a source")
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "paths")
    edges = scratch.write(edges)
    if weighted and not edges.where("weight < 0").isEmpty():
        raise CypherError("a negative weight")
    cost = F.col("weight") if weighted else F.lit(1.0)
    best = scratch.write(nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("hops")))
    frontier = best
    while not frontier.isEmpty():
        reached = edges.join(frontier, F.col("src") == F.col("id")).groupBy("dst").agg(F.min(F.struct((F.col("distance") + cost).alias("distance"), (F.col("hops") + 1).alias("hops"))).alias("x"))
        nearer = reached.join(best.select(F.col("id").alias("dst"), F.struct("distance", "hops").alias("old")), "dst", "left").where(F.col("old").isNull() | (F.col("x") < F.col("old")))
        frontier = scratch.write(nearer.select(F.col("dst").alias("id"), "x.distance", "x.hops"))
        best = scratch.write(best.join(frontier, "id", "left_anti").select("id", "distance", "hops").unionByName(frontier))
    return best.select(F.col("id").alias("node_id"), "distance", "hops")


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; its constants are fixed values."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fast_rp(g: Catalog, config: dict[str, Any] | None = None) -> DataFrame:
    """Sparse random projections (±sqrt 3 with probability 1/6 each), averaged over neighbours hop by hop, each hop
    scaled to length one and added with its weight; by default weights 0, 1, 1, 1."""
    config = dict(config or {})
    dim, seed, strength = config.pop("dimension", 256), config.pop("seed", 42), config.pop("normalization_strength", 0.0)
    weights = config.pop("iteration_weights", None) or [0.0] + [1.0] * config.pop("iterations", 3)
    config.pop("iterations", None)
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "fastrp")
    nodes = scratch.write(nodes)
    places = dense_index(nodes, "id", scratch)
    degrees = edges.groupBy("src").agg(F.sum("weight").alias("d"))
    kind = dict(nodes.dtypes)["id"]

    def draw(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            at = b.column(1).to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                keys = at[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)[None, :] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
                u = (_mix(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            v = np.where(u < 1 / 6, np.sqrt(3), np.where(u >= 5 / 6, -np.sqrt(3), 0.0))
            v *= np.power(np.maximum(b.column(2).to_numpy(), 1.0), strength)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])

    start = places.join(degrees, F.col("id") == F.col("src"), "left").select("id", "index", F.coalesce("d", F.lit(1.0)).alias("d"))
    level = scratch.write(start.mapInArrow(draw, f"id {kind}, v array<double>"))
    total = level.select("id", F.transform("v", lambda x: x * weights[0]).alias("e"))
    edges = scratch.write(edges)
    for w in weights[1:]:
        summed = edges.join(level, F.col("dst") == F.col("id")).groupBy("src").agg(F.array(*[F.sum(F.col("weight") * F.get("v", F.lit(i))) for i in range(dim)]).alias("s"), F.sum("weight").alias("t"))
        mean = F.transform("s", lambda x: x / F.when(F.col("t") != 0, F.col("t")).otherwise(1.0))
        norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
        unit = summed.select("src", mean.alias("m")).withColumn("n", norm).select("src", F.transform("m", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0)).alias("u"))
        none = F.array_repeat(F.lit(0.0), dim)
        level = scratch.write(nodes.join(unit, F.col("id") == F.col("src"), "left").select("id", F.coalesce("u", none).alias("v")))
        total = scratch.write(total.join(level, "id").select("id", F.zip_with("e", "v", lambda a, b: a + b * w).alias("e")))
    return total.select(F.col("id").alias("node_id"), F.col("e").cast("array<float>").alias("embedding"))
