"""Communities by moves in node order, and betweenness.

Label propagation and modularity moves depend on the order of the moves, so a weak component is worked on by one task;
a component of more than COMPONENT_EDGES edges is refused.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.algo.components import weak_roots
from weft.algo.projection import dense_index, project
from weft.cypher.ast import CypherError
from weft.plans.catalog import Catalog
from weft.storage import Scratch

#: Edges that betweenness sends to every task at most; beyond them the search runs as joins.
SENT_EDGES = 20_000_000
#: (Source, vertex) rows that the search by joins makes at once, about: sources go in batches.
SOURCE_ROWS = 2_000_000_000
#: Edges of a weak component, both ways, that label propagation and Louvain take at most.
COMPONENT_EDGES = 20_000_000


def _adjacency(t: pa.Table) -> tuple[np.ndarray, list[dict[int, float]]]:
    """Sorted ids of a component and the weights between them, from rows (id) and (id, other, weight)."""
    a, b, w = t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("w").to_numpy()
    ids = np.unique(a)
    links: list[dict[int, float]] = [{} for _ in ids]
    for x, y, z in zip(np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist(), w.tolist()):
        if z == z:
            links[x][y] = links[x].get(y, 0.0) + z
    return ids, links


def _per_component(g: Catalog, config: dict | None, solve, name: str) -> DataFrame:
    """Run ``solve(ids, links)`` for every weak component; communities are numbered by their least node."""
    nodes, edges = project(g, config, undirected=True)
    scratch = Scratch(g.spark, name)
    nodes = scratch.write(nodes)
    # a loop counts for both of its ends
    edges = scratch.write(edges.groupBy("src", "dst").agg((F.sum("weight") * F.when(F.col("src") == F.col("dst"), 2.0).otherwise(1.0)).alias("weight")))
    index = dense_index(nodes, "id", scratch)
    index = scratch.write(index)
    roots = weak_roots(nodes, edges, scratch)
    rows = edges.join(index.select(F.col("id").alias("src"), F.col("index").alias("a")), "src").join(index.select(F.col("id").alias("dst"), F.col("index").alias("b")), "dst").join(roots.withColumnRenamed("id", "src"), "src").select("root", "a", "b", F.col("weight").alias("w"))
    rows = scratch.write(rows)
    most = rows.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    if most > COMPONENT_EDGES:
        raise CypherError(f"a weak component has {most} edges, more than {COMPONENT_EDGES}: its moves have an order, so one task would hold it")
    alone = index.join(roots, "id").select("root", F.col("index").alias("a"), F.col("index").alias("b"), F.lit(float("nan")).alias("w"))
    total = edges.agg(F.sum("weight")).first()[0] or 0.0

    def run(t: pa.Table) -> pa.Table:
        ids, links = _adjacency(t.combine_chunks())
        label = solve(links, total)
        least: dict[int, int] = {}
        for i, c in enumerate(label):
            least.setdefault(c, i)
        return pa.table({"index": ids, "first": ids[[least[c] for c in label]]})

    found = scratch.write(rows.unionByName(alone).groupBy("root").applyInArrow(run, "index long, first long"))
    order = dense_index(found.select("first").distinct(), "first", scratch).withColumnRenamed("index", "community")
    return found.join(order, "first").join(index, "index").select(F.col("id").alias("node_id"), "community")


def label_propagation(g: Catalog, config: dict | None = None) -> DataFrame:
    config = dict(config or {})
    most = config.pop("max_iterations", 10)

    def solve(links: list[dict[int, float]], total: float) -> list[int]:
        label = list(range(len(links)))
        for _ in range(most):
            moved = False
            for i, near in enumerate(links):
                votes: dict[int, float] = {}
                for j, w in near.items():
                    if j != i:
                        votes[label[j]] = votes.get(label[j], 0.0) + w
                if not votes:
                    continue
                top = max(votes.values())
                if votes.get(label[i]) != top:
                    label[i] = min(c for c, v in votes.items() if v == top)
                    moved = True
            if not moved:
                break
        return label

    return _per_component(g, config, solve, "labels")


def louvain(g: Catalog, config: dict | None = None) -> DataFrame:
    config = dict(config or {})
    levels, most, tolerance = config.pop("max_levels", 10), config.pop("max_iterations", 10), config.pop("tolerance", 1e-4)

    def solve(links: list[dict[int, float]], total: float) -> list[int]:
        member = list(range(len(links)))
        m2 = total or 1.0
        for _ in range(levels):
            strength = [sum(near.values()) for near in links]
            label, weight = list(range(len(links))), list(strength)
            gained = 0.0
            for _ in range(most):
                gain, moved = 0.0, False
                for i, near in enumerate(links):
                    own = label[i]
                    to: dict[int, float] = {own: 0.0}
                    for j, w in near.items():
                        if j != i:
                            to[label[j]] = to.get(label[j], 0.0) + w
                    weight[own] -= strength[i]
                    score = {c: w - strength[i] * weight[c] / m2 for c, w in to.items()}
                    top = max(score.values())
                    best = own if score[own] >= top - 1e-12 else min(c for c, s in score.items() if s >= top - 1e-12)
                    gain += 2 * (score[best] - score[own]) / m2
                    weight[best] += strength[i]
                    label[i] = best
                    moved |= best != own
                gained += gain
                if not moved:
                    break
            names = {c: k for k, c in enumerate(sorted(set(label)))}
            label = [names[c] for c in label]
            member = [label[c] for c in member]
            if gained < tolerance or len(names) == len(links):
                break
            merged: list[dict[int, float]] = [{} for _ in names]
            for i, near in enumerate(links):
                for j, w in near.items():
                    merged[label[i]][label[j]] = merged[label[i]].get(label[j], 0.0) + w
            links = merged
        return member

    return _per_component(g, config, solve, "louvain")


def betweenness(g: Catalog, config: dict | None = None) -> DataFrame:
    """Pairs of others whose shortest paths pass a node, by their share of these paths; undirected counts a pair once."""
    nodes, edges = project(g, config)
    scratch = Scratch(g.spark, "between")
    nodes = scratch.write(nodes)
    index = scratch.write(dense_index(nodes, "id", scratch))
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    pairs = pairs.join(index.select(F.col("id").alias("src"), F.col("index").alias("a")), "src").join(index.select(F.col("id").alias("dst"), F.col("index").alias("b")), "dst").select("a", "b")
    pairs = scratch.write(pairs)
    half = 0.5 if (config or {}).get("direction") == "undirected" else 1.0
    n, m = nodes.count(), pairs.count()
    if m <= SENT_EDGES:
        t = pairs.toArrow()
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        order = np.argsort(a, kind="stable")
        sent = g.spark.sparkContext.broadcast((np.searchsorted(a[order], np.arange(n + 1)), b[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, ends = sent.value
            score = np.zeros(n)
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    paths, far = {s: 1.0}, {s: 0}
                    before: dict[int, list[int]] = {}
                    seen, todo = [], deque([s])
                    while todo:
                        v = todo.popleft()
                        seen.append(v)
                        for w in ends[starts[v] : starts[v + 1]].tolist():
                            if w not in far:
                                far[w], paths[w] = far[v] + 1, 0.0
                                todo.append(w)
                            if far[w] == far[v] + 1:
                                paths[w] += paths[v]
                                before.setdefault(w, []).append(v)
                    share = dict.fromkeys(seen, 0.0)
                    for w in reversed(seen):
                        for v in before.get(w, ()):
                            share[v] += paths[v] / paths[w] * (1 + share[w])
                        if w != s:
                            score[w] += share[w]
            hit = np.flatnonzero(score)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(score[hit])], ["index", "part"])

        parts = index.select("index").repartition(g.spark.sparkContext.defaultParallelism).mapInArrow(run, "index long, part double")
    else:
        batches, parts = -(-n * n // SOURCE_ROWS), None
        for k in range(batches):
            part = scratch.write(_between_by_joins(index.where(F.pmod("index", F.lit(batches)) == k), pairs, scratch).groupBy("index").agg(F.sum("part").alias("part")))
            parts = part if parts is None else parts.unionByName(part)
    total = parts.groupBy("index").agg((F.sum("part") * half).alias("score"))
    return index.join(total, "index", "left").select(F.col("id").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _between_by_joins(index: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for graphs that no task can hold: breadth first from all sources at once, then back level by level."""
    level = scratch.write(index.select(F.col("index").alias("s"), F.col("index").alias("v"), F.lit(1.0).alias("paths")))
    seen = level.select("s", "v")
    levels = [level]
    while True:
        grown = level.join(pairs, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v2")).agg(F.sum("paths").alias("paths")).withColumnRenamed("v2", "v")
        level = scratch.write(grown.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = scratch.write(seen.unionByName(level.select("s", "v")))
    out = None
    below = levels[-1].withColumn("share", F.lit(0.0))
    for upper in reversed(levels[:-1]):
        given = upper.join(pairs, F.col("v") == F.col("a")).join(below.select("s", F.col("v").alias("b"), F.col("paths").alias("p2"), "share"), ["s", "b"])
        share = given.groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("p2") * (1 + F.col("share"))).alias("share"))
        part = below.where("s <> v").select(F.col("v").alias("index"), F.col("share").alias("part"))
        out = part if out is None else out.unionByName(part)
        below = scratch.write(upper.join(share, ["s", "v"], "left").fillna(0.0, ["share"]))
    return out if out is not None else index.select("index", F.lit(0.0).alias("part"))
