"""Clusters of mutually similar vectors by distributed bisecting k-means, with an exact check at the leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from weft.llm.groups import link_groups
from weft.llm.vectors import DIMENSION, matrix, packed
from weft.storage import Scratch

#: A node of at most this many vectors is split further inside one task.
BLOCK_ROWS = 24_000
#: Vectors from which the first two centres of each node are taken; all later steps use all vectors.
SEED_SAMPLE = 8192
#: Leaves under one pivot, about, and leaf centres that serve as pivots at most.
CELL_ROWS, PIVOTS = 16_384, 1024
#: Radians by which a bound on angles is widened, for single precision.
SLACK = 1e-3


@dataclass
class Tree:
    """Splitting planes: node i sends x to ``right[i]`` if x.w > b, else to ``left[i]``; a leaf has left -1."""

    w: list[np.ndarray] = field(default_factory=lambda: [np.zeros(DIMENSION, np.float32)])
    b: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])

    def split(self, node: int, w: np.ndarray, b: float) -> tuple[int, int]:
        n = len(self.w)
        for _ in range(2):
            self.w.append(np.zeros_like(w)), self.b.append(0.0), self.left.append(-1), self.right.append(-1)
        self.w[node], self.b[node], self.left[node], self.right[node] = w, b, n, n + 1
        return n, n + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        left, right, w, b = np.array(self.left), np.array(self.right), np.stack(self.w), np.array(self.b, np.float32)
        while len(rows := np.flatnonzero(left[at] >= 0)):
            node = at[rows]
            side = np.einsum("ij,ij->i", x[rows], w[node]) > b[node]
            at[rows] = np.where(side, right[node], left[node])
        return at


def _far_pair(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = x[np.argmin(x @ x.sum(0))]
    return a, x[np.argmin(x @ a)]


def _plane(c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, float]:
    """The plane of points as near to both centres, as unit normal and offset."""
    c0, c1 = c0 / max(np.linalg.norm(c0), 1e-9), c1 / max(np.linalg.norm(c1), 1e-9)
    w = c1 - c0
    n = np.linalg.norm(w)
    return (w / n).astype(np.float32) if n > 0 else w.astype(np.float32), 0.0


def fit_tree(units: DataFrame, n: int, block_rows: int = BLOCK_ROWS, rounds: int = 3) -> tuple[Tree, dict[int, int]]:
    """Split nodes of more than block_rows vectors by 2-means over all their vectors, all such nodes in each pass.

    A pass is one aggregate: each task sums its vectors by node and nearer centre, so the driver gets two sums a node.
    Nodes of equal vectors can't be split. The size of each leaf is returned with the tree.
    """
    tree, sizes, done = Tree(), {0: n}, set()
    sample = matrix(pa.array([r.unit for r in units.orderBy(F.xxhash64("vec_id")).limit(SEED_SAMPLE).collect()], pa.binary())) if n > block_rows else None
    while active := [k for k in sizes if sizes[k] > block_rows and k not in done and tree.left[k] < 0]:
        at = tree.place(sample)
        centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in active:
            own = sample[at == k]
            if len(own) > 1:
                centres[k] = _far_pair(own)
            else:
                done.add(k)
        stats: dict[tuple[int, bool], tuple] = {}
        for _ in range(rounds if centres else 0):
            planes = {k: _plane(*c) for k, c in centres.items()}

            def sums(batches: Iterator[pa.RecordBatch], planes=planes, tree=tree) -> Iterator[pa.RecordBatch]:
                total: dict[tuple[int, bool], list] = {}
                for batch in batches:
                    if batch.num_rows == 0:
                        continue
                    x = matrix(batch.column(0))
                    at = tree.place(x)
                    for k, (w, b) in planes.items():
                        own = x[at == k]
                        away = own @ w - b
                        for side in (False, True):
                            part = own[(away > 0) == side]
                            t = total.setdefault((k, side), [0, np.zeros(DIMENSION)])
                            t[0] += len(part)
                            t[1] = t[1] + part.sum(0, dtype=np.float64)
                if total:
                    yield pa.RecordBatch.from_pydict({"node": [k for k, _ in total], "side": [s for _, s in total], "n": [t[0] for t in total.values()], "sum": pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64()))})

            parts = units.select("unit").mapInArrow(sums, "node long, side boolean, n long, sum array<double>")
            merged = parts.groupBy("node", "side").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sum", F.lit(i))) for i in range(DIMENSION)]).alias("sum"))
            stats = {(r.node, r.side): (r.n, np.array(r["sum"])) for r in merged.collect()}
            centres = {k: (stats[k, False][1], stats[k, True][1]) if min(stats[k, False][0], stats[k, True][0]) else centres[k] for k in centres}
        for k in centres:
            (n0, s0), (n1, s1) = stats[k, False], stats[k, True]
            if min(n0, n1) == 0:
                done.add(k)
                continue
            l, r = tree.split(k, *_plane(s0, s1))
            sizes[l], sizes[r] = n0, n1
    return tree, {k: m for k, m in sizes.items() if tree.left[k] < 0}


def bisect(x: np.ndarray, similarity: float) -> np.ndarray:
    """Leaf number of each row: nodes are split by 2-means until all pairs of a leaf are similar.

    That holds if all rows are within half the angle of the centre, and else is tried directly where every row is as
    near to the centre as it must be.
    """
    leaf = np.full(len(x), -1)
    todo, number = [np.arange(len(x))], 0
    sure = math.sqrt((1 + similarity) / 2)
    while todo:
        at = todo.pop()
        own = x[at]
        centre = own.sum(0)
        centre /= max(np.linalg.norm(centre), 1e-9)
        near = own @ centre
        least = near.min()
        if least >= sure or len(at) == 1 or (least >= similarity - 1e-6 and len(at) <= 4096 and (own @ own.T).min() >= similarity):
            leaf[at] = number
            number += 1
            continue
        a = own[near.argmin()]
        b = own[(own @ a).argmin()]
        side = own @ (b - a) > 0
        for _ in range(4):
            if side.all() or not side.any():
                break
            w, offset = _plane(own[~side].sum(0), own[side].sum(0))
            new = own @ w > offset
            if (new == side).all():
                break
            side = new
        if side.all() or not side.any():  # the centres fell together: halves by distance from one end
            side = np.zeros(len(at), bool)
            side[np.argsort(own @ a, kind="stable")[: len(at) // 2]] = True
        todo += [at[side], at[~side]]
    return leaf


def neighbourhoods(x: np.ndarray, ids: np.ndarray, home: int, similarity: float) -> pa.Table:
    """Of the first ``home`` rows: number, least id and sum of hashes of all rows similar to each."""
    hashes = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.float64)
    degree, least, mark = np.zeros(home, np.int64), np.zeros(home, np.int64), np.zeros(home)
    step = max(1, 8_000_000 // max(1, len(x)))
    for a in range(0, home, step):
        b = min(home, a + step)
        r, c = np.nonzero(x[a:b] @ x.T >= similarity)
        degree[a:b] = np.bincount(r, minlength=b - a)
        mark[a:b] = np.bincount(r, weights=hashes[c], minlength=b - a)
        low = np.full(b - a, np.iinfo(np.int64).max)
        np.minimum.at(low, r, ids[c])
        least[a:b] = low
    return pa.table({"vec_id": ids[:home], "degree": degree, "least": least, "mark": mark})


def join_parts(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over the pairs a[i], b[i], in place; afterwards parent[x] is the least vertex of the part of x.

    A root is hung under the least root it is paired with; its other pairs stay unequal and are met in the next round.
    """
    while len(a):
        a, b = parent[a], parent[b]
        far = a != b
        a, b = a[far], b[far]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _unpacked(t: pa.Table, column: str = "unit") -> np.ndarray:
    return matrix(t.column(column))


def grow_leaves(units: DataFrame, scratch: Scratch, similarity: float, block_rows: int) -> DataFrame:
    """vec_id, unit, leaf, size, centre, radius: bisecting k-means over all vectors.

    Blocks are split over the cluster, each block inside a task until all pairs of a leaf are similar. A leaf is named
    by its least vec_id; size, centre and radius (the greatest angle to the centre) stand in the row of that vec_id. A
    node that can't be split and is larger than a block is handled in pieces.
    """
    tree, sizes = fit_tree(units, units.count(), block_rows)
    pieces = {k: -(-m // block_rows) for k, m in sizes.items() if m > block_rows}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, at = batch.column(0).to_numpy(), tree.place(matrix(batch.column(1)))
                many = np.array([pieces.get(k, 1) for k in at.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids % many), batch.column(0), batch.column(1)], ["block", "piece", "vec_id", "unit"])

    def split(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, x = t.column("vec_id").to_numpy(), _unpacked(t)
        number = bisect(x, similarity)
        order = np.lexsort((ids, number))
        first = np.r_[True, np.diff(number[order]) > 0]
        group = np.cumsum(first) - 1
        names = ids[order][first]
        sums = np.add.reduceat(x[order], np.flatnonzero(first), axis=0)
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        angles = np.arccos(np.clip(np.einsum("ij,ij->i", x[order], sums[group], dtype=np.float64), -1, 1))
        radius = np.maximum.reduceat(angles, np.flatnonzero(first))[group]
        counts = np.bincount(group)
        centre = [sums[g].tobytes() if f else None for g, f in zip(group.tolist(), first.tolist())]
        return pa.table({"vec_id": ids[order], "unit": t.column("unit").take(pa.array(order)), "leaf": names[group], "size": pa.array(np.where(first, counts[group], 0)), "centre": pa.array(centre, pa.binary()), "radius": pa.array(np.where(first, radius, 0))})

    dealt = units.mapInArrow(deal, "block long, piece long, vec_id long, unit binary")
    return scratch.write(dealt.groupBy("block", "piece").applyInArrow(split, "vec_id long, unit binary, leaf long, size long, centre binary, radius double"))


def touching_leaves(leaves: DataFrame, scratch: Scratch, similarity: float, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """node, group: leaves that may have similar vectors, linked directly or over others; leaves without link are left out.

    A vector similar to one of a leaf is within the leaf's radius and the angle of ``similarity`` of its centre. All
    vectors are compared with all centres by this bound, but where a pivot rules it out by the same bound: a leaf
    belongs to the nearest pivot, whose reach holds all vectors of its leaves. Pivots are leaf centres. Of two pivots
    the vectors of one are compared with the centres of the other. Each task joins leaves over all pairs it finds and
    gives one link from each leaf to the least leaf of its part, so links are as many as leaves and tasks. Vectors and
    leaves of a full pivot are dealt over pieces.
    """
    own = leaves.where("size > 0").select("leaf", "centre", "radius", "size")
    n = own.count()
    pivots = matrix(pa.array([r.centre for r in own.orderBy(F.xxhash64("leaf")).limit(min(PIVOTS, -(-n // cell_rows))).collect()], pa.binary()))
    theta = math.acos(similarity) + SLACK

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = matrix(batch.column(1)) @ pivots.T
                reach = np.arccos(np.clip(near.max(1).astype(np.float64), -1, 1)) + batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1)), pa.array(reach)], ["leaf", "centre", "radius", "size", "pivot", "reach"])

    placed = scratch.write(own.mapInArrow(home, "leaf long, centre binary, radius double, size long, pivot long, reach double"))
    reach, many, shares = np.zeros(len(pivots)), np.ones(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    for r in placed.groupBy("pivot").agg(F.max("reach").alias("reach"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("leaves")).collect():
        reach[r.pivot], many[r.pivot], shares[r.pivot] = r.reach + SLACK, -(-r.n // block_rows), -(-r.leaves // (2 * cell_rows))

    def dealt(x: np.ndarray, at: np.ndarray, number: np.ndarray, radius: np.ndarray, leaf: bool) -> tuple[np.ndarray, list[pa.Array]]:
        """Row numbers and the cells to which they go: (pivot and piece of vectors, pivot and piece of leaves)."""
        k = np.arange(len(pivots))
        rest = k <= at[:, None] if leaf else k >= at[:, None]
        row, other = np.nonzero(rest & (x @ pivots.T >= np.cos(np.minimum(reach + radius[:, None] + theta, math.pi))))
        mine, theirs = (shares, many) if leaf else (many, shares)
        copies = theirs[other]
        piece = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        row, other = np.repeat(row, copies), np.repeat(other, copies)
        cell = [at[row], number[row] % mine[at[row]]], [other, piece]
        return row, [pa.array(c) for side in (cell[::-1] if leaf else cell) for c in side]

    def deal_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                row, cell = dealt(matrix(part.column(2)), part.column(3).to_numpy(), part.column(0).to_numpy(), np.zeros(part.num_rows), False)
                yield pa.RecordBatch.from_arrays([*cell, part.column(1).take(pa.array(row)), part.column(2).take(pa.array(row))], ["p", "i", "q", "j", "leaf", "unit"])

    def deal_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                row, cell = dealt(matrix(part.column(1)), part.column(3).to_numpy(), part.column(0).to_numpy(), part.column(2).to_numpy(), True)
                yield pa.RecordBatch.from_arrays([*cell, *[part.column(c).take(pa.array(row)) for c in (0, 1, 2)]], ["p", "i", "q", "j", "leaf", "centre", "radius"])

    def link(vectors: pa.Table, centres: pa.Table) -> pa.Table:
        if not vectors.num_rows or not centres.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        x, c = _unpacked(vectors), _unpacked(centres, "centre")
        ids, at = np.unique(np.concatenate([vectors.column("leaf").to_numpy(), centres.column("leaf").to_numpy()]), return_inverse=True)
        to = at[len(x) :]
        least = np.cos(np.minimum(centres.column("radius").to_numpy() + theta, math.pi)).astype(np.float32)
        parent = np.arange(len(ids))
        step = max(1, 4_000_000 // len(c))
        for a in range(0, len(x), step):
            row, col = np.nonzero(x[a : a + step] @ c.T >= least)
            join_parts(parent, at[a + row], to[col])
        far = np.flatnonzero(parent != np.arange(len(ids)))
        return pa.table({"src": ids[far], "dst": ids[parent[far]]})

    key = ["p", "i", "q", "j"]
    vectors = leaves.select("vec_id", "leaf", "unit").join(placed.select("leaf", "pivot"), "leaf").select("vec_id", "leaf", "unit", "pivot")
    left = vectors.mapInArrow(deal_vectors, "p long, i long, q long, j long, leaf long, unit binary")
    right = placed.select("leaf", "centre", "radius", "pivot").mapInArrow(deal_leaves, "p long, i long, q long, j long, leaf long, centre binary, radius double")
    links = scratch.write(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(link, "src long, dst long").distinct())
    return link_groups(links)


def similarity_clusters(vectors: DataFrame, similarity: float = 0.85, least_size: int = 3, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, cluster_id, leaf of all vectors in sets of mutually similar vectors that no outside vector is similar to.

    ``vectors`` has vec_id (unique) and vector, all usable. Bisecting k-means splits the vectors until all pairs of a
    leaf are similar. A leaf that no other touches is a cluster if it is large enough. A plane may have cut a cluster,
    and a leaf may have similar vectors outside: leaves that touch are checked exactly. Each of their vectors is
    described by the number, least id and hash sum of the vectors similar to it; vectors that share this description
    and are as many as it says form a cluster. No pairs are written, and a large group of leaves is checked in pieces,
    each against the group. An empty table gives no rows; copies are ordinary similar vectors.
    """
    scratch = Scratch(vectors.sparkSession, "clusters")
    units = scratch.write(packed(vectors, "vec_id", "vector"))
    leaves = grow_leaves(units, scratch, similarity, block_rows)
    if leaves.isEmpty():
        return leaves.select("vec_id", F.col("leaf").alias("cluster_id"), "leaf")
    groups = scratch.write(touching_leaves(leaves, scratch, similarity, block_rows, cell_rows).withColumnRenamed("node", "leaf"))

    alone = leaves.join(groups, "leaf", "left_anti")
    sizes = alone.where(F.col("size") >= least_size).select("leaf")
    single = alone.select("vec_id", "leaf").join(sizes, "leaf").select("vec_id", F.col("leaf").alias("cluster_id"), "leaf")

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.argsort(~t.column("home").to_numpy(zero_copy_only=False), kind="stable")
        return neighbourhoods(_unpacked(t)[order], t.column("vec_id").to_numpy()[order], int(t.column("home").to_numpy(zero_copy_only=False).sum()), similarity)

    rows = scratch.write(leaves.select("vec_id", "unit", "leaf").join(groups, "leaf"))
    pieces = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("pieces"))
    spread = rows.join(pieces, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.pmod("vec_id", "pieces").alias("own"), "vec_id", "unit")
    cells = spread.select("group", "piece", (F.col("own") == F.col("piece")).alias("home"), "vec_id", "unit")
    solved = scratch.write(cells.groupBy("group", "piece").applyInArrow(solve, "vec_id long, degree long, least long, mark double"))
    whole = solved.where(F.col("degree") >= least_size).groupBy("least", "degree", "mark").agg(F.count(F.lit(1)).alias("n")).where("n = degree")
    checked = solved.join(whole, ["least", "degree", "mark"]).join(rows.select("vec_id", "leaf"), "vec_id").select("vec_id", F.col("least").alias("cluster_id"), "leaf")
    return single.unionByName(checked)


def describe(clusters: DataFrame, vectors: DataFrame, members: int = 5) -> DataFrame:
    """cluster_id, size, n_leaves, dispersion (mean of 1 - cosine to the centre), typical (the nearest vec_ids, in order).

    Centres are sums of unit vectors, summed in the tasks first; ties in nearness go to the smaller vec_id.
    """
    rows = Scratch(vectors.sparkSession, "describe").write(packed(vectors, "vec_id", "vector").join(clusters, "vec_id"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            total = np.zeros((len(ids), DIMENSION))
            np.add.at(total, at, matrix(batch.column(1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total.tolist(), pa.list_(pa.float64()))], ["cluster_id", "sum"])

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = np.array(batch.column(3).to_pylist(), np.float64)
            near = np.einsum("ij,ij->i", matrix(batch.column(2)).astype(np.float64), c) / np.linalg.norm(c, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["cluster_id", "vec_id", "near"])

    parts = rows.select("cluster_id", "unit").mapInArrow(sums, "cluster_id long, sum array<double>")
    centres = parts.groupBy("cluster_id").agg(F.array(*[F.sum(F.get("sum", F.lit(i))) for i in range(DIMENSION)]).alias("centre"))
    near = rows.join(centres, "cluster_id").select("cluster_id", "vec_id", "unit", "centre").mapInArrow(nearness, "cluster_id long, vec_id long, near double")
    near = Scratch(vectors.sparkSession, "nearness").write(near)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("rank") <= members)
    typical = ranked.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("typical"))
    sizes = near.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg(1 - F.col("near")).alias("dispersion"))
    leaves = rows.groupBy("cluster_id").agg(F.count_distinct("leaf").alias("n_leaves"))
    return sizes.join(leaves, "cluster_id").join(typical, "cluster_id").select("cluster_id", "size", "n_leaves", F.round("dispersion", 6).alias("dispersion"), "typical")
