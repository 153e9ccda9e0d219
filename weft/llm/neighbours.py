"""The most similar vectors of every query vector: an NN-descent graph and greedy search over it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from weft.llm.vectors import DIMENSION, as_bytes, listed, matrix, packed
from weft.storage import Scratch

#: Links of a vertex, random dealings that give the first ones, vertices dealt together, and members compared at once.
LINKS, DEALS, ROOM, GROUP = 10, 2, 1024, 40
#: Offers that a member takes from one meeting, and the share of new links under which the descent ends.
OFFERS, CHANGE = 3, 0.1
#: Vertices of a block of the search, about; blocks that a query enters, and vertices that it starts from in each.
BLOCK, PROBES, ENTRIES = 512, 3, 2
#: Best vertices kept for a query while searching, those expanded in one step, and the share of asking queries under which it ends.
BEAM, WIDTH, SETTLED = 16, 4, 0.01
#: The planes between blocks are set at the medians of at most this many vectors; every vector is put into a block.
PLANE_SAMPLE = 8192
#: Queries at one block beyond which the block is copied.
HOT_BLOCK = 4096


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, unit, code: units as float32 bytes and an equality code of the direction."""
    units = packed(df, key, vector)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rounded = np.round(matrix(batch.column(1)) * 1e6).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), as_bytes(rounded)], [key, "unit", "code"])

    return units.mapInArrow(code, f"{key} long, unit binary, code binary").select(key, "unit", F.md5("code").alias("code"))


def _short(x: np.ndarray) -> np.ndarray:
    """Rows as signed bytes of their direction; cosines are kept to about 0.001."""
    return np.round(x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-9) * 127).astype(np.int8)


def _long(column: pa.Array) -> np.ndarray:
    x = matrix(column, "int8").astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row."""
    k = min(k, s.shape[1])
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int, enough: int = 20_000) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``enough`` rows that never cut a key (the first ``keys`` columns)."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        same = np.ones(len(t), bool)
        for c in range(keys):
            column = t.column(c).to_numpy()
            same &= column == column[-1]
        end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if end:
            yield t.slice(0, end)
        kept = t.slice(end).to_batches()
        rows = len(t) - end
        enough = max(20_000, 2 * rows)
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


def _top(df: DataFrame, owner: str, k: int) -> DataFrame:
    """owner, nb, sim, fresh: the k rows of greatest sim of each owner, each nb once; a link that was there isn't fresh."""
    once = df.repartition(owner).groupBy(owner, "nb").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("sim"), "nb"))
    return once.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def random_links(nodes: DataFrame, n: int) -> DataFrame:
    """id, nb, sim: the best few of ROOM vertices drawn at random, for every vertex and dealing."""
    rooms = -(-n // ROOM)
    rows = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"), "id", "unit")
    dealt = rows.withColumn("room", F.pmod(F.xxhash64("id", "deal"), F.lit(rooms))).select("deal", "room", "id", "unit")
    each = -(-LINKS // DEALS) + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches, 2):
            deal, room, ids, x = t.column("deal").to_numpy(), t.column("room").to_numpy(), t.column("id").to_numpy(), _long(t.column("unit"))
            ends = np.flatnonzero(np.r_[True, (deal[1:] != deal[:-1]) | (room[1:] != room[:-1]), True])
            for a, b in zip(ends, ends[1:]):
                for lo in range(a, b, ROOM) if b - a > 1 else ():
                    hi = min(b, lo + ROOM)
                    s = x[lo:hi] @ x[a:b].T
                    s[np.arange(hi - lo), np.arange(lo - a, hi - a)] = -2
                    best = _best(s, min(each, b - a - 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], best.shape[1])), pa.array(ids[a:b][best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())], ["id", "nb", "sim"])

    return dealt.repartition("deal", "room").sortWithinPartitions("deal", "room").mapInArrow(meet, "id long, nb long, sim float")


def _pairs(ids: np.ndarray, fresh: np.ndarray, worst: np.ndarray, x: np.ndarray, group: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Offers between the members of each group: any two, one of them fresh, that beat the worst link of the first."""
    for a in range(0, group[-1] + 1, 256):
        lo, hi = np.searchsorted(group, (a, a + 256))
        g, p = group[lo:hi] - a, place[lo:hi]
        shape = (g[-1] + 1, p.max() + 1)
        row = np.full(shape, -1)
        row[g, p] = np.arange(lo, hi)
        there = row >= 0
        new = there & fresh[row]
        cube = x[row]
        s = cube @ cube.transpose(0, 2, 1)
        ok = new[:, :, None] | new[:, None, :]
        ok &= s > np.where(there, worst[row], 9)[:, :, None]
        ok &= there[:, None, :]
        ok[:, np.arange(shape[1]), np.arange(shape[1])] = False
        s[~ok] = -9
        best = np.argpartition(-s, min(OFFERS, shape[1]) - 1, axis=2)[:, :, :OFFERS]
        sims = np.take_along_axis(s, best, 2)
        gi, pi, bi = np.nonzero(sims > -9)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row[gi, pi]]), pa.array(ids[row[gi, best[gi, pi, bi]]]), pa.array(sims[gi, pi, bi])], ["id", "nb", "sim"])


def build_graph(nodes: DataFrame, n: int, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """id, nb, sim: LINKS good neighbours of every vertex by NN-descent from random links.

    In a round each vertex brings its neighbours, in both directions, together by joins; any two of them, one of which
    is new, are compared, and those better than a vertex's worst link are offered to it. A vertex with very many
    neighbours compares them in groups, so no task holds one. Rounds go on until less than CHANGE of all links are new.
    """

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(_short(matrix(batch.column(1), "float16").astype(np.float32)))], ["id", "unit"])

    short = scratch.write(nodes.mapInArrow(shrink, "id long, unit binary"))
    graph = scratch.write(_top(random_links(short, n).withColumn("fresh", F.lit(True)), "id", LINKS))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches, 1):
            at = t.column("at").to_numpy()
            place = np.arange(len(at)) - np.searchsorted(at, at)
            group = np.cumsum(np.r_[True, (at[1:] != at[:-1]) | (place[1:] % GROUP == 0)]) - 1
            yield from _pairs(t.column("id").to_numpy(), t.column("fresh").to_numpy(zero_copy_only=False), t.column("worst").to_numpy(), _long(t.column("unit")), group, place % GROUP)

    for _ in range(rounds):
        worst = graph.groupBy("id").agg(F.when(F.count(F.lit(1)) >= LINKS, F.min("sim")).otherwise(-2.0).cast("float").alias("worst"))
        known = short.join(worst, "id", "left").select("id", "unit", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        ends = graph.select(F.explode(F.array(F.struct(F.col("id").alias("at"), F.col("nb").alias("id"), "fresh"), F.struct(F.col("nb").alias("at"), F.col("id").alias("id"), "fresh"))).alias("e")).select("e.*")
        members = ends.repartition("id").groupBy("id", "at").agg(F.max("fresh").alias("fresh")).join(known, "id").select("at", "id", "fresh", "worst", "unit")
        offers = members.repartition("at").sortWithinPartitions("at").mapInArrow(meet, "id long, nb long, sim float")
        new = scratch.write(_top(graph.select("id", "nb", "sim", F.lit(False).alias("fresh")).unionByName(offers.withColumn("fresh", F.lit(True))), "id", LINKS))
        scratch.drop(graph)
        graph = new
        links, changed = graph.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if changed <= CHANGE * links:
            break
    scratch.drop(short)
    return graph.select("id", "nb", "sim")


class _Cells:
    """Cells by signs against random planes through the medians."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 11):
        self.bits = min(40, max(0, math.ceil(math.log2(max(1, n) / BLOCK))))
        planes = np.random.default_rng(seed).standard_normal((DIMENSION, self.bits)).astype(np.float32)
        self.planes = planes / np.linalg.norm(planes, axis=0, keepdims=True) if self.bits else planes
        self.at = np.median(sample @ self.planes, axis=0)

    def probes(self, x: np.ndarray, probes: int) -> list[np.ndarray]:
        """The own cell, and those behind the nearest planes, one at a time."""
        away = x @ self.planes - self.at
        cell = (away > 0).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        near = np.argsort(np.abs(away), axis=1)[:, : min(probes - 1, self.bits)]
        return [cell, *[cell ^ (np.int64(1) << near[:, j].astype(np.int64)) for j in range(near.shape[1])]]


_LINK = "array<struct<nb:bigint,blk:bigint>>"


class _Block:
    """The vertices of one block and their links, to walk over."""

    def __init__(self, t: pa.Table):
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        self.ids = t.column("id").to_numpy()[order]
        self.x = matrix(t.column("unit"), "float16").astype(np.float32)[order]
        owner, nb, blk = _links(t)
        owner = np.argsort(order, kind="stable")[owner]
        place = np.minimum(np.searchsorted(self.ids, nb), len(self.ids) - 1)
        inside = self.ids[place] == nb
        by = np.argsort(owner[inside], kind="stable")
        self.to = place[inside][by]
        self.start = np.searchsorted(owner[inside][by], np.arange(len(self.ids) + 1))
        by = np.argsort(owner[~inside], kind="stable")
        self.out_nb, self.out_blk = nb[~inside][by], blk[~inside][by]
        self.out_start = np.searchsorted(owner[~inside][by], np.arange(len(self.ids) + 1))


def _links(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, nb and blk of all links."""
    column = t.column("links")
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), flat.field("nb").to_numpy(), flat.field("blk").to_numpy()


def _spread(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of rows its entries start[row]:start[row + 1], as (number in rows, entry)."""
    n = start[rows + 1] - start[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[rows], n)


def _walk(block: _Block, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Greedy search of queries over a block: from the vertices asked for, or the best few, as far as its links go.

    Gives each query's best vertices there with their sim, and the links out of the block of those it expanded, with
    the sim of the vertex they leave from.
    """
    owners, q, least = t.column("id").to_numpy(), matrix(t.column("unit"), "float16").astype(np.float32), t.column("least").to_numpy()
    s = q @ block.x.T
    met, gone = np.zeros(s.shape, bool), np.zeros(s.shape, bool)
    row, nb, _ = _links(t)
    place = np.minimum(np.searchsorted(block.ids, nb), len(block.ids) - 1)
    here = block.ids[place] == nb
    met[row[here], place[here]] = True
    entry = np.setdiff1d(np.arange(len(owners)), row)
    if len(entry):
        np.put_along_axis(inner := met[entry], _best(s[entry], ENTRIES), True, 1)
        met[entry] = inner
    going, beam = np.arange(len(owners)), min(BEAM, s.shape[1])
    while len(going):
        seen = np.where(met[going], s[going], -9)
        bound = np.maximum(-np.partition(-seen, beam - 1, axis=1)[:, beam - 1], least[going])
        seen[gone[going] | (seen < bound[:, None])] = -9
        best = _best(seen, WIDTH)
        r, c = np.nonzero(np.take_along_axis(seen, best, 1) > -9)
        v = best[r, c]
        gone[going[r], v] = True
        k, entries = _spread(block.start, v)
        met[going[r][k], block.to[entries]] = True
        going = going[np.unique(r)]
    seen = np.where(met, s, -9)
    best = _best(seen, BEAM)
    sims = np.take_along_axis(seen, best, 1)
    r, c = np.nonzero((sims > -9) & (sims >= least[:, None]))  # others can't be among the best of the query
    v = best[r, c]
    yield pa.RecordBatch.from_arrays([pa.array(owners[r]), pa.array(block.ids[v]), pa.nulls(len(r), pa.int64()), pa.array(sims[r, c]), pa.nulls(len(r), pa.float32())], ["owner", "nb", "blk", "sim", "via"])
    expanded = gone[r, v]
    r, v = r[expanded], v[expanded]
    k, entries = _spread(block.out_start, v)
    r, nb, blk, via = r[k], block.out_nb[entries], block.out_blk[entries], s[r, v][k]
    order = np.lexsort((-via, nb, r))  # near vertices share most of their links
    order = order[np.r_[True, (r[order][1:] != r[order][:-1]) | (nb[order][1:] != nb[order][:-1])]] if len(order) else order
    yield pa.RecordBatch.from_arrays([pa.array(owners[r[order]]), pa.array(nb[order]), pa.array(blk[order]), pa.nulls(len(order), pa.float32()), pa.array(via[order])], ["owner", "nb", "blk", "sim", "via"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, n: int, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """owner, nb, sim: the BEAM best vertices found for each query by greedy search over the graph.

    Vertices lie in blocks of near ones, so that a query's vector travels once to a block and not to every vertex. A
    query enters PROBES blocks at the best few vertices; there it goes on to the links of its best vertices while it
    has new ones. Links that lead out of the block are asked for in the next round, if the vertex they leave from is
    still among the query's best. The search ends when less than SETTLED of the queries have anything to ask. Blocks with very many queries are
    copied, and cells with very many vertices are dealt over several blocks.
    """
    sample = np.stack([np.frombuffer(r.unit, np.float16) for r in nodes.orderBy(F.xxhash64("id")).limit(PLANE_SAMPLE).collect()]).astype(np.float32)
    cells = _Cells(sample, n)

    def place(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    for cell in cells.probes(matrix(batch.column(1), "float16").astype(np.float32), probes):
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["id", "unit", "cell"])

        return run

    schema = "id long, unit binary, cell long"
    placed = scratch.write(nodes.mapInArrow(place(1), schema))
    many = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("pieces"))
    blk = F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("pieces")))
    homes = placed.join(many, "cell").select("id", "unit", blk.alias("blk"))
    both = graph.select(F.explode(F.array(F.struct(F.col("id").alias("id"), F.col("nb").alias("nb")), F.struct(F.col("nb").alias("id"), F.col("id").alias("nb")))).alias("e")).select("e.*")
    around = both.join(homes.select(F.col("id").alias("nb"), "blk"), "nb").repartition("id").groupBy("id").agg(F.collect_set(F.struct("nb", "blk")).cast(_LINK).alias("links"))
    none = F.array().cast(_LINK)
    vertices = scratch.write(homes.join(around, "id", "left").select("blk", F.lit(False).alias("asks"), "id", "unit", F.coalesce("links", none).alias("links"), F.lit(0.0).cast("float").alias("least")))
    far = F.lit(-2.0).cast("float")
    asks = queries.mapInArrow(place(PROBES), schema).join(many, "cell").select(blk.alias("blk"), F.lit(True).alias("asks"), "id", "unit", none.alias("links"), far.alias("least"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's vertices come before the queries that ask there
        at, block, rows = None, None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            blk, copy, asking = t.column("blk").to_numpy(), t.column("copy").to_numpy(), t.column("asks").to_numpy()
            ends = np.flatnonzero(np.r_[True, (blk[1:] != blk[:-1]) | (copy[1:] != copy[:-1]) | (asking[1:] != asking[:-1]), True])
            for a, b in zip(ends, ends[1:]):
                if (blk[a], copy[a]) != at:
                    at, block, rows = (blk[a], copy[a]), None, []
                if not asking[a]:
                    rows.append(t.slice(a, b - a))
                elif rows or block:
                    if block is None:
                        block, rows = _Block(pa.concat_tables(rows).combine_chunks()), []
                    for lo in range(a, b, 512):
                        yield from _walk(block, t.slice(lo, min(512, b - lo)).combine_chunks())

    state, n_queries = None, queries.count()
    for _ in range(rounds):
        copies = asks.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / HOT_BLOCK).alias("copies"))
        places = vertices.join(copies, "blk").select("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "asks", "id", "unit", "links", "least")
        asked = asks.join(copies, "blk").select("blk", F.pmod(F.xxhash64("id"), F.col("copies")).alias("copy"), "asks", "id", "unit", "links", "least")
        sent = places.unionByName(asked).repartition("blk", "copy").sortWithinPartitions("blk", "copy", "asks")
        heard = sent.mapInArrow(visit, "owner long, nb long, blk long, sim float, via float").withColumn("old", F.lit(False))
        heard = heard if state is None else state.unionByName(heard)
        once = heard.repartition("owner").groupBy("owner", "nb").agg(F.max("blk").alias("blk"), F.max("sim").alias("sim"), F.max("via").alias("via"), F.max("old").alias("old"))
        rank = F.row_number().over(W.partitionBy("owner").orderBy(F.desc_nulls_last("sim"), "nb"))
        bound = F.coalesce(F.max(F.when(F.col("r") == BEAM, F.col("sim"))).over(W.partitionBy("owner")), far)
        marked = once.withColumn("r", rank).withColumn("least", bound)
        # a vertex that was asked for and isn't among the best stays, so that it isn't asked for again
        kept = scratch.write(marked.where("old OR (sim IS NOT NULL AND r <= %d) OR (sim IS NULL AND via >= least)" % BEAM))
        if state is not None:
            scratch.drop(state)
        state = kept.select("owner", "nb", "blk", "sim", "via", (F.col("sim").isNull() | F.col("old")).alias("old"))
        wanted = kept.where("sim IS NULL AND NOT old")
        if wanted.select("owner").distinct().count() <= SETTLED * n_queries:
            break
        grouped = wanted.groupBy("owner", "blk").agg(F.collect_list(F.struct("nb", "blk")).cast(_LINK).alias("links"), F.max("least").alias("least"))
        asks = grouped.join(queries.withColumnRenamed("id", "owner"), "owner").select("blk", F.lit(True).alias("asks"), F.col("owner").alias("id"), "unit", "links", "least")
    return state.where("sim IS NOT NULL").select("owner", "nb", "sim")


def most_similar(vectors: DataFrame, asked: DataFrame, k: int = 5, least: float = 0.85) -> DataFrame:
    """item_id, vec_id, cosine: for each item up to k vectors of greatest cosine, none below ``least``.

    ``vectors`` has vec_id (unique) and vector, ``asked`` item_id and vector, all usable; repeated items count once, and
    an item with several vectors is answered for all of them together. Equal directions are one vertex or query, so
    copies cost nothing; of them the smaller vec_ids are given first, as on any tie. The graph holds every vector. It
    is built at byte and searched at half precision, and the best that are found are ranked again at full precision.
    The answer is approximate: tests and README give the measured recall. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    base = scratch.write(distinct_vectors(vectors, "vec_id", "vector"))
    items = scratch.write(distinct_vectors(asked, "item_id", "vector"))

    def halved(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """One row per direction: id (least key), unit as float16 bytes; and code to id."""
        ids = scratch.write(df.groupBy("code").agg(F.min(F.struct(F.col(key).alias("id"), "unit")).alias("v")).select("code", "v.id", "v.unit"))

        def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(matrix(batch.column(1)).astype(np.float16))], ["id", "unit"])

        return scratch.write(ids.select("id", "unit").mapInArrow(shrink, "id long, unit binary")), ids

    nodes, node_codes = halved(base, "vec_id")
    queries, query_codes = halved(items, "item_id")
    n = nodes.count()
    if n == 0 or queries.isEmpty():
        return spark.createDataFrame([], "item_id long, vec_id long, cosine double")
    found = search(nodes, build_graph(nodes, n, scratch), queries, n, scratch)

    margin = 0.005  # more than half precision can be off
    likely = found.where(F.col("sim") >= least - margin)
    codes = likely.join(node_codes.select(F.col("id").alias("nb"), F.col("code").alias("vcode")), "nb").join(query_codes.select(F.col("id").alias("owner"), F.col("code").alias("qcode")), "owner").select("qcode", "vcode")
    # at most k copies of a direction can be among the k best
    copies = base.select("vec_id", "code").withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("vec_id"))).where(F.col("r") <= k)
    raw_v = vectors.select("vec_id", F.col("vector").alias("v"))
    raw_q = asked.select("item_id", F.col("vector").alias("q")).distinct()
    asks = items.select("item_id", F.col("code").alias("qcode")).distinct()
    pairs = asks.join(codes, "qcode").join(copies.select("vec_id", F.col("code").alias("vcode")), "vcode").select("item_id", "vec_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (listed(batch.column(2)), listed(batch.column(3))))
                c = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], ["item_id", "vec_id", "cosine"])

    scored = pairs.join(raw_v, "vec_id").join(raw_q, "item_id").select("item_id", "vec_id", "v", "q").mapInArrow(score, "item_id long, vec_id long, cosine double")
    best = scored.groupBy("item_id", "vec_id").agg(F.max("cosine").alias("cosine")).where(F.col("cosine") >= least)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("cosine"), "vec_id"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")
