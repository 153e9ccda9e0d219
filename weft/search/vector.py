"""Exact nearest neighbours of a query vector, quantised vectors, and an inverted file for approximate search."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.cypher.ast import CypherError
from weft.functions import scalars as S
from weft.plans.catalog import Catalog
from weft.search.filters import apply_filter, settings
from weft.storage import Scratch


def score(vector: Column, query: list[float], metric: str) -> Column:
    """Greater is nearer; null for a missing vector or one without length (cosine) or of another dimension."""
    q = F.array(*[F.lit(float(np.float32(x))) for x in query])
    v = vector.cast("array<double>")
    fn = {"cosine": S.cosine, "dot": S.dot, "dot_product": S.dot, "euclidean": lambda a, b: -S.euclidean(a, b)}.get(metric)
    if fn is None:
        raise CypherError(f"unknown metric {metric}")
    return F.when(F.size(v) == len(query), fn(v, q))


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """id, score of the k best rows; ties go to the smaller id."""
    scored = rows.select("id", score(F.col(f"`{vector}`"), query, metric).alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def search_vector(g: Catalog, config: dict[str, Any]) -> DataFrame:
    """Exact, but with ``ef`` on a property that has a vector index (cosine only): then its inverted file is searched,
    as many of its nearest cells as hold about 8 * ef vectors, and their vectors are ranked exactly. The file is built
    at the first such search and kept while the nodes of the label are the same."""
    c = settings(dict(config), {"label", "property", "query"}, {"k", "ef", "metric", "filter"})
    whole = g.scan((c["label"],))
    rows = apply_filter(whole, c.get("filter"))
    if c["property"] not in rows.columns:
        return g.spark.createDataFrame([], f"node {g.id_type()}, score double")
    indexed = any(kind == "vector index" and (label, props[0]) == (c["label"], c["property"]) for kind, label, props in g.indexes.values())
    if c.get("ef") is not None and indexed and c.get("metric", "cosine") == "cosine":
        tables = [t.df for t in g.node_tables((c["label"],))]
        key = (c["label"], c["property"])
        if key not in g.built or any(a is not b for a, b in zip(g.built[key][0], tables, strict=False)) or len(g.built[key][0]) != len(tables):
            g.built[key] = (tables, InvertedFile(whole, c["property"]))
        found = g.built[key][1].search(list(c["query"]), c.get("k", 10), g.built[key][1].probes(int(c["ef"])), rows.select("id") if c.get("filter") else None)
        return found.withColumnRenamed("id", "node")
    return nearest(rows, c["property"], list(c["query"]), c.get("k", 10), c.get("metric", "cosine")).withColumnRenamed("id", "node")


def query_nodes(g: Catalog, name: str, k: int, query: list[float], config: dict[str, Any] | None = None) -> DataFrame:
    if name not in g.indexes or g.indexes[name][0] != "vector index":
        raise CypherError(f"no vector index {name}")
    _, label, props = g.indexes[name]
    return search_vector(g, {"label": label, "property": props[0], "query": query, "k": k} | (config or {}))


def quantize(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, codes (one byte a value), scale: value = code * scale with the scale of the greatest value."""
    top = F.array_max(F.transform(F.col(vector), lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    codes = F.transform(F.col(vector), lambda x: F.round(x.cast("double") / F.col("__s")).cast("tinyint"))
    return rows.withColumn("__s", scale).select(key, codes.alias("codes"), F.col("__s").cast("float").alias("scale"))


class InvertedFile:
    """Vectors in cells around centres; a search reads the cells nearest to the query and ranks them exactly.

    The centres come from k-means over a bounded sample (``fit_rows``); every vector is put into a cell. Cells are
    folders of the written table, so a search reads only the files of its cells.
    """

    def __init__(self, rows: DataFrame, vector: str, cells: int = 64, fit_rows: int = 20_000, rounds: int = 8):
        spark = rows.sparkSession
        usable = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select("id", F.col(vector).cast("array<float>").alias("vector"))
        sample = np.array([r.vector for r in usable.orderBy(F.xxhash64("id")).limit(fit_rows).collect()], np.float32)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)] if len(unit) else unit
        for _ in range(rounds if len(unit) else 0):
            own = (unit @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, unit)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centres = np.where(size > 0, sums / np.maximum(size, 1e-9), self.centres)
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(1).to_pylist(), np.float32)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x @ centres.T).argmax(1).astype(np.int32))], ["id", "vector", "cell"])

        kind = dict(rows.dtypes)["id"]
        placed = usable.mapInArrow(place, f"id {kind}, vector array<float>, cell int")
        self.table = Scratch(spark, "cells").write(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))), ["cell"])

        self.rows = self.table.count()

    def probes(self, ef: int) -> int:
        """Cells that hold about 8 * ef vectors."""
        return max(4, -(-8 * ef * len(self.centres) // max(1, self.rows)))

    def search(self, query: list[float], k: int, probes: int = 8, only: DataFrame | None = None) -> DataFrame:
        """id, score of the k best in the cells nearest to the query; ``only`` (id) restricts them beforehand."""
        q = np.asarray(query, np.float32)
        best = np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()
        rows = self.table.where(F.col("cell").isin(best))
        return nearest(rows if only is None else rows.join(only, "id", "left_semi"), "vector", query, k)


def nearest_codes(codes: DataFrame, key: str, query: list[float], k: int) -> DataFrame:
    """key, score: the k best of quantised vectors (see quantize) by cosine; the scales cancel out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform("codes", lambda x: x.cast("double"))
    scored = codes.select(key, F.when(F.size("codes") == len(query), S.cosine(v, q)).alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.orderBy(F.desc("score"), key).limit(k)
