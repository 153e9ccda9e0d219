"""Text and vector ranks in one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window as W, functions as F

from weft.cypher.ast import CypherError
from weft.plans.catalog import Catalog
from weft.search.filters import settings
from weft.search.text import properties, search_bm25
from weft.search.vector import search_vector


def search_hybrid(g: Catalog, config: dict[str, Any]) -> DataFrame:
    """Each leg gives eight times k rows; they are fused by reciprocal ranks or by scores scaled to 0..1."""
    c = settings(
        dict(config), {"label", "query_text", "query_vector", "vector_property"},
        {"text_property", "text_properties", "k", "k_dense", "k_sparse", "fusion", "rrf_k", "alpha", "metric", "filter", "ef"},
    )
    k = c.get("k", 10)
    common = {"label": c["label"], "filter": c.get("filter")}
    dense = search_vector(g, common | {"property": c["vector_property"], "query": c["query_vector"], "k": c.get("k_dense", 8 * k), "metric": c.get("metric", "cosine")})
    sparse = search_bm25(g, common | {"query": c["query_text"], "text_properties": properties(c), "k": c.get("k_sparse", 8 * k)})
    whole = W.partitionBy()  # at most eight times k rows

    def reciprocal(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(whole.orderBy(F.desc("score"), "node"))
        return df.select("node", (1.0 / (c.get("rrf_k", 60) + place)).alias(name))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(whole), F.max("score").over(whole)
        return df.select("node", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    fusion = c.get("fusion", "rrf")
    if fusion not in ("rrf", "linear"):
        raise CypherError(f"unknown fusion {fusion}")
    rank = reciprocal if fusion == "rrf" else scaled
    both = rank(dense, "d").join(rank(sparse, "s"), "node", "full_outer").fillna(0.0, ["d", "s"])
    alpha = float(c.get("alpha", 0.5))
    score = F.col("d") + F.col("s") if fusion == "rrf" else alpha * F.col("d") + (1 - alpha) * F.col("s")
    return both.select("node", score.alias("score")).orderBy(F.desc("score"), "node").limit(k)
