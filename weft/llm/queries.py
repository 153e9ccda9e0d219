"""Queries of the training-data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.functions.ids import plain_id
from weft.llm import clusters, distinct, groups, leaks, mixture, neighbours, pii, vectors
from weft.queries_general import sql_id
from weft.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    current = vectors.current_vectors(table(spark, d, "vector_payloads"))
    return clusters.similarity_clusters(current).select("vec_id", "cluster_id")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size, compactness and typical members, and how many pages searches for its members probed."""
    current = vectors.current_vectors(table(spark, d, "vector_payloads"))
    found = clusters.similarity_clusters(current)
    probed = table(spark, d, "vector_searches").join(found, "vec_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("searches"), F.avg("probed_pages").alias("mean_probed_pages"))
    return clusters.describe(found, current).join(probed, "cluster_id", "left").fillna(0, ["searches"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    current = vectors.current_vectors(table(spark, d, "vector_payloads"))
    items = table(spark, d, "data_items").where(F.col("item_id").isNotNull() & vectors.usable("embedding"))
    return neighbours.most_similar(current, items.select("item_id", F.col("embedding").alias("vector"))).select("item_id", "vec_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = groups.link_groups(groups.current_matches(table(spark, d, "rels")))
    return found.select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p2_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_groups"))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """sst_id, day, edge_type, prop_name, node_id: one row per end of each row of rels."""
    rels = table(spark, d, "rels")
    ends = F.array(*[F.struct(F.lit(p).alias("prop_name"), plain_id(p).alias("node_id")) for p in ("src", "dst")])
    return rels.select("sst_id", F.to_date("arrived_at").alias("day"), "edge_type", F.explode(ends).alias("e")).select("sst_id", "day", "edge_type", "e.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored estimates off by more than 15 percent, judged by the sketches' estimates."""
    counted = distinct.count_distinct(_ends(spark, d), ["sst_id", "prop_name"], "node_id").drop("level")
    stored = table(spark, d, "property_stats").where("ndv_estimate IS NOT NULL").select("sst_id", F.lower(F.regexp_replace("prop_name", r"[\s\p{Z}]+", "")).alias("prop_name"), "ndv_estimate")
    off = stored.join(counted, ["sst_id", "prop_name"]).where(F.abs(F.col("ndv_estimate") - F.col("estimate")) > 0.15 * F.col("estimate"))
    return off.select("sst_id", "prop_name").distinct()


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct node ids per SST, day, edge type and their combinations, merged from one set of partial sketches."""
    sets = [["sst_id"], ["day"], ["edge_type"], ["sst_id", "day"], ["sst_id", "edge_type"], ["day", "edge_type"], ["sst_id", "day", "edge_type"], []]
    return distinct.count_distinct(_ends(spark, d), ["sst_id", "day", "edge_type", "prop_name"], "node_id", [[*s, "prop_name"] for s in sets]).drop("level")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Each held-out item that leaked, with the number of documents that hold a passage of it."""
    items = table(spark, d, "eval_items").select("eval_id", "lang", "split_name").dropDuplicates(["eval_id"])
    return p8_found(spark, d).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_documents")).join(items, "eval_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixture.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).drawn()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


_USABLE = "{0} IS NOT NULL AND len({0}) = 64 AND list_aggregate(list_transform({0}, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and') AND list_aggregate(list_transform({0}, lambda x: x <> 0), 'bool_or')"
_CURRENT = f"""u AS (SELECT vec_id, vector FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lsn DESC NULLS LAST, written_at DESC NULLS LAST, vector DESC NULLS LAST) AS rn FROM vector_payloads WHERE vec_id IS NOT NULL) WHERE rn = 1 AND {_USABLE.format('vector')}),
v AS MATERIALIZED (SELECT vec_id, vector::DOUBLE[64] AS x FROM u)"""

_WORDS = "regexp_extract_all(replace(lower(strip_accents({0})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "SELECT {0}, array_to_string(w[i : i + 9], ' ') AS run FROM (SELECT {0}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {0}, {1} AS w FROM {2} WHERE {3} IS NOT NULL))"
_LEAKS = f"""d AS ({_RUNS.format('doc_id', _WORDS.format('text'), 'documents', 'text')}), e AS ({_RUNS.format('eval_id', _WORDS.format('eval_text'), 'eval_items', 'eval_text')}),
f AS (SELECT DISTINCT doc_id, eval_id FROM d JOIN e USING (run))"""

_MATCHES = f"""m AS (SELECT src, dst FROM (SELECT {sql_id('src')} AS src, {sql_id('dst')} AS dst, tombstone, row_number() OVER (PARTITION BY {sql_id('src')}, {sql_id('dst')} ORDER BY lsn DESC NULLS LAST, coalesce(tombstone, false) DESC) AS rn FROM rels WHERE edge_type = 'SAME_AS' AND src IS NOT NULL AND dst IS NOT NULL) WHERE rn = 1 AND NOT coalesce(tombstone, false) AND src <> dst),
e AS (SELECT src AS v, dst AS u FROM m UNION SELECT dst, src FROM m),
reach AS (SELECT v, u FROM e UNION SELECT r.v, e.u FROM reach r JOIN e ON r.u = e.v)"""

_FOUND2 = "SELECT v AS node_id, min(u) AS group_id FROM reach GROUP BY v"

QUERIES = {
    "p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found,
    "p2_found": p2_found, "p2_sizes": p2_sizes, "p5_found": p5_found, "p5_distinct": p5_distinct,
    "p8_found": p8_found, "p8_items": p8_items, "p9_shares": p9_shares, "p9_copies": p9_copies,
    "p10_found": p10_found, "p10_redacted": p10_redacted,
}

SQL = {
    "p1_found": f"""WITH {_CURRENT}, near AS (SELECT a.vec_id, list_sort(list(b.vec_id)) AS mates FROM v a, v b WHERE array_cosine_similarity(a.x, b.x) >= 0.85 GROUP BY 1)
SELECT vec_id, mates[1] AS cluster_id FROM near JOIN (SELECT mates FROM near GROUP BY mates HAVING count(*) = len(mates) AND len(mates) >= 3) USING (mates)""",
    "p3_found": f"""WITH {_CURRENT}, q AS (SELECT DISTINCT item_id, embedding::DOUBLE[64] AS x FROM (SELECT * FROM data_items WHERE item_id IS NOT NULL AND {_USABLE.format('embedding')})),
c AS (SELECT item_id, vec_id, max(array_cosine_similarity(q.x, v.x)) AS cosine FROM q, v GROUP BY 1, 2)
SELECT item_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, vec_id) AS rn FROM c WHERE cosine >= 0.85) WHERE rn <= 5""",
    "p8_found": f"WITH {_LEAKS} SELECT doc_id, eval_id FROM f",
    "p8_items": f"WITH {_LEAKS} SELECT eval_id, count(*) AS n_documents, any_value(lang) AS lang, any_value(split_name) AS split_name FROM f JOIN eval_items USING (eval_id) GROUP BY 1",
    "p2_found": f"WITH RECURSIVE {_MATCHES} {_FOUND2}",
    "p2_sizes": f"WITH RECURSIVE {_MATCHES}, f AS ({_FOUND2}), s AS (SELECT group_id, count(*) AS n_nodes FROM f GROUP BY 1) SELECT n_nodes, count(*) AS n_groups FROM s GROUP BY 1",
    "p5_found": f"""WITH ends AS (SELECT sst_id, 'src' AS prop_name, {sql_id('src')} AS id FROM rels UNION ALL SELECT sst_id, 'dst', {sql_id('dst')} FROM rels),
exact AS (SELECT sst_id, prop_name, count(DISTINCT id) AS n FROM ends GROUP BY 1, 2)
SELECT DISTINCT sst_id, prop_name FROM exact JOIN (SELECT sst_id, lower(trim(prop_name)) AS prop_name, ndv_estimate FROM property_stats WHERE ndv_estimate IS NOT NULL) USING (sst_id, prop_name) WHERE n > 0 AND abs(ndv_estimate - n) > 0.15 * n""",
}
