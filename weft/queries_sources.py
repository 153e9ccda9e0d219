"""Queries on vaults, searches, statements that change the graph, files and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.graphs import trade_graph
from weft.operators.changelog import ChangeLog
from weft.plans.catalog import Catalog
from weft.queries_general import SQL as GENERAL_SQL
from weft.session import GraphSession
from weft.sources import graph_files
from weft.sources.tables import table
from weft.sources.vault import hash_embedding, vault_graph
from weft.storage import Scratch, work_dir
from weft.streaming.feed import ChangeFeed


def _vault(spark: SparkSession, d: str) -> GraphSession:
    docs = table(spark, d, "documents")
    return GraphSession(spark, vault_graph(docs.select("vault", F.col("note_path").alias("path"), "text")))


def vault_edges(spark: SparkSession, d: str) -> DataFrame:
    return _vault(spark, d).cypher("MATCH (a)-[r]->(b) RETURN type(r) AS type, count(*) AS n")


def vault_dangling(spark: SparkSession, d: str) -> DataFrame:
    return _vault(spark, d).cypher("MATCH (a:Note)-[:LINKS_TO]->(b:Note) WHERE b.placeholder RETURN b.title AS title, count(*) AS backlinks")


def vault_tags(spark: SparkSession, d: str) -> DataFrame:
    return _vault(spark, d).cypher("MATCH (n:Note)-[:TAGGED]->(t:Tag) RETURN t.name AS tag, count(*) AS notes")


def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return hash_embedding(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def _docs(spark: SparkSession, d: str) -> GraphSession:
    g = Catalog(spark)
    g.register_nodes("Doc", table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("key"), "text", "lang"), "doc_id")
    g.register_nodes("Item", table(spark, d, "embeddings").select((F.col("vec_id") + (1 << 48)).alias("i"), F.col("vec_id").alias("key"), "embedding", "label"), F.col("i"))
    g.indexes["items"] = ("vector index", "Item", ("embedding",))
    return GraphSession(spark, g)


def _probe(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def vector_natural(spark: SparkSession, d: str) -> DataFrame:
    q = "MATCH (i:Item) RETURN i.key AS key, cosine_similarity(i.embedding, $q) AS score ORDER BY score DESC, key LIMIT 10"
    return _docs(spark, d).cypher(q, {"q": _probe(spark, d)}).select("key", F.round("score", 5).alias("score"))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    q = "CALL search.vector({label: 'Item', property: 'embedding', query: $q, k: 10, filter: {label: {gte: 3}}}) YIELD node, score RETURN node.key AS key, score"
    return _docs(spark, d).cypher(q, {"q": _probe(spark, d)}).select("key", F.round("score", 5).alias("score"))


def vector_index(spark: SparkSession, d: str) -> DataFrame:
    q = "CALL db.index.vector.queryNodes('items', 5, $q) YIELD node, score RETURN node.key AS key, score"
    return _docs(spark, d).cypher(q, {"q": _probe(spark, d)}).select("key", F.round("score", 5).alias("score"))


def text_bm25(spark: SparkSession, d: str) -> DataFrame:
    q = "CALL search.bm25({label: 'Doc', text_property: 'text', query: 'tombstones gateway'}) YIELD node, score RETURN node.key AS key, score"
    return _docs(spark, d).cypher(q).select("key", F.round("score", 6).alias("score"))


def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    q = "CALL search.bm25({label: 'Doc', text_property: 'text', query: '\"night shift\"', filter: {lang: ['en', 'de']}}) YIELD node, score RETURN node.key AS key"
    return _docs(spark, d).cypher(q)


def text_prefix(spark: SparkSession, d: str) -> DataFrame:
    q = "CALL search.bm25({label: 'Doc', text_property: 'text', query: 'tombst*', k: 20}) YIELD node, score RETURN node.key AS key, score"
    return _docs(spark, d).cypher(q).select("key", F.round("score", 6).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    g = Catalog(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    vectors = Scratch(spark, "hybrid").write(hash_embedding(docs, "doc_id", "text"))
    g.register_nodes("Doc", docs.withColumn("key", F.col("doc_id")).join(vectors, "doc_id"), "doc_id")
    probe = list(hash_embedding(spark.createDataFrame([(0, "tombstones behind the gateway")], "k int, t string"), "k", "t").first()[1])
    q = "CALL search.hybrid({label: 'Doc', text_property: 'text', query_text: 'tombstones gateway', query_vector: $q, vector_property: 'embedding', k: 10}) YIELD node, score RETURN node.key AS key, score"
    return GraphSession(spark, g).cypher(q, {"q": probe})


def _nations(spark: SparkSession, d: str) -> GraphSession:
    return GraphSession(spark, trade_graph(spark, d))


def write_set(spark: SparkSession, d: str) -> DataFrame:
    s = _nations(spark, d)
    s.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) SET n.code = n.key * 10, n:Eastern")
    return s.cypher("MATCH (n:Nation) RETURN n.key AS key, n.code AS code, n:Eastern AS eastern")


def write_set_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows are applied in their order, so the last value of a list stays."""
    s = _nations(spark, d)
    s.cypher("MATCH (r:Region) UNWIND [1, 2, 3] AS x SET r.last = x + r.key")
    return s.cypher("MATCH (r:Region) RETURN r.key AS key, r.last AS last")


def write_merge(spark: SparkSession, d: str) -> DataFrame:
    s = _nations(spark, d)
    s.cypher("UNWIND ['ASIA', 'ATLANTIS', 'ATLANTIS'] AS name MERGE (r:Region {name: name}) ON CREATE SET r.key = 99, r.made = true ON MATCH SET r.made = false")
    return s.cypher("MATCH (r:Region) RETURN r.name AS name, r.key AS key, r.made AS made")


def write_create_delete(spark: SparkSession, d: str) -> DataFrame:
    s = _nations(spark, d)
    s.cypher("MATCH (r:Region {name: 'EUROPE'}) CREATE (n:Nation {key: 100, name: 'NEW'})-[:IN_REGION]->(r)")
    s.cypher("MATCH (n:Nation) WHERE n.key < 3 DETACH DELETE n")
    s.cypher("FOREACH (k IN [200, 201] | CREATE (:Nation {key: k}))")
    s.cypher("MATCH (n:Nation {key: 201}) REMOVE n.key")
    return s.cypher("MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r) RETURN n.key AS key, r.name AS region")


def record_merge(spark: SparkSession, d: str) -> DataFrame:
    g = Catalog(spark).register_nodes("Region", table(spark, d, "region").select("r_regionkey", F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "r_regionkey")
    g.nodes[0] = type(g.nodes[0])(g.nodes[0].labels, g.nodes[0].df.withColumn("id", F.col("id").cast("long")))
    g = graph_files.merge_nodes(g, "Region", [{"node_id": 1, "key": 1, "name": "RENAMED"}, {"node_id": 77, "key": 77, "name": "ADDED"}])
    return GraphSession(spark, g).cypher("MATCH (r:Region) RETURN r.key AS key, r.name AS name")


def backup_restore(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark, 'backup').root}"
    graph_files.backup(trade_graph(spark, d), path)
    return GraphSession(spark, graph_files.restore(spark, path)).cypher("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS customers")


def stream_feed(spark: SparkSession, d: str) -> DataFrame:
    """The change feed read as a stream gives the same rows as read at once."""
    path = f"{d}/wal_entries.parquet"
    schema = spark.read.parquet(path).schema
    log = ChangeLog(spark, ["payload", "arrived_at"])
    import os

    whole = not os.path.isdir(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "wal_entries.parquet" if whole else "*.parquet").parquet(d if whole else path)
    ChangeFeed(log).start(stream, f"{work_dir(spark)}/weft/feed-{log.scratch.root.rsplit('-', 1)[1]}").awaitTermination()
    return log.state().select(F.col("key").alias("entry_key"), F.col("seq").alias("lsn"))


QUERIES = {
    "vault_edges": vault_edges, "vault_dangling": vault_dangling, "vault_tags": vault_tags, "hash_vectors": hash_vectors,
    "vector_natural": vector_natural, "vector_search": vector_search, "vector_index": vector_index, "text_bm25": text_bm25, "text_phrase": text_phrase,
    "text_prefix": text_prefix, "hybrid_search": hybrid_search, "write_set": write_set, "write_set_order": write_set_order, "write_merge": write_merge, "write_create_delete": write_create_delete,
    "record_merge": record_merge, "backup_restore": backup_restore, "stream_feed": stream_feed,
}

_COS = "round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))), 5) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"

SQL = {
    "vector_natural": f"SELECT vec_id AS key, {_COS} ORDER BY score DESC, key LIMIT 10",
    "vector_search": f"SELECT vec_id AS key, {_COS} WHERE label >= 3 ORDER BY score DESC, key LIMIT 10",
    "vector_index": f"SELECT vec_id AS key, {_COS} ORDER BY score DESC, key LIMIT 5",
    "text_bm25": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents), d AS (SELECT doc_id, ts, len(ts) AS n FROM t WHERE len(ts) > 0),
c AS (SELECT doc_id, n, len(list_filter(ts, lambda x: x = 'tombstones')) AS a, len(list_filter(ts, lambda x: x = 'gateway')) AS b FROM d), s AS (SELECT count(*) AS cnt, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id AS key, round(ln(1 + (cnt - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / mean)) + ln(1 + (cnt - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a > 0 OR b > 0""",
    "text_phrase": r"SELECT doc_id AS key FROM documents WHERE lang IN ('en', 'de') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])night[^\p{L}\p{N}]+shift([^\p{L}\p{N}]|$)')",
    "text_prefix": r"""WITH d AS (SELECT doc_id, ts, len(ts) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents) WHERE len(ts) > 0), s AS (SELECT count(*) AS cnt, avg(n) AS mean FROM d),
c AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM d) WHERE starts_with(t, 'tombst') GROUP BY 1, 2, 3), f AS (SELECT t, count(*) AS df FROM c GROUP BY 1 ORDER BY t LIMIT 64)
SELECT doc_id AS key, round(sum(ln(1 + (cnt - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM c JOIN f USING (t), s GROUP BY 1 ORDER BY score DESC, key LIMIT 20""",
    "write_set": "SELECT n_nationkey::BIGINT AS key, CASE WHEN r_name = 'ASIA' THEN n_nationkey * 10 END::BIGINT AS code, r_name = 'ASIA' AS eastern FROM nation JOIN region ON n_regionkey = r_regionkey",
    "write_set_order": "SELECT r_regionkey::BIGINT AS key, (r_regionkey + 3)::BIGINT AS last FROM region",
    "write_merge": "SELECT r_name AS name, r_regionkey::BIGINT AS key, CASE WHEN r_name = 'ASIA' THEN false END AS made FROM region UNION ALL SELECT 'ATLANTIS', 99, true",
    "write_create_delete": "SELECT n_nationkey::BIGINT AS key, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 3 UNION ALL SELECT 100, 'EUROPE' UNION ALL SELECT 200, NULL UNION ALL SELECT NULL, NULL",
    "record_merge": "SELECT r_regionkey::BIGINT AS key, CASE WHEN r_regionkey = 1 THEN 'RENAMED' ELSE r_name END AS name FROM region UNION ALL SELECT 77, 'ADDED'",
    "backup_restore": "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "stream_feed": GENERAL_SQL["p4_found"],
}
