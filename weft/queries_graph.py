"""Queries over the trade and the social graph, one or more per operator, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.graphs import social_graph, trade_graph
from weft.queries_general import sql_id
from weft.session import GraphSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, graph: Callable, text: str, sql: str | None = None, params: dict[str, Any] | None = None, rounded: dict[str, int] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = GraphSession(spark, graph(spark, d)).cypher(text, params)
        for c, k in (rounded or {}).items():
            df = df.withColumn(c, F.round(c, k))
        return finish(df) if finish else df

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def trade(name: str, text: str, sql: str | None = None, **more: Any) -> None:
    _add(name, trade_graph, text, sql, **more)


#: The current edges and the nodes of the social graph in SQL.
_E = f"""nodes AS (SELECT DISTINCT {sql_id('node_id')} AS id, label FROM graph_nodes WHERE node_id IS NOT NULL AND label IN ('Person', 'Post', 'Comment')),
e AS (SELECT edge_type, src, dst, since, weight FROM (SELECT edge_type, {sql_id('src')} AS src, {sql_id('dst')} AS dst, since, weight, tombstone,
row_number() OVER (PARTITION BY edge_type, {sql_id('src')}, {sql_id('dst')} ORDER BY lsn DESC NULLS LAST, coalesce(tombstone, false) DESC) AS rn FROM rels WHERE src IS NOT NULL AND dst IS NOT NULL) WHERE rn = 1 AND NOT coalesce(tombstone, false))"""


def social(name: str, text: str, sql: str | None = None, **more: Any) -> None:
    _add(name, social_graph, text, sql and sql.replace("WITH E", f"WITH {_E}", 1).replace("WITH RECURSIVE E", f"WITH RECURSIVE {_E}", 1), **more)


# --- scans

trade(
    "flagship",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'F' RETURN n.name AS nation, count(*) AS orders, sum(o.total) AS revenue ORDER BY revenue DESC",
    "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_orderstatus = 'F' GROUP BY 1",
    rounded={"revenue": 2},
)
trade("scan_label", "MATCH (c:Customer) WHERE c.balance > 5000 AND c.segment IN ['BUILDING', 'MACHINERY'] RETURN c.key AS key, c.name AS name, c.balance AS balance", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
trade("scan_all_labels", "MATCH (n) WHERE n:Region OR n:Nation RETURN labels(n)[0] AS label, count(n) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation")
trade("scan_label_disjunction", "MATCH (n:Customer|Supplier) RETURN labels(n)[0] AS label, count(*) AS n, min(n.balance) AS low", "SELECT 'Customer' AS label, count(*) AS n, min(c_acctbal) AS low FROM customer UNION ALL SELECT 'Supplier', count(*), min(s_acctbal) FROM supplier")
trade("scan_node_by_id", "MATCH (n) WHERE id(n) = $id RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey = 7", params={"id": (2 << 48) + 7})
trade("scan_by_property", "UNWIND [3, 5, 5, 99999999] AS k MATCH (c:Customer {key: k}) RETURN k, c.name AS name", "SELECT k, c_name AS name FROM (VALUES (3::BIGINT), (5), (5), (99999999)) v(k) JOIN customer ON c_custkey = k")
trade("scan_count", "MATCH (o:Order) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders")
trade("edge_type_count", "MATCH ()-[r:PLACED]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM orders")
trade("ordered_prefix", "MATCH (p:Part) RETURN p.key AS key, p.price AS price ORDER BY p.price DESC, p.key LIMIT 10", "SELECT p_partkey AS key, p_retailprice AS price FROM part ORDER BY price DESC, key LIMIT 10")
trade("scan_predicates", "MATCH (c:Customer) WHERE c.balance >= 0 AND c.balance <= 100 AND c.segment <> 'BUILDING' AND c.name IS NOT NULL AND NOT c.name STARTS WITH 'X' RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 100 AND c_mktsegment <> 'BUILDING'")
trade("missing_property", "MATCH (r:Region) RETURN r.name AS name, r.nothing AS nothing, r.nothing IS NULL AS gone", "SELECT r_name AS name, NULL::VARCHAR AS nothing, true AS gone FROM region")

# --- patterns

trade("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total > 300000 RETURN c.name AS name, o.key AS order_key, o.total AS total", "SELECT c_name AS name, o_orderkey AS order_key, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
trade("expand_in", "MATCH (n:Nation {key: 6})<-[:IN_NATION]-(s:Supplier) RETURN s.key AS key, s.name AS name", "SELECT s_suppkey AS key, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 6")
trade("expand_unlabelled_end", "MATCH (n:Nation)<-[:IN_NATION]-(x) RETURN n.name AS name, labels(x)[0] AS label, count(*) AS n", "SELECT n_name AS name, 'Customer' AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
trade("edge_properties", "MATCH (o:Order)-[c:CONTAINS]->(p:Part) WHERE c.lines > 1 RETURN o.key AS order_key, p.key AS part_key, c.quantity AS quantity, c.lines AS lines", "SELECT l_orderkey AS order_key, l_partkey AS part_key, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
trade(
    "multi_hop",
    "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[k:CONTAINS]->(p:Part) WHERE p.brand = 'Brand#12' RETURN r.name AS region, count(DISTINCT c) AS customers, sum(k.quantity) AS quantity",
    "SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_brand = 'Brand#12' GROUP BY 1",
)
trade(
    "back_reference",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS name, count(*) AS pairs",
    "SELECT n_name AS name, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
trade("cross_product", "MATCH (a:Region), (b:Region) WHERE a.key < b.key RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
trade("hash_join", "MATCH (c:Customer), (s:Supplier) WHERE c.key = s.key RETURN c.name AS customer, s.name AS supplier", "SELECT c_name AS customer, s_name AS supplier FROM customer JOIN supplier ON c_custkey = s_suppkey")
trade("optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.key AS key, count(o) AS orders, coalesce(max(o.total), 0.0) AS top", "SELECT c_custkey AS key, count(o_orderkey) AS orders, coalesce(max(o_totalprice), 0.0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
trade("optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 400000 RETURN c.key AS key, o.key AS order_key", "SELECT c_custkey AS key, o_orderkey AS order_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
trade("exists", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 400000 } RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
trade("exists_correlated", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > c.balance * 40 } RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
trade("not_exists", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
trade("exists_in_or", "MATCH (c:Customer) WHERE c.balance < 0 OR EXISTS { (c)-[:PLACED]->(:Order {status: 'P'}) } RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
trade(
    "apply_top_per_row",
    "MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN o.key AS order_key, o.total AS total ORDER BY total DESC, order_key LIMIT 2 } RETURN c.key AS key, order_key, total",
    "SELECT o_custkey AS key, o_orderkey AS order_key, o_totalprice AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
)
trade("apply_aggregate", "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.balance > 9000 RETURN count(*) AS rich } RETURN n.name AS name, rich", "SELECT n_name AS name, count(s_suppkey) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1")
trade("subquery_uncorrelated", "CALL { MATCH (o:Order) RETURN max(o.total) AS top } MATCH (o:Order) WHERE o.total = top RETURN o.key AS key, top", "SELECT o_orderkey AS key, o_totalprice AS top FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
trade("pattern_comprehension", "MATCH (r:Region) WITH r, [(r)<-[:IN_REGION]-(n:Nation) WHERE n.key < 12 | n.name] AS names UNWIND names AS name RETURN r.name AS region, name, size(names) AS n", "SELECT r_name AS region, n_name AS name, count(*) OVER (PARTITION BY r_name) AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 12")
trade(
    "variable_length",
    "MATCH (r:Region {name: 'EUROPE'})<-[p:IN_REGION|IN_NATION*1..2]-(x) RETURN size(p) AS hops, labels(x)[0] AS label, count(*) AS n",
    "WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE') SELECT 1::BIGINT AS hops, 'Nation' AS label, count(*) AS n FROM n UNION ALL SELECT 2, 'Customer', count(*) FROM n JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 2, 'Supplier', count(*) FROM n JOIN supplier ON s_nationkey = n_nationkey",
)
trade("variable_length_zero", "MATCH (n:Nation {key: 7})-[p:IN_REGION*0..1]->(x) RETURN size(p) AS hops, x.name AS name", "SELECT 0::BIGINT AS hops, n_name AS name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 1, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")
trade("variable_length_exact", "MATCH (r:Region)<-[:IN_REGION|IN_NATION*2]-(c:Customer) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
trade("path_value", "MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.key AS key, length(p) AS hops, nodes(p)[2].name AS region, type(relationships(p)[0]) AS first", "SELECT c_custkey AS key, 2::BIGINT AS hops, r_name AS region, 'IN_NATION' AS first FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
trade("inline_edge_property", "MATCH (o:Order)-[:CONTAINS {lines: 2}]->(p:Part) RETURN o.key AS order_key, p.key AS part_key", "SELECT l_orderkey AS order_key, l_partkey AS part_key FROM lineitem GROUP BY 1, 2 HAVING count(*) = 2")

social("expand_both", "MATCH (a:Person)-[:KNOWS]-(b) RETURN count(*) AS n", "WITH E SELECT (SELECT count(*) FROM e JOIN nodes ON src = id AND label = 'Person' JOIN (SELECT id AS i2 FROM nodes) ON dst = i2 WHERE edge_type = 'KNOWS') + (SELECT count(*) FROM e JOIN nodes ON dst = id AND label = 'Person' JOIN (SELECT id AS i2 FROM nodes) ON src = i2 WHERE edge_type = 'KNOWS' AND src <> dst) AS n")
social("expand_alternation", "MATCH (a:Person)-[r:KNOWS|LIKES]->(b) RETURN type(r) AS type, count(*) AS n", "WITH E SELECT edge_type AS type, count(*) AS n FROM e JOIN nodes a ON src = a.id AND a.label = 'Person' JOIN nodes b ON dst = b.id WHERE edge_type IN ('KNOWS', 'LIKES') GROUP BY 1")
social("expand_untyped", "MATCH (a:Person)-[r]->(b:Post) RETURN type(r) AS type, count(*) AS n", "WITH E SELECT edge_type AS type, count(*) AS n FROM e JOIN nodes a ON src = a.id AND a.label = 'Person' JOIN nodes b ON dst = b.id AND b.label = 'Post' GROUP BY 1")
social("edge_uniqueness", "MATCH (a:Person)-[:REPLY_OF]-(b)-[:REPLY_OF]-(c) RETURN count(*) AS n", "WITH E, b AS (SELECT src AS x, dst AS y, src, dst FROM e WHERE edge_type = 'REPLY_OF' UNION ALL SELECT dst, src, src, dst FROM e WHERE edge_type = 'REPLY_OF' AND src <> dst) SELECT count(*) AS n FROM b p JOIN b q ON p.y = q.x JOIN nodes na ON p.x = na.id AND na.label = 'Person' JOIN nodes nb ON p.y = nb.id JOIN nodes nc ON q.y = nc.id WHERE NOT (p.src = q.src AND p.dst = q.dst)")
social(
    "triangle_pattern",
    "MATCH (a)-[:REPLY_OF]->(b)-[:REPLY_OF]->(c)-[:REPLY_OF]->(a) RETURN count(*) AS n",
    "WITH E, k AS (SELECT src, dst FROM e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE edge_type = 'REPLY_OF') SELECT count(*) AS n FROM k p JOIN k q ON p.dst = q.src JOIN k r ON q.dst = r.src AND r.dst = p.src WHERE NOT (p.src = q.src AND p.dst = q.dst) AND NOT (p.src = r.src AND p.dst = r.dst) AND NOT (q.src = r.src AND q.dst = r.dst)",
)
social("trail_uniqueness", "MATCH (a:Comment)-[p:REPLY_OF*1..3]->(b) RETURN size(p) AS hops, count(*) AS n", """WITH E, r AS (SELECT src, dst FROM e WHERE edge_type = 'REPLY_OF'),
t AS (SELECT 1 AS hops, src AS s, dst AS e1, NULL AS x1, NULL AS y1, src AS x2, dst AS y2, NULL AS x3, NULL AS y3 FROM r),
t2 AS (SELECT p.src AS s, q.dst AS t, p.src AS a1, p.dst AS a2, q.src AS b1, q.dst AS b2 FROM r p JOIN r q ON p.dst = q.src WHERE NOT (p.src = q.src AND p.dst = q.dst)),
t3 AS (SELECT t2.s, w.dst AS t FROM t2 JOIN r w ON t2.t = w.src WHERE NOT (w.src = a1 AND w.dst = a2) AND NOT (w.src = b1 AND w.dst = b2)),
every AS (SELECT 1::BIGINT AS hops, src AS s, dst AS t FROM r UNION ALL SELECT 2, s, t FROM t2 UNION ALL SELECT 3, s, t FROM t3)
SELECT hops, count(*) AS n FROM every JOIN nodes a ON s = a.id AND a.label = 'Comment' JOIN nodes b ON t = b.id GROUP BY 1""")
_BFS = """WITH RECURSIVE E, k AS (SELECT src, dst FROM e WHERE edge_type = 'LINKS_TO'), starts AS (SELECT DISTINCT id FROM nodes WHERE label = 'Post'),
f(s, v, d) AS (SELECT id, id, 0 FROM starts UNION SELECT s, dst, d + 1 FROM f JOIN k ON v = src WHERE d < 3), best AS (SELECT s, v, min(d) AS d FROM f GROUP BY 1, 2)"""
social("shortest_path", "MATCH p = shortestPath((a:Post)-[:LINKS_TO*..3]->(b:Post)) RETURN length(p) AS hops, count(*) AS n", _BFS + " SELECT d::BIGINT AS hops, count(*) AS n FROM best JOIN nodes b ON v = b.id AND b.label = 'Post' WHERE d > 0 GROUP BY 1")
social("all_shortest_paths", "MATCH p = allShortestPaths((a:Post)-[:LINKS_TO*..3]->(b:Post)) RETURN length(p) AS hops, count(*) AS n", _BFS + """, paths(s, v, d, n) AS (SELECT id, id, 0, 1::HUGEINT FROM starts UNION ALL SELECT p.s, k.dst, p.d + 1, p.n FROM paths p JOIN k ON p.v = k.src JOIN best ON best.s = p.s AND best.v = k.dst AND best.d = p.d + 1 WHERE p.d < 3)
SELECT d::BIGINT AS hops, sum(n)::BIGINT AS n FROM paths JOIN nodes b ON v = b.id AND b.label = 'Post' WHERE d > 0 GROUP BY 1""")
# the same searches without a bound on hops, which end when no path grows; the SQL of the two above ends at three
social("shortest_path_whole", "MATCH p = shortestPath((a:Post)-[:LINKS_TO*]->(b:Post)) RETURN length(p) AS hops, count(*) AS n")
social("all_shortest_paths_whole", "MATCH p = allShortestPaths((a:Post)-[:LINKS_TO*]->(b:Post)) RETURN length(p) AS hops, count(*) AS n")

trade("shortest_path_pairs", "MATCH (a:Region {name: 'ASIA'}), (b:Customer) MATCH p = shortestPath((a)-[:IN_NATION|IN_REGION*..3]-(b)) RETURN b.key AS key, length(p) AS hops", "SELECT c_custkey AS key, 2::BIGINT AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")

# --- rows, order, sets

trade("null_order_ascending", "MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.key < 3 RETURN r.name AS region, n.name AS nation ORDER BY nation, region LIMIT 4", "SELECT r_name AS region, n_name AS nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 3 ORDER BY nation NULLS LAST, region LIMIT 4")
trade("null_order_descending", "MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.key < 3 RETURN r.name AS region, n.name AS nation ORDER BY nation DESC, region LIMIT 4", "SELECT r_name AS region, n_name AS nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 3 ORDER BY nation DESC NULLS FIRST, region LIMIT 4")
trade("skip_limit", "MATCH (c:Customer) RETURN c.key AS key ORDER BY c.balance DESC, key SKIP $s LIMIT 7", "SELECT c_custkey AS key FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 5", params={"s": 5})
trade("distinct", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT p_brand AS brand, p_size::BIGINT AS size FROM part")
trade("distinct_order", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand ORDER BY brand DESC LIMIT 5", "SELECT DISTINCT p_brand AS brand FROM part ORDER BY 1 DESC LIMIT 5")
trade("with_chain", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n, sum(o.total) AS total WHERE n > 15 WITH c.segment AS segment, n ORDER BY n DESC, segment LIMIT 50 RETURN segment, max(n) AS top, count(*) AS customers", "WITH a AS (SELECT c_mktsegment AS segment, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 15), b AS (SELECT * FROM a ORDER BY n DESC, segment LIMIT 50) SELECT segment, max(n) AS top, count(*) AS customers FROM b GROUP BY 1")
trade("star", "MATCH (r:Region) WITH r.key AS key, r.name AS name RETURN *", "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
trade("unwind", "UNWIND range(1, 5) AS x UNWIND [x, x * x] AS y RETURN x, y", "SELECT x, y FROM (SELECT unnest(range(1, 6)) AS x), LATERAL (SELECT unnest([x, x * x]) AS y)")
trade("union_all", "MATCH (c:Customer) WHERE c.balance < -900 RETURN c.name AS name UNION ALL MATCH (s:Supplier) WHERE s.balance < -500 RETURN s.name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal < -900 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < -500")
trade("union_distinct", "MATCH (c:Customer) RETURN c.segment AS x UNION MATCH (o:Order) RETURN o.priority AS x", "SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderpriority FROM orders")
trade("case_searched", "MATCH (c:Customer) RETURN CASE WHEN c.balance < 0 THEN 'debt' WHEN c.balance < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1")
trade("case_simple", "MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END::BIGINT AS code, count(*) AS n FROM orders GROUP BY 1")

# --- aggregates

trade("aggregate_all", "MATCH (c:Customer) RETURN count(*) AS n, count(c.segment) AS segments, count(DISTINCT c.segment) AS kinds, min(c.balance) AS low, max(c.balance) AS high, sum(c.key) AS keys, avg(c.key) AS mean", "SELECT count(*) AS n, count(c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS kinds, min(c_acctbal) AS low, max(c_acctbal) AS high, sum(c_custkey)::BIGINT AS keys, round(avg(c_custkey), 6) AS mean FROM customer", rounded={"mean": 6})
trade("aggregate_empty", "MATCH (c:Customer) WHERE c.key < 0 RETURN count(*) AS n, sum(c.key) AS s, avg(c.key) AS a, min(c.name) AS low, size(collect(c.name)) AS names", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::DOUBLE AS a, NULL::VARCHAR AS low, 0::BIGINT AS names")
trade("aggregate_distinct", "MATCH (p:Part) RETURN p.brand AS brand, sum(DISTINCT p.size) AS sizes, avg(DISTINCT p.size) AS mean, count(DISTINCT p.type) AS types", "SELECT p_brand AS brand, sum(DISTINCT p_size)::BIGINT AS sizes, round(avg(DISTINCT p_size), 6) AS mean, count(DISTINCT p_type) AS types FROM part GROUP BY 1", rounded={"mean": 6})
trade("collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, collect(n.name) AS names", "SELECT r_name AS region, list_sort(list(n_name)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", finish=lambda df: df.withColumn("names", F.array_sort("names")))
trade("collect_distinct_hoisted", "MATCH (o:Order) RETURN o.status AS status, size(collect(DISTINCT o.priority)) + 1 AS n", "SELECT o_orderstatus AS status, count(DISTINCT o_orderpriority) + 1 AS n FROM orders GROUP BY 1")
trade("group_by_node", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS key, c.name AS name, count(*) AS n", "SELECT c_custkey AS key, c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")

# --- expressions

trade(
    "logic_three_valued",
    "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS c, a OR b AS d, a XOR b AS e, NOT a AS f",
    "SELECT a, b, a AND b AS c, a OR b AS d, a <> b AS e, NOT a AS f FROM (VALUES (true), (false), (NULL)) x(a), (VALUES (true), (false), (NULL)) y(b)",
)
trade("arithmetic", "UNWIND [-7, 7] AS a UNWIND [2, -3] AS b RETURN a, b, a + b AS s, a - b AS d, a * b AS m, a / b AS q, a % b AS r, a ^ 2 AS p, -a AS n", "SELECT a, b, a + b AS s, a - b AS d, a * b AS m, trunc(a::DOUBLE / b)::BIGINT AS q, ((a % abs(b)) + abs(b)) % abs(b) AS r, (a * a)::DOUBLE AS p, -a AS n FROM (VALUES (-7::BIGINT), (7)) x(a), (VALUES (2::BIGINT), (-3)) y(b)")
trade("comparison", "UNWIND [1, 2, null] AS a RETURN a, a = 1 AS eq, a <> 1 AS ne, a < 2 AS lt, a >= 2 AS ge, a IN [1, null] AS inside, a IS NULL AS gone, 1 < a <= 2 AS between, a = '1' AS mixed", "SELECT a, a = 1 AS eq, a <> 1 AS ne, a < 2 AS lt, a >= 2 AS ge, CASE WHEN a = 1 THEN true END AS inside, a IS NULL AS gone, a > 1 AND a <= 2 AS between, CASE WHEN a IS NOT NULL THEN false END AS mixed FROM (VALUES (1::BIGINT), (2), (NULL)) v(a)")
trade("string_predicates", "MATCH (p:Part) WHERE p.type STARTS WITH 'ECONOMY' OR p.type ENDS WITH 'BRASS' OR p.name CONTAINS 'green' RETURN count(*) AS n, sum(CASE WHEN p.type =~ '.*(TIN|STEEL)' THEN 1 ELSE 0 END) AS matched", "SELECT count(*) AS n, coalesce(sum(regexp_full_match(p_type, '.*(TIN|STEEL)')::BIGINT), 0)::BIGINT AS matched FROM part WHERE starts_with(p_type, 'ECONOMY') OR ends_with(p_type, 'BRASS') OR contains(p_name, 'green')")
trade(
    "string_functions",
    "MATCH (n:Nation) RETURN n.name AS name, toLower(n.name) AS low, toUpper(n.name) AS up, size(n.name) AS size, left(n.name, 2) AS l, right(n.name, 2) AS r, substring(n.name, 1, 3) AS s, replace(n.name, 'A', '.') AS rep, reverse(n.name) AS rev, trim('  ' + n.name + ' ') AS t, split(n.name, 'A')[0] AS first",
    "SELECT n_name AS name, lower(n_name) AS low, upper(n_name) AS up, length(n_name) AS size, left(n_name, 2) AS l, right(n_name, 2) AS r, substring(n_name, 2, 3) AS s, replace(n_name, 'A', '.') AS rep, reverse(n_name) AS rev, n_name AS t, str_split(n_name, 'A')[1] AS first FROM nation",
)
trade(
    "number_functions",
    "UNWIND [-2.5, -0.4, 1.5, 2.49] AS x RETURN x, abs(x) AS a, sign(x) AS s, round(x) AS r, floor(x) AS f, ceil(x) AS c, sqrt(x * x) AS q, toInteger(x) AS i, toString(x) AS t",
    "SELECT x, abs(x) AS a, sign(x)::BIGINT AS s, round(x) + 0.0 AS r, floor(x) AS f, ceil(x) + 0.0 AS c, sqrt(x * x) AS q, trunc(x)::BIGINT AS i, x::VARCHAR AS t FROM (VALUES (-2.5::DOUBLE), (-0.4), (1.5), (2.49)) v(x)",
)
trade("conversions", "UNWIND ['3', '3.7', 'x', 'TRUE'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(3.0) AS whole", "SELECT s, CASE WHEN s = '3' THEN 3 END::BIGINT AS i, CASE s WHEN '3' THEN 3.0 WHEN '3.7' THEN 3.7 END::DOUBLE AS f, CASE WHEN s = 'TRUE' THEN true END AS b, '3' AS whole FROM (VALUES ('3'), ('3.7'), ('x'), ('TRUE')) v(s)")
trade("list_functions", "WITH [3, 1, 2] AS l RETURN size(l) AS n, head(l) AS h, last(l) AS e, tail(l) AS t, reverse(l) AS r, l[0] AS a, l[-1] AS b, l[9] AS c, l[1..] AS d, l[..-1] AS f, l + [4] AS g, range(3, 1) AS none, range(5, 1, -2) AS down", "SELECT 3::BIGINT AS n, 3::BIGINT AS h, 2::BIGINT AS e, [1, 2]::BIGINT[] AS t, [2, 1, 3]::BIGINT[] AS r, 3::BIGINT AS a, 2::BIGINT AS b, NULL::BIGINT AS c, [1, 2]::BIGINT[] AS d, [3, 1]::BIGINT[] AS f, [3, 1, 2, 4]::BIGINT[] AS g, []::BIGINT[] AS none, [5, 3, 1]::BIGINT[] AS down")
trade("list_comprehension", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.key) AS ks RETURN r.name AS region, size([x IN ks WHERE x % 2 = 0 | x * 10]) AS even, all(x IN ks WHERE x >= 0) AS every, any(x IN ks WHERE x > 23) AS some, none(x IN ks WHERE x > 99) AS no, single(x IN ks WHERE x = 0) AS one", "SELECT r_name AS region, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS even, true AS every, bool_or(n_nationkey > 23) AS some, true AS no, count(*) FILTER (WHERE n_nationkey = 0) = 1 AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
trade("map_values", "WITH {a: 1, b: 'x'} AS m RETURN m.a AS a, m['b'] AS b, m.c AS c, size(keys(m)) AS n", "SELECT 1::BIGINT AS a, 'x' AS b, NULL::VARCHAR AS c, 2::BIGINT AS n")
trade("entity_functions", "MATCH (n:Nation {key: 3})-[k:IN_REGION]->(r) RETURN labels(n) AS l, type(k) AS t, keys(n) AS ks, properties(n).name AS name, startNode(k) = n AS s, id(n) = elementId(n) AS same", "SELECT ['Nation'] AS l, 'IN_REGION' AS t, ['key', 'name'] AS ks, n_name AS name, true AS s, true AS same FROM nation WHERE n_nationkey = 3")
trade("dates", "MATCH (o:Order) WHERE o.date >= datetime('1995-01-01T00:00:00Z') AND o.date < datetime('1995-02-01T00:00:00Z') RETURN count(*) AS n, date('2024-02-29') AS day", "SELECT count(*) AS n, DATE '2024-02-29' AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
trade("vector_functions", "WITH [1.0, 2.0, 2.0] AS a, [2.0, 0.0, 1.0] AS b RETURN dot_product(a, b) AS dot, cosine_similarity(a, b) AS cos, euclidean_distance(a, b) AS far, cosine_similarity(a, [0.0, 0.0, 0.0]) AS none", "SELECT 4.0::DOUBLE AS dot, round(4.0 / (3 * sqrt(5)), 9) AS cos, round(sqrt(6), 9) AS far, NULL::DOUBLE AS none", rounded={"cos": 9, "far": 9})

# --- algorithms

_KNOWS = "{labels: ['Person'], edge_types: ['KNOWS']}"
_K = "WITH E, p AS (SELECT id FROM nodes WHERE label = 'Person'), k AS (SELECT src, dst FROM e WHERE edge_type = 'KNOWS' AND src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p))"
social("algo_degree", f"CALL algo.degree({_KNOWS}) YIELD node_id, in_degree, out_degree, degree RETURN id(node_id) AS id, in_degree, out_degree, degree", _K + " SELECT id, (SELECT count(*) FROM k WHERE dst = id) AS in_degree, (SELECT count(*) FROM k WHERE src = id) AS out_degree, (SELECT count(*) FROM k WHERE dst = id) + (SELECT count(*) FROM k WHERE src = id) AS degree FROM p")
social(
    "algo_triangles",
    f"CALL algo.triangle_count({_KNOWS}) YIELD node_id, triangles, coefficient RETURN id(node_id) AS id, triangles, coefficient",
    _K + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM k WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
n AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY 1), d AS (SELECT id, count(*) AS d FROM (SELECT unnest([a, b]) AS id FROM u) GROUP BY 1)
SELECT id, coalesce(t, 0)::BIGINT AS triangles, round(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 9) AS coefficient FROM p LEFT JOIN n USING (id) LEFT JOIN d USING (id)""",
    rounded={"coefficient": 9},
)
social(
    "algo_wcc",
    "CALL algo.wcc({labels: ['Person', 'Post', 'Comment'], edge_types: ['SAME_AS']}) YIELD node_id, component RETURN component, count(*) AS n",
    """WITH RECURSIVE E, p AS (SELECT DISTINCT id FROM nodes), m AS (SELECT src AS v, dst AS u FROM e WHERE edge_type = 'SAME_AS' AND src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)), b AS (SELECT v, u FROM m UNION SELECT u, v FROM m),
reach AS (SELECT v, u FROM b UNION SELECT r.v, b.u FROM reach r JOIN b ON r.u = b.v), roots AS (SELECT id, least(id, coalesce(min(u), id)) AS root FROM p LEFT JOIN reach ON v = id GROUP BY id)
SELECT dense_rank() OVER (ORDER BY root) - 1 AS component, count(*) AS n FROM roots GROUP BY root""",
)
social(
    "algo_scc",
    f"CALL algo.scc({_KNOWS}) YIELD node_id, component RETURN id(node_id) AS id, component",
    _K.replace("WITH E", "WITH RECURSIVE E") + """, reach AS (SELECT DISTINCT src AS v, dst AS u FROM k UNION SELECT r.v, k.dst FROM reach r JOIN k ON r.u = k.src),
roots AS (SELECT p.id, least(p.id, coalesce(min(a.u), p.id)) AS root FROM p LEFT JOIN (SELECT x.v, x.u FROM reach x JOIN reach y ON x.v = y.u AND x.u = y.v) a ON a.v = p.id GROUP BY 1)
SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS component FROM roots""",
)
social("algo_pagerank", f"CALL algo.pagerank({{labels: ['Person'], edge_types: ['KNOWS']}}) YIELD node_id, score RETURN id(node_id) AS id, score")
social(
    "algo_shortest_path",
    "CALL algo.shortest_path({edge_types: ['REPLY_OF'], source: $s}) YIELD node_id, distance, hops RETURN id(node_id) AS id, distance, hops",
    """WITH RECURSIVE E, p AS (SELECT DISTINCT id FROM nodes), k AS (SELECT src, dst FROM e WHERE edge_type = 'REPLY_OF' AND src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)),
f(v, d) AS (SELECT '43017e9b4a3f2b0d8774c811474e0ea7', 0 WHERE '43017e9b4a3f2b0d8774c811474e0ea7' IN (SELECT id FROM p) UNION SELECT dst, d + 1 FROM f JOIN k ON v = src WHERE d < 40)
SELECT v AS id, min(d)::DOUBLE AS distance, min(d)::BIGINT AS hops FROM f GROUP BY 1""",
    params={"s": "43017e9b4a3f2b0d8774c811474e0ea7"},
)
social("algo_label_propagation", "CALL algo.label_propagation({}) YIELD node_id, community RETURN id(node_id) AS id, community")
social("algo_louvain", "CALL algo.louvain({}) YIELD node_id, community RETURN id(node_id) AS id, community")
social("algo_betweenness", "CALL algo.betweenness({labels: ['Comment'], edge_types: ['REPLY_OF']}) YIELD node_id, score RETURN id(node_id) AS id, score")
social("algo_fastrp", "CALL algo.fastRP({edge_types: ['LINKS_TO'], dimension: 16}) YIELD node_id, embedding RETURN id(node_id) AS id, embedding")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["flagship"](spark, d)
