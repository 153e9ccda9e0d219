"""Queries on change feeds, drifting schemas and skewed keys (p4, p6, p7) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.functions.ids import plain_id
from weft.operators.changelog import operation, replay
from weft.operators.heavy_keys import heavy_keys, per_key
from weft.operators.schema_drift import DriftReport, node_records
from weft.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    log = replay(table(spark, d, "wal_entries"))
    log.compact()
    return log.state(payload=False).select(F.col("key").alias("entry_key"), F.col("seq").alias("lsn"))


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """Live entries and deleted keys by kind, with the span of sequence numbers."""
    log = replay(table(spark, d, "wal_entries"))
    kind = F.split("key", ":")[0]
    live = operation(F.col("op")) == "upsert"
    return log.merged(payload=False).groupBy(kind.alias("entry_kind")).agg(
        F.count_if(live).alias("n_live"), F.count_if(~F.coalesce(live, F.lit(False))).alias("n_gone"), F.min("seq").alias("first_lsn"), F.max("seq").alias("last_lsn")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    report = DriftReport(node_records(table(spark, d, "node_rows")))
    return report.changes().select("ns", "schema_version", "field_name", "change_kind")


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return DriftReport(node_records(table(spark, d, "node_rows"))).unified()


def _rels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rels").select("edge_type", plain_id("src").alias("src"), plain_id("dst").alias("dst"), "tombstone")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_rels(spark, d), ["edge_type", "src"], 0.005).where(F.col("src").isNotNull()).select("edge_type", "src")


def p7_per_key(spark: SparkSession, d: str) -> DataFrame:
    return per_key(_rels(spark, d), ["edge_type", "src"], ["dst"], extra={"n_tombstones": F.col("tombstone").cast("long")})


_ID = "CASE WHEN length(regexp_replace(lower(trim({0})), '[^0-9a-f]', '', 'g')) = 32 THEN regexp_replace(lower(trim({0})), '[^0-9a-f]', '', 'g') ELSE lower(trim({0})) END"


def sql_id(column: str) -> str:
    return _ID.format(column)


_WAL = f"""WITH parts AS (SELECT str_split(entry_key, ':') p, entry_key, lower(regexp_replace(op, '[^A-Za-z]', '', 'g')) AS o, lsn FROM wal_entries WHERE entry_key IS NOT NULL AND lsn IS NOT NULL),
keyed AS (SELECT CASE WHEN len(p) = 2 THEN 'node:' || {sql_id('p[2]')} WHEN len(p) = 4 THEN 'edge:' || p[2] || ':' || {sql_id('p[3]')} || ':' || {sql_id('p[4]')} ELSE entry_key END AS k, o, lsn FROM parts),
latest AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC, (o = 'tombstone') DESC NULLS LAST, o DESC NULLS LAST) AS rn FROM keyed)"""

_DRIFT = """WITH RECURSIVE r AS (SELECT ns, __schema_version AS v, node_id, lsn, sst_file, __overflow_json::JSON AS j FROM node_rows WHERE ns IS NOT NULL AND __schema_version IS NOT NULL AND json_valid(__overflow_json) AND json_type(__overflow_json) = 'OBJECT'),
e AS (SELECT ns, v, node_id, lsn, sst_file, k, json_type(val) AS t, val ->> '$' AS x FROM (SELECT ns, v, node_id, lsn, sst_file, k, j -> ('$."' || k || '"') AS val FROM (SELECT *, unnest(json_keys(j)) AS k FROM r)) WHERE json_type(val) <> 'NULL'),
typed AS (SELECT *, CASE WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'number' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'OBJECT' THEN 'object' ELSE 'string' END AS kind FROM e),
n AS (SELECT ns, v, count(*) AS n FROM r GROUP BY 1, 2), vs AS (SELECT ns, v, lag(v) OVER (PARTITION BY ns ORDER BY v) AS prev FROM n),
kinds AS (SELECT ns, v, k, kind, count(*) AS c FROM typed GROUP BY 1, 2, 3, 4),
has AS (SELECT ns, v, k, kind FROM (SELECT ns, v, k, arg_max(kind, c * 10 - list_position(['boolean', 'integer', 'number', 'array', 'object', 'string'], kind)) AS kind, sum(c) AS c FROM kinds GROUP BY 1, 2, 3) JOIN n USING (ns, v) WHERE c >= 0.1 * n.n - 1e-9),
now AS (SELECT vs.ns, vs.v, prev, k, kind FROM vs JOIN has USING (ns, v) WHERE prev IS NOT NULL), was AS (SELECT vs.ns, vs.v, prev, k, kind FROM vs JOIN has ON has.ns = vs.ns AND has.v = vs.prev),
fresh AS (SELECT now.* FROM now ANTI JOIN was USING (ns, v, k)), gone AS (SELECT was.* FROM was ANTI JOIN now USING (ns, v, k)),
latest AS (SELECT ns, v, node_id, k, arg_max(x, (coalesce(lsn, -1), coalesce(sst_file, ''))) AS x FROM typed WHERE node_id IS NOT NULL GROUP BY 1, 2, 3, 4),
pairs AS (SELECT f.ns, f.v, f.k AS k, g.k AS old, count(*) AS n_both, count_if(a.x = b.x) AS same FROM fresh f JOIN gone g USING (ns, v) JOIN latest a ON a.ns = f.ns AND a.v = f.v AND a.k = f.k JOIN latest b ON b.ns = g.ns AND b.v = g.prev AND b.k = g.k AND b.node_id = a.node_id GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM pairs WHERE 2 * same > n_both QUALIFY row_number() OVER (PARTITION BY ns, v, k ORDER BY same DESC, old) = 1), renamed AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY ns, v, old ORDER BY same DESC, k) = 1)
SELECT ns, v AS schema_version, k AS field_name, 'renamed' AS change_kind FROM renamed
UNION ALL SELECT ns, v, k, 'added' FROM fresh ANTI JOIN renamed USING (ns, v, k)
UNION ALL SELECT g.ns, g.v, g.k, 'removed' FROM gone g ANTI JOIN renamed m ON m.ns = g.ns AND m.v = g.v AND m.old = g.k
UNION ALL SELECT now.ns, now.v, now.k, 'retyped' FROM now JOIN was USING (ns, v, k) WHERE now.kind <> was.kind"""

QUERIES = {"p4_found": p4_found, "p4_state": p4_state, "p6_found": p6_found, "p6_unified": p6_unified, "p7_found": p7_found, "p7_per_key": p7_per_key}

SQL = {
    "p4_found": _WAL + " SELECT k AS entry_key, lsn FROM latest WHERE rn = 1 AND o = 'upsert'",
    "p4_state": _WAL + " SELECT str_split(k, ':')[1] AS entry_kind, count_if(coalesce(o, '') = 'upsert')::BIGINT AS n_live, count_if(coalesce(o, '') <> 'upsert')::BIGINT AS n_gone, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM latest WHERE rn = 1 GROUP BY 1",
    "p6_found": _DRIFT,
    "p7_found": f"SELECT edge_type, {sql_id('src')} AS src FROM rels GROUP BY 1, 2 HAVING count(*) >= 0.005 * (SELECT count(*) FROM rels) AND {sql_id('src')} IS NOT NULL",
    "p7_per_key": f"""WITH r AS (SELECT edge_type, {sql_id('src')} AS src, {sql_id('dst')} AS dst, tombstone FROM rels)
SELECT edge_type, src, count(*) AS n_rows, count(DISTINCT dst) AS n_dst, sum(tombstone::BIGINT)::BIGINT AS n_tombstones, count(*) >= 0.005 * (SELECT count(*) FROM rels) AS is_heavy FROM r GROUP BY 1, 2""",
}
