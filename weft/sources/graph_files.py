"""Reading and writing graphs as files, records and frames."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.cypher.ast import CypherError
from weft.plans.catalog import Catalog, EdgeTable, NodeTable, union
from weft.storage import Scratch


def resolve(spark: SparkSession, uri: str) -> str:
    """A path of a file system (file, s3, gs, az and what else Hadoop knows); ``memory://name`` is a temporary view."""
    if uri.startswith("memory://"):
        raise CypherError("memory:// names a view, not a path")
    return {"s3": "s3a", "az": "abfs"}.get(uri.split("://")[0], uri.split("://")[0]) + uri[uri.index("://") :] if "://" in uri else uri


def read_table(spark: SparkSession, uri: str, form: str = "parquet", **options: Any) -> DataFrame:
    if uri.startswith("memory://"):
        return spark.table(uri[9:])
    return spark.read.options(**options).format(form).load(resolve(spark, uri))


def load_nodes(g: Catalog, uri: str, label: str, form: str = "parquet", id_col: str = "node_id", **options: Any) -> Catalog:
    """Nodes of a file: ``id_col`` is the id, in whatever form, other columns are properties."""
    df = read_table(g.spark, uri, form, **options)
    key = F.lower(F.hex(id_col)) if dict(df.dtypes)[id_col] == "binary" else F.col(id_col)
    return g.register_nodes(label, df.withColumn(id_col, key).where(F.col(id_col).isNotNull()), id_col)


def load_edges(g: Catalog, uri: str, type_: str, form: str = "parquet", src: str = "src", dst: str = "dst", **options: Any) -> Catalog:
    """Edges of a file; their ends aren't made."""
    df = read_table(g.spark, uri, form, **options)
    text = [F.lower(F.hex(c)) if dict(df.dtypes)[c] == "binary" else F.col(c) for c in (src, dst)]
    return g.register_edges(type_, df.withColumn("__s", text[0]).withColumn("__d", text[1]).drop(src, dst), "__s", "__d")


def merge_nodes(g: Catalog, label: str, rows: list[dict[str, Any]] | DataFrame, id_col: str = "node_id") -> Catalog:
    """Put records in place of those with the same id; of repeated records in one call the last counts."""
    new = rows if isinstance(rows, DataFrame) else g.spark.createDataFrame(list({r[id_col]: r for r in rows}.values()))
    fresh = Catalog(g.spark).register_nodes(label, new, id_col).nodes[0].df
    out = g.copy()
    for i, t in enumerate(out.nodes):
        if t.labels == frozenset([label]):
            kept = t.df.join(fresh.select("id"), "id", "left_anti")
            out.nodes[i] = NodeTable(t.labels, Scratch(g.spark, "merge").write(union([kept, fresh])))
            return out
    out.nodes.append(NodeTable(frozenset([label]), Scratch(g.spark, "merge").write(fresh)))
    return out


def merge_edges(g: Catalog, type_: str, rows: list[dict[str, Any]] | DataFrame) -> Catalog:
    new = rows if isinstance(rows, DataFrame) else g.spark.createDataFrame(list({(r["src"], r["dst"]): r for r in rows}.values()))
    fresh = Catalog(g.spark).register_edges(type_, new.withColumnsRenamed({"src": "__s", "dst": "__d"}), "__s", "__d").edges[0].df
    out = g.copy()
    for i, t in enumerate(out.edges):
        if t.type == type_:
            kept = t.df.join(fresh.select("src", "dst"), ["src", "dst"], "left_anti").select(*t.df.columns)
            out.edges[i] = EdgeTable(type_, Scratch(g.spark, "merge").write(union([kept, fresh])))
            return out
    out.edges.append(EdgeTable(type_, Scratch(g.spark, "merge").write(fresh)))
    return out


def remove_nodes(g: Catalog, ids: DataFrame) -> Catalog:
    """Take away nodes (column id) and the edges at them."""
    out = g.copy()
    out.nodes = [NodeTable(t.labels, t.df.join(ids, "id", "left_anti")) for t in g.nodes]
    ends = [ids.withColumnRenamed("id", c) for c in ("src", "dst")]
    out.edges = [EdgeTable(t.type, t.df.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti").select(*t.df.columns), t.src_label, t.dst_label) for t in g.edges]
    return out


def remove_edges(g: Catalog, type_: str, ends: DataFrame) -> Catalog:
    """Take away the edges of a type between given ends (columns src, dst)."""
    out, gone = g.copy(), ends.select("src", "dst").distinct()
    out.edges = [EdgeTable(t.type, t.df.join(gone, ["src", "dst"], "left_anti").select(*t.df.columns), t.src_label, t.dst_label) if t.type == type_ else t for t in g.edges]
    return out


def lookup_node(g: Catalog, node_id: Any) -> DataFrame:
    return g.scan().where(F.col("id") == node_id)


def out_edges(g: Catalog, node_id: Any, types: tuple = ()) -> DataFrame:
    return g.edge_scan(g.edge_tables(types)).where(F.col("src") == node_id)


def in_edges(g: Catalog, node_id: Any, types: tuple = ()) -> DataFrame:
    return g.edge_scan(g.edge_tables(types)).where(F.col("dst") == node_id)


def backup(g: Catalog, uri: str) -> None:
    """A consistent copy: every table as Parquet, and a description of them."""
    path = resolve(g.spark, uri)
    about: dict[str, Any] = {"nodes": [], "edges": [], "constraints": g.constraints, "indexes": g.indexes}
    for i, t in enumerate(g.nodes):
        t.df.write.mode("overwrite").parquet(f"{path}/nodes/{i}")
        about["nodes"].append(sorted(t.labels))
    for i, t in enumerate(g.edges):
        t.df.write.mode("overwrite").parquet(f"{path}/edges/{i}")
        about["edges"].append([t.type, t.src_label, t.dst_label])
    g.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def restore(spark: SparkSession, uri: str) -> Catalog:
    path = resolve(spark, uri)
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    g = Catalog(spark)
    g.nodes = [NodeTable(frozenset(labels), spark.read.parquet(f"{path}/nodes/{i}")) for i, labels in enumerate(about["nodes"])]
    g.edges = [EdgeTable(t, spark.read.parquet(f"{path}/edges/{i}"), a, b) for i, (t, a, b) in enumerate(about["edges"])]
    g.constraints = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in about["constraints"].items()}
    g.indexes = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in about["indexes"].items()}
    return g
