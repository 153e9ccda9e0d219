"""The graph: labelled node tables, typed edge tables, constraints and named indexes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weft.cypher.ast import CypherError
from weft.plans.values import stored, type_of

RESERVED = ("node_id", "tombstone", "lsn")


@dataclass(frozen=True)
class NodeTable:
    labels: frozenset
    df: DataFrame  # id and the properties

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name != "id"}


@dataclass(frozen=True)
class EdgeTable:
    type: str
    df: DataFrame  # src, dst and the properties
    src_label: str | None = None
    dst_label: str | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in ("src", "dst")}


@dataclass
class Catalog:
    """One graph. Ids are of one type for all nodes; a change makes new tables and leaves the old ones as they were."""

    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)
    constraints: dict[str, tuple] = field(default_factory=dict)  # name: (rule, label, properties)
    indexes: dict[str, tuple] = field(default_factory=dict)  # name: (kind, label, properties)
    built: dict[tuple, tuple] = field(default_factory=dict)  # (label, property): tables and the index built over them

    def copy(self) -> "Catalog":
        return replace(self, nodes=list(self.nodes), edges=list(self.edges), constraints=dict(self.constraints), indexes=dict(self.indexes))

    def register_nodes(self, labels: str | list[str], df: DataFrame, id_col: str | Column) -> "Catalog":
        """Add a table of nodes. The id must be unique in the graph; all other columns become properties."""
        labels = frozenset([labels] if isinstance(labels, str) else labels)
        props = [c for c in df.columns if c != "id" and not (isinstance(id_col, str) and c == id_col)]
        for c in props:
            if c in RESERVED or c.startswith("__"):
                raise CypherError(f"{c} is a reserved name")
        key = F.col(id_col) if isinstance(id_col, str) else id_col
        kinds = {f.name: f.dataType for f in df.schema}
        self.nodes.append(NodeTable(labels, df.select(key.alias("id"), *[stored(kinds[c], F.col(c)).alias(c) for c in props])))
        return self

    def register_edges(self, type_: str, df: DataFrame, src: str | Column, dst: str | Column, src_label: str | None = None, dst_label: str | None = None, unique: bool = False) -> "Catalog":
        """Add the edges of a type. There is one edge per (type, src, dst): ``unique`` says that df keeps to this."""
        drop = {x for x in (src, dst) if isinstance(x, str)}
        props = [c for c in df.columns if c not in drop and c not in ("src", "dst")]
        key = [F.col(x) if isinstance(x, str) else x for x in (src, dst)]
        kinds = {f.name: f.dataType for f in df.schema}
        out = df.select(key[0].alias("src"), key[1].alias("dst"), *[stored(kinds[c], F.col(c)).alias(c) for c in props]).where("src IS NOT NULL AND dst IS NOT NULL")
        if not unique:
            out = out.dropDuplicates(["src", "dst"])
        self.edges.append(EdgeTable(type_, out, src_label, dst_label))
        return self

    def labels(self) -> set[str]:
        return {x for t in self.nodes for x in t.labels}

    def types(self) -> set[str]:
        return {t.type for t in self.edges}

    def node_tables(self, labels: tuple = (), any_of: bool = False) -> list[NodeTable]:
        """Tables whose nodes have all (or any) of the labels."""
        want = set(labels)
        return [t for t in self.nodes if not want or (want & t.labels if any_of else want <= t.labels)]

    def edge_tables(self, types: tuple = ()) -> list[EdgeTable]:
        return [t for t in self.edges if not types or t.type in types]

    def id_type(self) -> str:
        return self.nodes[0].df.schema["id"].dataType.simpleString() if self.nodes else "string"

    def scan(self, labels: tuple = (), any_of: bool = False, props: set[str] | None = None) -> DataFrame:
        """id, labels and properties (or those asked for) of all nodes with the labels; unknown labels give no rows."""
        parts = []
        for t in self.node_tables(labels, any_of):
            own = [c for c in t.df.columns if c != "id" and (props is None or c in props)]
            parts.append(t.df.select("id", F.array(*[F.lit(x) for x in sorted(t.labels)]).alias("labels"), *own))
        if not parts:
            return self.spark.createDataFrame([], f"id {self.id_type()}, labels array<string>")
        return union(parts)

    def edge_scan(self, tables: list[EdgeTable]) -> DataFrame:
        """type, src, dst and properties."""
        if not tables:
            kind = self.id_type()
            return self.spark.createDataFrame([], f"type string, src {kind}, dst {kind}")
        return union([t.df.select(F.lit(t.type).alias("type"), *t.df.columns) for t in tables])

    def show_constraints(self) -> DataFrame:
        rows = [(n, rule.upper(), "NODE", [label], list(props)) for n, (rule, label, props) in sorted(self.constraints.items())]
        return self.spark.createDataFrame(rows, "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>")

    def show_indexes(self) -> DataFrame:
        rows = [(n, kind.upper(), "NODE", [label], list(props)) for n, (kind, label, props) in sorted(self.indexes.items())]
        return self.spark.createDataFrame(rows, "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>")


def wider(kinds: set[str]) -> str:
    """The type that holds all of these: double for numbers, lists of it for lists of numbers, else text."""
    numbers = {"int", "bigint", "float", "double"}
    if kinds <= numbers:
        return "double"
    return "array<double>" if kinds <= {f"array<{n}>" for n in numbers} else "string"


def union(parts: list[DataFrame]) -> DataFrame:
    """By name; a property that a table lacks is null, one that differs in type becomes the wider type, else text."""
    if len(parts) == 1:
        return parts[0]
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    fixed = []
    for p in parts:
        cols = [F.col(f.name) if len(kinds[f.name]) == 1 else F.col(f.name).cast(wider(kinds[f.name])).alias(f.name) for f in p.schema]
        fixed.append(p.select(*cols))
    out = fixed[0]
    for p in fixed[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tagged(number: int, key: Column) -> Column:
    """A graph-wide long id from a table's number and its integer key (0 <= key < 2**48)."""
    return F.lit(number << 48) + key.cast("long")


__all__ = ["Catalog", "EdgeTable", "NodeTable", "tagged", "type_of", "union", "wider"]
