"""Syntax tree of the pattern language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class CypherError(ValueError):
    """A query that can't be read or has no meaning."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool


@dataclass(frozen=True)
class HasLabels:
    arg: Any
    labels: tuple
    any_of: bool = False


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListLit:
    items: tuple


@dataclass(frozen=True)
class MapLit:
    items: tuple  # (key, expression)


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    of: Any
    where: Any
    out: Any


@dataclass(frozen=True)
class Quantifier:
    kind: str
    var: str
    of: Any
    where: Any


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: tuple = ()
    any_of: bool = False
    props: tuple = ()
    spread: Any = None


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple
    direction: str  # out, in, both
    low: Any = None
    high: Any = None
    many: bool = False
    props: tuple = ()


@dataclass(frozen=True)
class Chain:
    nodes: tuple
    rels: tuple
    path: str | None = None
    shortest: str | None = None  # one, all


@dataclass(frozen=True)
class Exists:
    chains: tuple
    where: Any = None


@dataclass(frozen=True)
class PatternComp:
    chain: Chain
    where: Any
    out: Any


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str


@dataclass
class Match:
    chains: list[Chain]
    where: Any = None
    optional: bool = False


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = False


@dataclass
class Unwind:
    expr: Any
    var: str


@dataclass
class SubQuery:
    query: "Query"
    imports: list[str] | None


@dataclass
class Procedure:
    name: str
    args: list
    yields: list[tuple[str, str]] | None


@dataclass
class Create:
    chains: list[Chain]


@dataclass
class Merge:
    chain: Chain
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


@dataclass
class SetItem:
    kind: str  # prop, replace, merge, labels
    target: str
    name: Any = None
    value: Any = None


@dataclass
class SetClause:
    items: list[SetItem]


@dataclass
class Remove:
    items: list[SetItem]


@dataclass
class Delete:
    targets: list[str]
    detach: bool


@dataclass
class Foreach:
    var: str
    of: Any
    body: list


@dataclass
class Query:
    parts: list[list]
    dedupe: bool = False  # any plain UNION in the chain


@dataclass
class Schema:
    action: str  # create, drop, show
    kind: str  # constraint, index, vector index, fulltext index
    name: str | None = None
    label: str | None = None
    props: tuple = ()
    rule: str | None = None  # unique, not null
    if_exists: bool = False


@dataclass
class Explain:
    query: Query
    mode: str
