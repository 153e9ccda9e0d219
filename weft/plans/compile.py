"""From the syntax tree to one DataFrame: a hop is a join, EXISTS a semi join, a subquery a window or a grouped join."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.cypher import ast as A
from weft.cypher.ast import CypherError
from weft.cypher.parser import AGGREGATES, has_aggregate, walk
from weft.plans import values as V
from weft.plans.catalog import Catalog, EdgeTable, type_of, union
from weft.plans.expressions import Expressions, Scope, rewrite
from weft.plans.values import Value
from weft.storage import Scratch

#: Hops of an open-ended pattern at most (a fixed value), and hops up to which a bounded one is one plan.
MAX_HOPS, UNROLLED = 64, 6


@dataclass
class Frame:
    df: DataFrame
    scope: Scope = field(default_factory=dict)


def physical(v: Value) -> list[str]:
    return list(v.phys.values())


class Compiler:
    def __init__(self, catalog: Catalog, params: dict[str, Any] | None = None, uniqueness: str = "match", procedures: dict | None = None):
        self.catalog, self.ev = catalog, Expressions(params)
        self.spark = catalog.spark
        self.uniqueness = uniqueness
        self.procedures = procedures or {}
        self.numbers = itertools.count()
        self.used: dict[str, set[str] | None] = {}
        self.labelled: set[str] = set()  # variables whose labels are looked at
        self._scratch: Scratch | None = None
        self.tags: list[str] = []  # columns that tie the rows of a subquery to their outer rows

    @property
    def scratch(self) -> Scratch:
        self._scratch = self._scratch or Scratch(self.spark, "query")
        return self._scratch

    def fresh(self, stem: str) -> str:
        return f"{stem}{next(self.numbers)}"

    # --- queries

    def query(self, q: A.Query) -> DataFrame:
        self.study(q)
        frames = [self.part(clauses, self.unit(), []) for clauses in q.parts]
        return self.joined_parts(q, frames)

    def unit(self) -> Frame:
        return Frame(self.spark.range(1).select())

    def joined_parts(self, q: A.Query, frames: list[Frame]) -> DataFrame:
        outs = [self.output(f) for f in frames]
        if len(outs) == 1:
            return outs[0]
        if any(o.columns != outs[0].columns for o in outs):
            raise CypherError("the parts of a UNION return the same names in the same order")
        for name in outs[0].columns:
            V.common_type([f.scope[name].type for f in frames])
        out = reduce(DataFrame.union, outs)
        return out.distinct() if q.dedupe else out

    def output(self, f: Frame) -> DataFrame:
        out = {name: V.whole(v) if v.type != "null" else F.lit(None).cast("string") for name, v in f.scope.items() if not name.startswith("#")}
        return f.df.select(*[c.alias(name) for name, c in out.items()])

    def study(self, q: Any) -> None:
        """Which properties of which variables are used anywhere; None for all of them."""
        for n in walk(q):
            if isinstance(n, A.Prop) and isinstance(n.of, A.Var):
                if self.used.setdefault(n.of.name, set()) is not None:
                    self.used[n.of.name].add(n.name)
            if isinstance(n, A.NodePat) and n.var:
                self.used.setdefault(n.var, set())
            if isinstance(n, A.RelPat) and n.var:
                self.used.setdefault(n.var, set())
            if isinstance(n, A.HasLabels) and isinstance(n.arg, A.Var):
                self.labelled.add(n.arg.name)
            if isinstance(n, A.Call) and n.name == "labels" and n.args and isinstance(n.args[0], A.Var):
                self.labelled.add(n.args[0].name)
        inner = {id(n.of) for n in walk(q) if isinstance(n, A.Prop)}
        plain = {id(n.args[0]) for n in walk(q) if isinstance(n, A.Call) and n.name in ("count", "id", "elementid", "labels", "type") and n.args}
        plain |= {id(n.arg) for n in walk(q) if isinstance(n, (A.HasLabels, A.IsNull))}
        carried = [n for n in walk(q) if isinstance(n, A.Projection) and not n.final]
        plain |= {id(i.expr) for p in carried for i in p.items if isinstance(i.expr, A.Var)}
        for n in walk(q):
            if isinstance(n, A.Var) and id(n) not in inner and id(n) not in plain:
                self.used[n.name] = None
            if isinstance(n, A.Projection) and n.star and n.final or isinstance(n, A.Chain) and n.path:
                names = {m.var for m in walk(n if isinstance(n, A.Chain) else q) if isinstance(m, (A.NodePat, A.RelPat)) and m.var}
                self.used |= dict.fromkeys(names)
        for p in carried:  # a renamed entity needs what its new name needs
            for i in p.items:
                if isinstance(i.expr, A.Var) and i.alias != i.expr.name:
                    new, old = self.used.get(i.alias, set()), self.used.get(i.expr.name, set())
                    self.used[i.expr.name] = None if new is None or old is None else old | new
                    if i.alias in self.labelled:
                        self.labelled.add(i.expr.name)

    def part(self, clauses: list, f: Frame, keys: list[str]) -> Frame:
        """Run clauses from a frame. ``keys``: columns of the outer rows that a subquery works for."""
        for n, c in enumerate(clauses):
            if isinstance(c, A.Match):
                f = self.optional(c, f) if c.optional else self.match(c.chains, c.where, f)
            elif isinstance(c, A.Projection):
                if c.final and n != len(clauses) - 1:
                    raise CypherError("RETURN ends a query")
                f = self.project(c, f, keys)
            elif isinstance(c, A.Unwind):
                f = self.unwind(c, f)
            elif isinstance(c, A.SubQuery):
                f = self.subquery(c, f)
            elif isinstance(c, A.Procedure):
                f = self.procedure(c, f)
            else:
                raise CypherError(f"{type(c).__name__} changes the graph and can't stand in a read query")
        last = clauses[-1]
        if not (isinstance(last, A.Projection) and last.final) and not isinstance(last, A.Procedure):
            raise CypherError("a query ends with RETURN")
        return f

    # --- patterns

    def where(self, e: Any, f: Frame) -> Frame:
        """Keep the rows for which e is true. Patterns that are terms of an AND become semi and anti joins."""
        if e is None:
            return f
        if isinstance(e, A.Binary) and e.op == "AND":
            return self.where(e.right, self.where(e.left, f))
        negated = isinstance(e, A.Unary) and isinstance(e.arg, A.Exists)
        if isinstance(e, A.Exists) or negated:
            return self.semi(e.arg if negated else e, f, negated)
        g, e = self.lift(f, e)
        out = g.df.where(self.ev.bool(e, g.scope))
        return Frame(out, f.scope) if g is f else Frame(out.drop(*[c for v in g.scope if v not in f.scope for c in physical(g.scope[v])]), f.scope)

    def outer_keys(self, x: Any, f: Frame) -> list[str]:
        """Variables of the frame that x speaks of."""
        names = {n.name for n in walk(x) if isinstance(n, A.Var)} | {n.var for n in walk(x) if isinstance(n, (A.NodePat, A.RelPat)) and n.var}
        return [v for v in f.scope if v in names]

    def inner_frame(self, f: Frame, names: list[str]) -> tuple[Frame, list[str]]:
        """The distinct rows of these variables, to evaluate something for each."""
        cols = [c for v in names for c in physical(f.scope[v])]
        if not cols:
            return Frame(self.unit().df), []
        ids = [c for v in names for c in self.key_columns(f.scope[v])]
        return Frame(f.df.select(*cols).dropDuplicates(ids), {v: f.scope[v] for v in names}), ids

    def key_columns(self, v: Value) -> list[str]:
        if v.flat and v.type == "node":
            return [v.phys["_id"]]
        if v.flat and v.type == "rel":
            return [v.phys[k] for k in ("_type", "_src", "_dst")]
        return physical(v)

    def join_back(self, f: Frame, inner: DataFrame, ids: list[str], extra: list[str], how: str, null_safe: bool = True) -> DataFrame:
        """Join rows of an inner frame to the outer rows of the same key."""
        if not ids:
            small = inner.select(*extra)
            if how == "left_semi":
                return f.df.join(small.limit(1).select(), F.lit(True), "left_semi")
            if how == "left_anti":
                return f.df.join(small.limit(1).select(), F.lit(True), "left_anti")
            return f.df.crossJoin(small) if how == "inner" else f.df.join(small, F.lit(True), "left")
        names = {c: self.fresh("k") for c in ids}
        right = inner.select(*[F.col(c).alias(n) for c, n in names.items()], *extra)
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) if null_safe else F.col(c) == F.col(n) for c, n in names.items()])
        out = f.df.join(right, on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*names.values())

    def null_safe(self, f: Frame, names: list[str]) -> bool:
        return any(f.scope[v].type not in ("node", "rel") for v in names)

    def semi(self, e: A.Exists, f: Frame, negated: bool) -> Frame:
        names = self.outer_keys(e, f)
        inner, ids = self.inner_frame(f, names)
        found = self.match(list(e.chains), e.where, inner)
        return Frame(self.join_back(f, found.df.select(*ids).distinct() if ids else found.df, ids, [], "left_anti" if negated else "left_semi", self.null_safe(f, names)), f.scope)

    def lift(self, f: Frame, e: Any) -> tuple[Frame, Any]:
        """Turn the patterns inside an expression into columns of the frame."""
        if not any(isinstance(n, (A.Exists, A.PatternComp)) for n in walk(e)):
            return f, e
        state = Frame(f.df, dict(f.scope))

        def change(n: Any) -> Any:
            nonlocal state
            if not isinstance(n, (A.Exists, A.PatternComp)):
                return None
            name = "#" + self.fresh("v")
            col = self.fresh("c")
            names = self.outer_keys(n, state)
            inner, ids = self.inner_frame(state, names)
            if isinstance(n, A.Exists):
                found = self.match(list(n.chains), n.where, inner).df.select(*ids).distinct().withColumn(col, F.lit(True))
                df = self.join_back(state, found, ids, [col], "left", self.null_safe(state, names))
                df = df.withColumn(col, F.coalesce(F.col(col), F.lit(False)))
                value = Value(F.col(col), "bool", phys={"": col})
            else:
                m = self.match([n.chain], n.where, inner)
                v = self.ev(n.out, m.scope)
                kind = v.type
                items = m.df.select(*ids, V.whole(v).alias(col)).groupBy(*ids).agg(F.collect_list(col).alias(col))
                df = self.join_back(state, items, ids, [col], "left", self.null_safe(state, names))
                element = items.schema[col].dataType.simpleString()
                df = df.withColumn(col, F.coalesce(F.col(col), F.array().cast(element)))  # empty where nothing matches
                value = Value(F.col(col), f"list<{kind}>", v.fields, phys={"": col})
            state = Frame(df, state.scope | {name: value})
            return A.Var(name)

        e = rewrite(e, change)
        return state, e

    def optional(self, m: A.Match, f: Frame) -> Frame:
        """The pattern and its condition together, joined to every row; null where there is no match."""
        names = self.outer_keys(m, f)
        inner, ids = self.inner_frame(f, names)
        found = self.match(m.chains, m.where, inner)
        new = {v: x for v, x in found.scope.items() if v not in f.scope}
        cols = [c for x in new.values() for c in physical(x)]
        if not f.df.columns and not f.scope:
            return Frame(f.df.join(found.df, F.lit(True), "left"), new)
        return Frame(self.join_back(f, found.df, ids, cols, "left", self.null_safe(f, names)), f.scope | new)

    def match(self, chains: list[A.Chain], where: Any, f: Frame) -> Frame:
        rels: list[tuple[Value, A.RelPat]] = []
        hidden: set[str] = set()
        # chains that touch known variables first, so that joins come before cross products
        todo = list(chains)
        conditions = list(conjuncts(where))

        def settle(f: Frame) -> Frame:
            """Apply the conditions whose variables are all known."""
            ready = [c for c in conditions if not any(isinstance(n, (A.Exists, A.PatternComp)) for n in walk(c)) and {n.name for n in walk(c) if isinstance(n, A.Var)} - inner_names(c) <= set(f.scope)]
            for c in ready:
                conditions.remove(c)
                f = self.where(c, f)
            return f

        while todo:
            at = next((i for i, c in enumerate(todo) if any(n.var in f.scope for n in c.nodes)), 0)
            c = todo.pop(at)
            first = c.nodes[0 if c.shortest else self.anchor(c.nodes, f)]
            if first.var and first.var not in f.scope:  # its conditions hold before anything grows from it
                f = settle(self.bind_node(first, f))
            f = settle(self.chain(c, f, rels, hidden))
        for c in conditions:
            f = self.where(c, f)
        keep = {v: x for v, x in f.scope.items() if v not in hidden}
        cols = list(dict.fromkeys(c for x in keep.values() for c in physical(x)))
        cols += [t for t in self.tags if t in f.df.columns]
        return Frame(f.df.select(*cols) if hidden else f.df, keep)

    def chain(self, c: A.Chain, f: Frame, rels: list, hidden: set[str]) -> Frame:
        nodes = [self.named(n, hidden) for n in c.nodes]
        pats = [self.named(r, hidden) for r in c.rels]
        if c.path:
            for n in [*nodes, *pats]:
                self.used[n.var] = None
        if c.shortest:
            return self.shortest(c, nodes, pats[0], f)
        start = self.anchor(nodes, f)
        f = self.bind_node(nodes[start], f)
        order = [(i, i, i + 1) for i in range(start, len(pats))] + [(i, i + 1, i) for i in range(start - 1, -1, -1)]
        for i, a, b in order:
            f = self.hop(nodes[a], pats[i], nodes[b], f, back=b < a, rels=rels)
        if c.path:
            f = self.path(c.path, nodes, pats, f)
        return f

    def named(self, p: Any, hidden: set[str]) -> Any:
        if p.var:
            return p
        name = "#" + self.fresh("a")
        hidden.add(name)
        self.used.setdefault(name, set())
        return rewrite(p, lambda n: type(n)(**{**{k: getattr(n, k) for k in n.__dataclass_fields__}, "var": name}) if n is p else None)

    def anchor(self, nodes: list[A.NodePat], f: Frame) -> int:
        """Where to begin: a known node, else one with properties given, else one with a label."""
        rank = lambda i: (nodes[i].var not in f.scope, not (nodes[i].props or nodes[i].spread), not nodes[i].labels, i)
        return min(range(len(nodes)), key=rank)

    def needed(self, n: A.NodePat | A.RelPat) -> set[str] | None:
        own = self.used.get(n.var, set())
        return None if own is None else own | {k for k, _ in n.props}

    def node_value(self, prefix: str, df: DataFrame) -> Value:
        """A node from a table with the columns id, labels and properties, renamed with a prefix."""
        fields, phys = {}, {}
        for c in df.schema:
            key = {"id": "_id", "labels": "_labels"}.get(c.name, c.name)
            phys[key] = f"{prefix}__{c.name}"
            fields[key] = Value(F.col(phys[key]), type_of(c.dataType), phys={"": phys[key]})
        return Value(fields["_id"].col, "node", fields, True, phys)

    def scan_node(self, n: A.NodePat) -> tuple[DataFrame, Value]:
        if n.spread is not None:
            raise CypherError("a map can't be spread in MATCH")
        df = self.catalog.scan(n.labels, n.any_of, self.needed(n))
        prefix = self.fresh("n")
        v = self.node_value(prefix, df)
        return df.select(*[F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in df.columns]), v

    def node_conditions(self, n: A.NodePat, f: Frame) -> Frame:
        v = f.scope[n.var]
        df = f.df
        for k, e in n.props:
            df = df.where(V.equal(V.part(v, "_id" if k == "_id" else k), self.ev(e, f.scope)))
        return Frame(df, f.scope)

    def bind_node(self, n: A.NodePat, f: Frame) -> Frame:
        if n.var in f.scope:
            v = f.scope[n.var]
            if v.type != "node":
                raise CypherError(f"{n.var} is no node")
            if n.labels:
                f = Frame(f.df.where(self.ev.bool(A.HasLabels(A.Var(n.var), n.labels, n.any_of), f.scope)), f.scope)
            return self.node_conditions(n, f)
        df, v = self.scan_node(n)
        alone = not f.scope and not f.df.columns
        g = self.node_conditions(n, Frame(df, f.scope | {n.var: v})) if not depends(n, f.scope) else None
        if g is not None:
            return Frame(g.df if alone else f.df.crossJoin(g.df), f.scope | {n.var: v})
        equal = [(k, e) for k, e in n.props if not depends(e, {n.var: v})]
        on = reduce(lambda a, b: a & b, [V.equal(V.part(v, k), self.ev(e, f.scope)) for k, e in equal])
        return Frame(f.df.join(df, on, "inner"), f.scope | {n.var: v})

    def edges(self, pat: A.RelPat, near: tuple, far: tuple, direction: str) -> list[EdgeTable]:
        """Edge tables of the types whose ends can have the labels."""
        out = []
        for t in self.catalog.edge_tables(pat.types):
            ways = {"out": [(t.src_label, t.dst_label)], "in": [(t.dst_label, t.src_label)], "both": [(t.src_label, t.dst_label), (t.dst_label, t.src_label)]}[direction]
            if any((a is None or not near or a in near or self.shared(a, near)) and (b is None or not far or b in far or self.shared(b, far)) for a, b in ways):
                out.append(t)
        return out

    def shared(self, a: str, labels: tuple) -> bool:
        return any(a in t.labels and t.labels & set(labels) for t in self.catalog.nodes)

    def steps(self, tables: list[EdgeTable], direction: str, props: set[str] | None, prefix: str) -> tuple[DataFrame, Value]:
        """near, far and the relationship, one row per edge and way it may be followed; a self-loop once."""
        df = self.catalog.edge_scan(tables)
        own = [c for c in df.columns if c not in ("type", "src", "dst") and (props is None or c in props)]
        keep = {"_type": "type", "_src": "src", "_dst": "dst"} | {c: c for c in own}
        cols = [F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in keep.values()]
        out = df.select(F.col("src").alias("near"), F.col("dst").alias("far"), *cols)
        back = df.select(F.col("dst").alias("near"), F.col("src").alias("far"), *cols)
        res = out if direction == "out" else back if direction == "in" else out.unionByName(back.where(F.col(f"{prefix}__src") != F.col(f"{prefix}__dst")))
        kinds = {f.name: f.dataType for f in df.schema}
        fields = {k: Value(F.col(f"{prefix}__{c}"), type_of(kinds[c]), phys={"": f"{prefix}__{c}"}) for k, c in keep.items()}
        return res, Value(fields["_src"].col, "rel", fields, True, {k: f"{prefix}__{c}" for k, c in keep.items()})

    def hop(self, a: A.NodePat, r: A.RelPat, b: A.NodePat, f: Frame, back: bool, rels: list) -> Frame:
        direction = r.direction if not back or r.direction == "both" else {"out": "in", "in": "out"}[r.direction]
        source = f.scope[a.var]
        if r.many:
            return self.walk_hop(a, r, b, f, direction, back)
        tables = self.edges(r, a.labels, b.labels if b.var not in f.scope else (), direction)
        prefix = self.fresh("r")
        steps, rel = self.steps(tables, direction, self.needed(r), prefix)
        near, far = self.fresh("k"), self.fresh("k")
        steps = steps.withColumnsRenamed({"near": near, "far": far})
        scope = f.scope | {r.var: rel} if r.var not in f.scope else f.scope
        known = {}
        for k, e in r.props:
            if not depends(e, f.scope):
                steps = steps.where(V.equal(V.part(rel, k), self.ev(e, {})))
            else:
                known[k] = e
        on = V.part(source, "_id").col == F.col(near)
        if r.var in f.scope:
            on = on & (V.entity_key(f.scope[r.var]) == V.entity_key(rel))
        bound = b.var in f.scope
        if bound:
            on = on & (V.part(f.scope[b.var], "_id").col == F.col(far))
        df = f.df.join(steps, on, "inner")
        g = Frame(df, scope)
        for k, e in known.items():
            g = Frame(g.df.where(V.equal(V.part(rel, k), self.ev(e, f.scope))), scope)
        g = self.distinct_from(g, rel, r, rels)
        rels.append((rel, r))
        g = self.bind_node(b, Frame(g.df.drop(near, far), scope)) if bound else self.land(b, g, far, tables, direction, near)
        return g

    def distinct_from(self, f: Frame, rel: Value, pat: A.RelPat, before: list) -> Frame:
        """No relationship twice in one MATCH, unless uniqueness is by segment."""
        if self.uniqueness != "match":
            return f
        df = f.df
        for other, old in before:
            if not pat.types or not old.types or set(pat.types) & set(old.types):
                same = (V.part(rel, "_src").col == V.part(other, "_src").col) & (V.part(rel, "_dst").col == V.part(other, "_dst").col)
                df = df.where(~(same & (V.part(rel, "_type").col == V.part(other, "_type").col)))
        return Frame(df, f.scope)

    def land(self, n: A.NodePat, f: Frame, far: str, tables: list[EdgeTable], direction: str, *drop: str) -> Frame:
        """Bind the node at the far end; its table is joined only if its labels or properties matter."""
        need = self.needed(n)
        ends = {"out": {t.dst_label for t in tables}, "in": {t.src_label for t in tables}}.get(direction, {x for t in tables for x in (t.src_label, t.dst_label)})
        sure = len(ends) == 1 and None not in ends and set(n.labels) <= ends
        if need is not None and not need - {"_id"} and (sure or not n.labels and n.var not in self.labelled and all(t.dst_label and t.src_label for t in tables)):
            prefix = self.fresh("n")
            df = f.df.withColumnRenamed(far, f"{prefix}__id")
            phys = {"_id": f"{prefix}__id"}
            fields = {"_id": Value(F.col(phys["_id"]), type_of(df.schema[phys["_id"]].dataType), phys={"": phys["_id"]})}
            if sure:
                df = df.withColumn(f"{prefix}__labels", F.when(F.col(phys["_id"]).isNotNull(), F.array(*[F.lit(x) for x in sorted(ends)])))
                phys["_labels"] = f"{prefix}__labels"
                fields["_labels"] = Value(F.col(phys["_labels"]), "list<str>", phys={"": phys["_labels"]})
            v = Value(F.col(phys["_id"]), "node", fields, True, phys)
            return self.node_conditions(n, Frame(df.drop(*drop), f.scope | {n.var: v}))
        nodes, v = self.scan_node(n)
        df = f.df.join(nodes, F.col(far) == V.part(v, "_id").col, "inner").drop(far, *drop)
        return self.node_conditions(n, Frame(df, f.scope | {n.var: v}))

    def hops(self, r: A.RelPat) -> tuple[int, int]:
        low = 1 if r.low is None else self.ev.number(r.low)
        high = MAX_HOPS if r.high is None else self.ev.number(r.high)
        if high < low:
            raise CypherError("the greatest number of hops is below the least")
        return low, high

    def trails(self, starts: DataFrame, r: A.RelPat, tables: list[EdgeTable], direction: str) -> DataFrame:
        """start, end, rels, ids: all walks without a repeated relationship, from low to high hops.

        Short bounded patterns are one plan; longer ones grow level by level until no walk can be continued.
        """
        low, high = self.hops(r)
        steps, rel = self.steps(tables, direction, self.needed(r), "s")
        for k, e in r.props:
            steps = steps.where(V.equal(V.part(rel, k), self.ev(e, {})))
        one = F.struct(*[v.col.alias(k) for k, v in rel.fields.items()])
        steps = steps.select("near", "far", one.alias("rel"))
        key = lambda x: F.struct(x["_type"], x["_src"], x["_dst"])
        kind = steps.schema["rel"].dataType.simpleString()
        level = starts.select(F.col("start"), F.col("start").alias("end"), F.array().cast(f"array<{kind}>").alias("rels"), F.array("start").alias("ids"))
        out = [level] if low == 0 else []
        for n in range(1, high + 1):
            grown = level.join(steps, F.col("end") == F.col("near")).where(~F.exists("rels", lambda x: key(x) == key(F.col("rel"))))
            level = grown.select("start", F.col("far").alias("end"), F.concat("rels", F.array("rel")).alias("rels"), F.concat("ids", F.array("far")).alias("ids"))
            if high > UNROLLED:
                level = self.scratch.write(level)
                if level.isEmpty():
                    break
            if n >= low:
                out.append(level)
        if not out:
            out = [level.limit(0)]
        return reduce(DataFrame.unionByName, out)

    def walk_hop(self, a: A.NodePat, r: A.RelPat, b: A.NodePat, f: Frame, direction: str, back: bool) -> Frame:
        source = V.part(f.scope[a.var], "_id").col
        tables = self.edges(r, (), (), direction)
        prefix = self.fresh("w")
        found = self.trails(f.df.select(source.alias("start")).where("start IS NOT NULL").distinct(), r, tables, direction)
        rels, ids = F.col("rels"), F.col("ids")
        if back:  # told in the order of the pattern
            rels, ids = F.reverse(rels), F.reverse(ids)
        found = found.select(F.col("start").alias(f"{prefix}s"), F.col("end").alias(f"{prefix}e"), rels.alias(f"{prefix}r"), ids.alias(f"{prefix}i"))
        _, rel = self.steps(tables, direction, self.needed(r), "s")
        lists = {
            r.var: Value(F.col(f"{prefix}r"), "list<rel>", rel.fields, phys={"": f"{prefix}r"}),
            "#ids " + r.var: Value(F.col(f"{prefix}i"), "list<any>", phys={"": f"{prefix}i"}),
        }
        on = source == F.col(f"{prefix}s")
        if b.var in f.scope:
            on = on & (V.part(f.scope[b.var], "_id").col == F.col(f"{prefix}e"))
            df = f.df.join(found, on).drop(f"{prefix}s", f"{prefix}e")
            return self.bind_node(b, Frame(df, f.scope | lists))
        df = f.df.join(found, on).drop(f"{prefix}s")
        return self.land(b, Frame(df, f.scope | lists), f"{prefix}e", [EdgeTable("", self.unit().df)], direction)

    def shortest(self, c: A.Chain, nodes: list[A.NodePat], r: A.RelPat, f: Frame) -> Frame:
        """Breadth first from all sources at once; a vertex is left out once it was reached on an earlier level."""
        f = self.bind_node(nodes[0], f)
        goal_known = nodes[1].var in f.scope
        if goal_known:
            f = self.bind_node(nodes[1], f)
        a = V.part(f.scope[nodes[0].var], "_id").col
        b = V.part(f.scope[nodes[1].var], "_id").col if goal_known else None
        low, high = self.hops(r) if r.many else (1, 1)
        tables = self.edges(r, (), (), r.direction)
        steps, rel = self.steps(tables, r.direction, self.needed(r), "s")
        for k, e in r.props:
            steps = steps.where(V.equal(V.part(rel, k), self.ev(e, {})))
        steps = steps.select("near", "far", F.struct(*[v.col.alias(k) for k, v in rel.fields.items()]).alias("rel"))
        kind = steps.schema["rel"].dataType.simpleString()
        base = self.scratch.write(f.df)
        starts = base.select(a.alias("start")).where("start IS NOT NULL").distinct()
        pairs = None
        if goal_known:
            pairs = self.scratch.write(base.select(a.alias("start"), b.alias("goal")).where("start IS NOT NULL AND goal IS NOT NULL AND start <> goal").distinct())
            starts = pairs.select("start").distinct()
        level = self.scratch.write(starts.select("start", F.col("start").alias("end"), F.array().cast(f"array<{kind}>").alias("rels"), F.array("start").alias("ids")))
        seen = level.select("start", "end")
        found: list[DataFrame] = []
        for n in range(1, high + 1):
            grown = level.join(steps, F.col("end") == F.col("near")).select("start", F.col("far").alias("end"), F.concat("rels", F.array("rel")).alias("rels"), F.concat("ids", F.array("far")).alias("ids"))
            grown = grown.join(seen, ["start", "end"], "left_anti")
            if c.shortest == "one":
                grown = grown.groupBy("start", "end").agg(F.min_by(F.struct("rels", "ids"), F.col("ids")).alias("p")).select("start", "end", "p.rels", "p.ids")
            level = self.scratch.write(grown)
            if level.isEmpty():
                break
            seen = self.scratch.write(seen.unionByName(level.select("start", "end").distinct()))
            if n >= low and pairs is None:
                found.append(level)
            elif n >= low:
                hit = level.join(pairs.withColumnRenamed("goal", "end"), ["start", "end"], "left_semi")
                found.append(hit)
                pairs = self.scratch.write(pairs.join(hit.select("start", F.col("end").alias("goal")).distinct(), ["start", "goal"], "left_anti"))
                if pairs.isEmpty():
                    break
                level = self.scratch.write(level.join(pairs.select("start").distinct(), "start", "left_semi"))
        out = reduce(DataFrame.unionByName, found) if found else level.limit(0)
        prefix = self.fresh("w")
        out = out.select(*[F.col(x).alias(prefix + y) for x, y in (("start", "s"), ("end", "e"), ("rels", "r"), ("ids", "i"))])
        on = a == F.col(prefix + "s")
        df = base.join(out, on & (b == F.col(prefix + "e")) if goal_known else on)
        df = df.drop(prefix + "s", prefix + "e") if goal_known else df.drop(prefix + "s")
        scope = f.scope | {
            r.var: Value(F.col(prefix + "r"), "list<rel>", rel.fields, phys={"": prefix + "r"}),
            "#ids " + r.var: Value(F.col(prefix + "i"), "list<any>", phys={"": prefix + "i"}),
        }
        g = Frame(df, scope)
        if not goal_known:
            g = self.land(nodes[1], g, prefix + "e", [EdgeTable("", self.unit().df)], r.direction)
        return self.path(c.path, nodes, [A.RelPat(r.var, r.types, r.direction, many=True)], g) if c.path else g

    def path(self, name: str, nodes: list[A.NodePat], pats: list[A.RelPat], f: Frame) -> Frame:
        """A struct of the nodes and relationships in order. Nodes inside a variable stretch are given with their id."""
        any_many = any(p.many for p in pats)
        own = f.scope[nodes[0].var]
        props = sorted({k for n in nodes for k in f.scope[n.var].fields if not k.startswith("_")})
        kinds = {k: V.common_type([f.scope[n.var].fields[k].type for n in nodes if k in f.scope[n.var].fields]) for k in props}
        id_type = f.df.schema[own.phys["_id"]].dataType.simpleString()

        def full(v: Value) -> Column:
            labels = V.part(v, "_labels").col.cast("array<string>")
            return F.struct(V.part(v, "_id").col.cast(id_type).alias("_id"), labels.alias("_labels"), *[V.part(v, k).col.cast(V.spark_type(kinds[k])).alias(k) for k in props])

        def stub(x: Column) -> Column:
            return F.struct(x.cast(id_type).alias("_id"), F.lit(None).cast("array<string>").alias("_labels"), *[F.lit(None).cast(V.spark_type(kinds[k])).alias(k) for k in props])

        ns: list[Column] = [F.array(full(own))]
        rs: list[Column] = []
        rel_props = sorted({k for p in pats for k in f.scope[p.var].fields if not k.startswith("_")})
        rel_kinds = {k: V.common_type([f.scope[p.var].fields[k].type for p in pats if k in f.scope[p.var].fields]) for k in rel_props}

        def rel_struct(v: Value) -> Column:
            return F.struct(*[V.part(v, k).col.alias(k) for k in ("_type", "_src", "_dst")], *[V.part(v, k).col.cast(V.spark_type(rel_kinds[k])).alias(k) for k in rel_props])

        def each_rel(v: Value):
            return lambda x: rel_struct(Value(x, "rel", v.fields))

        for p, n in zip(pats, nodes[1:]):
            v = f.scope[p.var]
            if p.many:
                ids = f.scope["#ids " + p.var].col
                ns.append(F.transform(F.slice(ids, 2, F.greatest(F.size(ids) - 2, F.lit(0))), stub))
                # no node is added by a stretch of no hops
                ns.append(F.when(F.size(ids) > 1, F.array(full(f.scope[n.var]))).otherwise(F.slice(F.array(full(f.scope[n.var])), 1, 0)))
                rs.append(F.transform(v.col, each_rel(v)))
            else:
                ns.append(F.array(full(f.scope[n.var])))
                rs.append(F.array(rel_struct(v)))
        col = self.fresh("p")
        rel_fields = {k: Value(F.lit(None), t) for k, t in (("_type", "str"), ("_src", "any"), ("_dst", "any"), *rel_kinds.items())}
        node_fields = {"_id": own.fields["_id"], "_labels": Value(F.lit(None), "list<str>"), **{k: Value(F.lit(None), t) for k, t in kinds.items()}}
        empty = F.array().cast("array<struct<_type:string,_src:%s,_dst:%s>>" % (id_type, id_type))
        df = f.df.withColumn(col, F.struct(F.concat(*ns).alias("nodes"), (F.concat(*rs) if rs else empty).alias("rels")))
        if any_many and props:
            df = self.fill_nodes(df, col, props, kinds)
        v = Value(F.col(col), "path", {"nodes": Value(F.lit(None), "list<node>", node_fields), "rels": Value(F.lit(None), "list<rel>", rel_fields)}, phys={"": col})
        return Frame(df, f.scope | {name: v})

    def fill_nodes(self, df: DataFrame, col: str, props: list[str], kinds: dict[str, str]) -> DataFrame:
        """Look up the properties of nodes that a path knows by id only, with one join over the distinct ids."""
        base = self.scratch.write(df.withColumn("__row", F.expr("uuid()")))
        nodes = self.catalog.scan(props=set(props))
        have = set(nodes.columns)
        known = nodes.select(F.col("id").alias("__id"), F.struct(F.col("id").alias("_id"), F.col("labels").alias("_labels"), *[(F.col(k) if k in have else F.lit(None)).cast(V.spark_type(kinds[k])).alias(k) for k in props]).alias("__n"))
        items = base.select("__row", F.posexplode(f"{col}.nodes").alias("__at", "__stub")).join(known, F.col("__stub._id") == F.col("__id"), "left")
        lists = items.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("__n", "__stub").alias("n")))), lambda s: s["n"]).alias("__nodes"))
        return base.join(lists, "__row").withColumn(col, F.struct(F.col("__nodes").alias("nodes"), F.col(f"{col}.rels").alias("rels"))).drop("__row", "__nodes")

    # --- rows

    def unwind(self, u: A.Unwind, f: Frame) -> Frame:
        g, e = self.lift(f, u.expr)
        v = self.ev(e, g.scope)
        col = self.fresh("c")
        if v.type == "null":
            return Frame(g.df.where(F.lit(False)).withColumn(col, F.lit(None)), f.scope | {u.var: Value(F.col(col), "null", phys={"": col})})
        if not v.type.startswith("list<"):
            raise CypherError("UNWIND needs a list")
        return Frame(g.df.withColumn(col, F.explode(v.col)), f.scope | {u.var: Value(F.col(col), V.item_type(v.type), v.fields, phys={"": col})})

    def subquery(self, s: A.SubQuery, f: Frame) -> Frame:
        if s.imports is None:
            frames = [self.part(c, self.unit(), []) for c in s.query.parts]
            if len(frames) > 1:
                out = self.joined_parts(s.query, frames)
                names = {c: self.fresh("c") for c in out.columns}
                inner = out.withColumnsRenamed(names)
                scope = {c: Value(F.col(n), frames[0].scope[c].type, frames[0].scope[c].fields, phys={"": n}) for c, n in names.items()}
            else:
                inner, scope = frames[0].df.select(*[c for v in frames[0].scope.values() for c in physical(v)]), frames[0].scope
            alone = not f.scope and not f.df.columns
            return Frame(inner if alone else f.df.crossJoin(inner), f.scope | scope)
        missing = [n for n in s.imports if n not in f.scope]
        if missing:
            raise CypherError(f"unknown variable {missing[0]}")
        inner, ids = self.inner_frame(f, s.imports)
        clauses = s.query.parts[0]
        tags = {c: self.fresh("t") for c in ids}  # the keys under names of their own, since a body may drop or rename
        inner = Frame(inner.df.withColumns({t: F.col(c) for c, t in tags.items()}), inner.scope)
        self.tags += tags.values()
        out = self.part(clauses, inner, list(tags.values()))
        last = clauses[-1]
        clash = set(out.scope) & set(f.scope)
        if clash:
            raise CypherError(f"a subquery can't return {clash.pop()} again")
        new = {v: x for v, x in out.scope.items() if not v.startswith("#")}
        # physical names are unique in a query, but a returned import would bring its columns twice
        moved, cols = {}, []
        for v, x in new.items():
            names = {k: self.fresh("c") for k in x.phys}
            cols += [F.col(c).alias(names[k]) for k, c in x.phys.items()]
            if x.flat:
                fields = {k: Value(F.col(names[k]), x.fields[k].type, x.fields[k].fields, phys={"": names[k]}) for k in x.phys}
                moved[v] = Value(next(iter(fields.values())).col, x.type, fields, True, names)
            else:
                moved[v] = Value(F.col(names[""]), x.type, x.fields, phys=names)
        right = out.df.select(*[F.col(t).alias(t) for t in tags.values()], *cols)
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(t)) for c, t in tags.items()])
        whole_aggregate = isinstance(last, A.Projection) and any(has_aggregate(i.expr) for i in last.items) and all(has_aggregate(i.expr) for i in last.items) and last.limit is None
        df = f.df.join(right, on, "left" if whole_aggregate else "inner").drop(*tags.values())
        if whole_aggregate:  # an aggregate over no rows is still a row
            for i in last.items:
                if isinstance(i.expr, A.Call) and i.expr.name in ("count", "sum"):
                    c = moved[i.alias].phys[""]
                    df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
                elif isinstance(i.expr, A.Call) and i.expr.name == "collect":
                    c = moved[i.alias].phys[""]
                    df = df.withColumn(c, F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)))
        return Frame(df, f.scope | moved)

    def procedure(self, p: A.Procedure, f: Frame) -> Frame:
        run = self.procedures.get(p.name.lower())
        if run is None:
            raise CypherError(f"no procedure {p.name}")
        args = [constant(a, self.ev) for a in p.args]
        out: DataFrame = run(self.catalog, *args)
        scope, df = {}, out
        names = {c: self.fresh("c") for c in out.columns}
        df = out.withColumnsRenamed(names)
        for have, alias in p.yields or [(c, c) for c in out.columns]:
            if have not in names:
                raise CypherError(f"{p.name} doesn't yield {have}")
            t = out.schema[have].dataType
            if have in ("node_id", "node"):
                df, v = self.looked_up(df, names[have], alias)
                scope[alias] = v
            else:
                scope[alias] = Value(F.col(names[have]), type_of(t), phys={"": names[have]})
        alone = not f.scope and not f.df.columns
        return Frame(df if alone else f.df.crossJoin(df), f.scope | scope)

    def looked_up(self, df: DataFrame, col: str, alias: str) -> tuple[DataFrame, Value]:
        """A yielded node: its id, and its properties if the query speaks of them."""
        need = self.used.get(alias, set())
        if need is not None and not need - {"_id"}:
            v = Value(F.col(col), "node", {"_id": Value(F.col(col), type_of(df.schema[col].dataType), phys={"": col})}, True, {"_id": col})
            return df, v
        nodes = self.catalog.scan(props=need)
        prefix = self.fresh("n")
        v = self.node_value(prefix, nodes)
        nodes = nodes.select(*[F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in nodes.columns])
        return df.join(nodes, F.col(col) == F.col(f"{prefix}__id")).drop(col), v

    # --- projections

    def project(self, p: A.Projection, f: Frame, keys: list[str]) -> Frame:
        items = list(p.items)
        if p.star:
            items = [A.Item(A.Var(v), v) for v in sorted(f.scope) if not v.startswith("#")] + items
        names = [i.alias for i in items]
        if len(set(names)) != len(names):
            raise CypherError("a projection gives each name once")
        order = [(rewrite(e, lambda n: next((A.Var(i.alias) for i in items if i.expr == n and not isinstance(n, A.Var)), None)), down) for e, down in p.order]
        if any(has_aggregate(i.expr) for i in items):
            f, items, order = self.aggregate(items, order, f, keys)
        scope, cols = {}, []
        g = f
        lifted = []
        for i in items:
            g, e = self.lift(g, i.expr)
            lifted.append(A.Item(e, i.alias))
        for i in lifted:
            v = self.ev(i.expr, g.scope)
            if v.flat and v.phys:
                scope[i.alias] = v
                cols += [F.col(c) for c in physical(v)]
            else:
                name = self.fresh("c")
                cols.append(V.whole(v).alias(name))
                scope[i.alias] = Value(F.col(name), v.type, v.fields, phys={"": name})
        seen: set[str] = set()
        cols = [c for c in cols if not (str(c) in seen or seen.add(str(c)))]
        # sort keys that the output doesn't hold
        hidden, sorts = [], []
        for e, down in order:
            free = {n.name for n in walk(e) if isinstance(n, A.Var)}
            if free <= set(scope):
                sorts.append((e, down))
                continue
            if p.distinct:
                raise CypherError("with DISTINCT, ORDER BY speaks of the output only")
            v = self.ev(e, g.scope | {k: x for k, x in scope.items() if k in g.scope and x.flat})
            name = self.fresh("o")
            hidden.append(V.entity_key(v).alias(name))
            sorts.append((Value(F.col(name), v.type if v.type not in ("node", "rel") else "any"), down))
        tagged = [F.col(k) for k in keys]
        df = g.df.select(*tagged, *cols, *hidden)
        if p.distinct:
            ids = [c for v in scope.values() for c in self.key_columns(v)]
            df = df.dropDuplicates([*keys, *ids]) if keys or ids else df.limit(1)
        specs = [V.sort_keys(e if isinstance(e, Value) else self.ev(e, scope), down) for e, down in sorts]
        skip = None if p.skip is None else self.ev.number(p.skip)
        limit = None if p.limit is None else self.ev.number(p.limit)
        if keys and (skip or limit is not None):
            place = F.row_number().over(W.partitionBy(*keys).orderBy(*(specs or [F.lit(0)])))
            col = self.fresh("o")
            df = df.withColumn(col, place)
            df = df.where(F.col(col) > (skip or 0)) if skip else df
            df = df.where(F.col(col) <= (skip or 0) + limit) if limit is not None else df
            df = df.drop(col)
        elif not keys:
            df = df.orderBy(*specs) if specs else df
            df = df.offset(skip) if skip else df
            df = df.limit(limit) if limit is not None else df
        out = Frame(df.drop(*[h for h in df.columns if h.startswith("o") and h[1:].isdigit()]) if hidden else df, scope)
        return self.where(p.where, out)

    def aggregate(self, items: list[A.Item], order: list, f: Frame, keys: list[str]) -> tuple[Frame, list[A.Item], list]:
        """Group by the items without aggregates; aggregates inside other expressions become columns of their own."""
        calls: dict[Any, str] = {}

        def hoist(n: Any) -> Any:
            if isinstance(n, A.Call) and n.name in AGGREGATES:
                return A.Var(calls.setdefault(n, "#" + self.fresh("g")))
            return None

        groups = [i for i in items if not has_aggregate(i.expr)]
        inner = [A.Item(rewrite(i.expr, hoist), i.alias) if has_aggregate(i.expr) else A.Item(A.Var(i.alias), i.alias) for i in items]
        order = [(rewrite(e, hoist), down) for e, down in order]
        by: list[Column] = [F.col(k) for k in keys]
        rest: list[Column] = []
        scope: Scope = {}
        for i in groups:
            f, e = self.lift(f, i.expr)
            v = self.ev(e, f.scope)
            if v.flat and v.phys:
                ids = self.key_columns(v)
                by += [F.col(c) for c in ids]
                rest += [F.first(c).alias(c) for c in physical(v) if c not in ids]
                scope[i.alias] = v
            else:
                name = self.fresh("c")
                by.append(V.whole(v).alias(name))
                scope[i.alias] = Value(F.col(name), v.type, v.fields, phys={"": name})
        # a plain variable that an aggregating expression also speaks of must be a key
        free = {n.name for i in inner for n in walk(i.expr) if isinstance(n, A.Var)} - set(calls.values()) - set(scope) - {n for i in inner for n in inner_names(i.expr)}
        if free:
            raise CypherError(f"{sorted(free)[0]} stands beside an aggregate and is no group key")
        aggs = []
        for call, name in calls.items():
            f, call = self.lift(f, call)
            col = self.fresh("c")
            v = self.aggregate_call(call, f.scope)
            aggs.append(v.col.alias(col))
            scope[name] = Value(F.col(col), v.type, v.fields, phys={"": col})
        rest_names = set()
        rest = [c for c in rest if not (str(c) in rest_names or rest_names.add(str(c)))]
        names = set()
        by = [c for c in by if not (str(c) in names or names.add(str(c)))]
        df = f.df.groupBy(*by).agg(*aggs, *rest) if by else f.df.agg(*aggs)
        return Frame(df, scope), inner, order

    def aggregate_call(self, c: A.Call, scope: Scope) -> Value:
        if c.star:
            return Value(F.count(F.lit(1)), "int")
        if len(c.args) != 1:
            raise CypherError(f"{c.name}() takes one argument")
        if has_aggregate(c.args[0]):
            raise CypherError("an aggregate of an aggregate")
        v = self.ev(c.args[0], scope)
        key = V.entity_key(v) if v.type in ("node", "rel") else v.col
        if c.name == "count":
            there = V.key_part(v) if v.type in ("node", "rel") else v.col
            return Value(F.count_distinct(F.when(there.isNotNull(), key)) if c.distinct else F.count(there), "int")
        if c.name == "collect":
            col = V.whole(v)
            return Value(F.collect_set(col) if c.distinct else F.collect_list(col), f"list<{v.type}>", v.fields)
        if c.name in ("min", "max"):
            return Value(F.min(key) if c.name == "min" else F.max(key), v.type, v.fields)
        if v.type == "null":
            return Value(F.coalesce(F.sum(F.lit(None).cast("bigint")), F.lit(0)), "int") if c.name == "sum" else Value(F.avg(F.lit(None).cast("double")), "float")
        if not V.is_number(v.type):
            raise CypherError(f"{c.name}() of {v.type}")
        if c.name == "sum":
            total = F.sum_distinct(v.col) if c.distinct else F.sum(v.col)
            return Value(F.coalesce(total, F.lit(0).cast(V.SPARK[v.type])), v.type)
        if c.distinct:
            return Value(F.sum_distinct(v.col.cast("double")) / F.nullif(F.count_distinct(v.col), F.lit(0)), "float")
        return Value(F.avg(v.col.cast("double")), "float")


def conjuncts(e: Any) -> list:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Binary) and e.op == "AND" else [e]


def inner_names(e: Any) -> set[str]:
    """Variables that an expression itself binds."""
    return {n.var for n in walk(e) if isinstance(n, (A.Comprehension, A.Quantifier))}


def depends(x: Any, scope: Scope) -> bool:
    return any(isinstance(n, A.Var) and n.name in scope for n in walk(x if not isinstance(x, A.NodePat) else [e for _, e in x.props]))


def constant(e: Any, ev: Expressions) -> Any:
    """A literal argument of a procedure as a Python value."""
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Param):
        return ev.param(e.name)
    if isinstance(e, A.ListLit):
        return [constant(x, ev) for x in e.items]
    if isinstance(e, A.MapLit):
        return {k: constant(x, ev) for k, x in e.items}
    if isinstance(e, A.Unary) and e.op == "-":
        return -constant(e.arg, ev)
    raise CypherError("a procedure takes literals and parameters")


__all__ = ["Compiler", "Frame", "union"]
