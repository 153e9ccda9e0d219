"""Statements that change the graph: they build new tables and swap them in when all of them are written."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from weft.cypher import ast as A
from weft.cypher.ast import CypherError
from weft.plans import values as V
from weft.plans.catalog import Catalog, EdgeTable, NodeTable, type_of, union, wider
from weft.plans.compile import Compiler, Frame, physical
from weft.plans.values import Value

WRITES = (A.Create, A.Merge, A.SetClause, A.Remove, A.Delete, A.Foreach)
COUNTERS = ("nodes_created", "nodes_deleted", "relationships_created", "relationships_deleted", "properties_set", "labels_set")


def is_write(q: A.Query) -> bool:
    return any(isinstance(c, WRITES) for part in q.parts for c in part)


def schema(session: Any, q: A.Schema) -> DataFrame:
    g: Catalog = session.catalog
    if q.action == "show":
        return g.show_constraints() if q.kind == "constraint" else g.show_indexes()
    g = g.copy()
    own = g.constraints if q.kind == "constraint" else g.indexes
    if q.action == "drop":
        if q.name not in own and not q.if_exists:
            raise CypherError(f"no {q.kind} {q.name}")
        own.pop(q.name, None)
    else:
        name = q.name or f"{q.label}_{'_'.join(q.props)}_{(q.rule or q.kind).replace(' ', '_')}".lower()
        if name in own:
            if not q.if_exists:
                raise CypherError(f"there is a {q.kind} {name} already")
        else:
            own[name] = (q.rule or q.kind, q.label, q.props)
            check_constraints(g)
    session.catalog = g
    return session.spark.createDataFrame([], "name string")


def check_constraints(g: Catalog) -> None:
    """Raise on the first violation. A unique rule holds for nodes that have all its properties; the vectors under a
    vector index are of one dimension."""
    for name, (kind, label, props) in g.indexes.items():
        rows = g.scan((label,), props=set(props))
        if kind == "vector index" and props[0] in rows.columns and rows.schema[props[0]].dataType.typeName() == "array":
            sizes = rows.where(F.col(props[0]).isNotNull()).select(F.size(props[0])).distinct().limit(2).collect()
            if len(sizes) > 1:
                raise CypherError(f"{name}: vectors of {label} have {sizes[0][0]} and {sizes[1][0]} values")
    for name, (rule, label, props) in g.constraints.items():
        rows = g.scan((label,), props=set(props))
        for p in props:
            if p not in rows.columns:
                rows = rows.withColumn(p, F.lit(None).cast("string"))
        if rule == "not null":
            for p in props:
                if not rows.where(F.col(p).isNull()).isEmpty():
                    raise CypherError(f"{name}: a {label} has no {p}")
        else:
            there = rows
            for p in props:
                there = there.where(F.col(p).isNotNull())
            twice = there.groupBy(*props).count().where("count > 1").limit(1).collect()
            if twice:
                raise CypherError(f"{name}: {', '.join(f'{p} = {twice[0][p]!r}' for p in props)} is there {twice[0]['count']} times for {label}")


@dataclass
class State:
    """The graph while a statement runs, and the rows bound so far."""

    compiler: Compiler
    frame: Frame
    counts: dict[str, int]
    order: str = ""  # the column that numbers the bound rows, of which later ones win

    @property
    def g(self) -> Catalog:
        return self.compiler.catalog


def run_write(session: Any, q: A.Query, params: dict[str, Any] | None) -> DataFrame:
    """Run one statement. It returns its RETURN rows, else one row of counters."""
    if len(q.parts) > 1:
        raise CypherError("a statement that writes has no UNION")
    compiler = Compiler(session.catalog.copy(), params, session.uniqueness, session.compiler().procedures)
    compiler.study(q)
    compiler.used = {k: None for k in compiler.used}
    state = State(compiler, compiler.unit(), dict.fromkeys(COUNTERS, 0))
    out = None
    for c in q.parts[0]:
        if isinstance(c, WRITES):
            write(state, c)
        elif isinstance(c, A.Projection) and c.final:
            state.frame = compiler.project(c, state.frame, [])
            out = compiler.output(state.frame)
        else:
            state.frame = read(state, c)
    check_constraints(state.g)
    if out is not None:
        out = compiler.scratch.write(out)
    session.catalog = state.g
    session.counters = state.counts
    return out if out is not None else session.spark.createDataFrame([tuple(state.counts.values())], ", ".join(f"{c} long" for c in COUNTERS))


def read(state: State, c: Any) -> Frame:
    f, k = state.frame, state.compiler
    if isinstance(c, A.Match):
        return k.optional(c, f) if c.optional else k.match(c.chains, c.where, f)
    if isinstance(c, A.Projection):
        return k.project(c, f, [])
    if isinstance(c, A.Unwind):
        return k.unwind(c, f)
    if isinstance(c, A.SubQuery):
        return k.subquery(c, f)
    return k.procedure(c, f)


def settle(state: State) -> None:
    """Write the bound rows, so that later steps neither repeat random ids nor see their own changes half done."""
    df = state.frame.df
    if not df.columns:
        df = df.select(F.lit(1).alias(state.compiler.fresh("u")))
    if state.order not in df.columns:
        state.order = state.compiler.fresh("o")
        df = df.withColumn(state.order, F.monotonically_increasing_id())
    state.frame = Frame(state.compiler.scratch.write(df), state.frame.scope)


def write(state: State, c: Any) -> None:
    settle(state)
    if isinstance(c, A.Create):
        for chain in c.chains:
            create(state, chain)
    elif isinstance(c, A.Merge):
        merge(state, c)
    elif isinstance(c, (A.SetClause, A.Remove)):
        for item in c.items:
            set_item(state, item, isinstance(c, A.Remove))
    elif isinstance(c, A.Delete):
        delete(state, c)
    else:
        outer = state.frame
        state.frame = state.compiler.unwind(A.Unwind(c.of, c.var), outer)
        for inner in c.body:
            write(state, inner)
        state.frame = outer


def new_id(g: Catalog) -> Column:
    return F.expr("uuid()") if g.id_type() == "string" else F.abs(F.xxhash64(F.expr("uuid()")))


def add_nodes(state: State, labels: tuple, df: DataFrame) -> None:
    """Append rows (id and properties) to the table of this set of labels."""
    g, key = state.g, frozenset(labels)
    for i, t in enumerate(g.nodes):
        if t.labels == key:
            g.nodes[i] = replace(t, df=state.compiler.scratch.write(union([t.df, df])))
            return
    g.nodes.append(NodeTable(key, state.compiler.scratch.write(df)))


def add_edges(state: State, type_: str, df: DataFrame) -> None:
    """Put edges (src, dst, properties) in place of those of the same ends; of several the last by ``__order`` counts."""
    g = state.g
    df = state.compiler.scratch.write(last_rows(df, ["src", "dst"], "__order"))
    same = [i for i, t in enumerate(g.edges) if t.type == type_]
    for i in same:
        if not g.edges[i].df.join(df, ["src", "dst"], "left_semi").isEmpty():
            g.edges[i] = replace(g.edges[i], df=state.compiler.scratch.write(g.edges[i].df.join(df.select("src", "dst"), ["src", "dst"], "left_anti")))
    if same and g.edges[same[-1]].src_label is None:
        t = g.edges[same[-1]]
        g.edges[same[-1]] = replace(t, df=state.compiler.scratch.write(union([t.df, df])))
    else:
        g.edges.append(EdgeTable(type_, state.compiler.scratch.write(df)))


def last_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the last by ``order``, without it."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("__one"), *rest), F.col(order)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def given(state: State, n: A.NodePat | A.RelPat) -> dict[str, Value]:
    """Properties written in a pattern; null ones aren't stored."""
    k, f = state.compiler, state.frame
    out = {name: k.ev(e, f.scope) for name, e in n.props}
    if isinstance(n, A.NodePat) and n.spread is not None:
        v = k.ev(n.spread, f.scope)
        out |= {name: V.part(v, name) for name in v.fields}
    return {name: v for name, v in out.items() if v.type != "null"}


def create(state: State, chain: A.Chain) -> None:
    if chain.path or chain.shortest:
        raise CypherError("a path can't be created")
    ends = []
    for n in chain.nodes:
        if n.var and n.var in state.frame.scope:
            if n.labels or n.props:
                raise CypherError(f"{n.var} is bound already")
            ends.append(state.frame.scope[n.var])
            continue
        ends.append(create_node(state, n))
    for r, a, b in zip(chain.rels, ends, ends[1:]):
        create_edge(state, r, a, b)


def create_node(state: State, n: A.NodePat) -> Value:
    k = state.compiler
    props = given(state, n)
    prefix = k.fresh("n")
    own = props.pop("_id", None)
    key = own.col if own is not None else new_id(state.g)
    cols = {f"{prefix}__id": key, f"{prefix}__labels": F.array(*[F.lit(x) for x in sorted(n.labels)])} | {f"{prefix}__{p}": v.col for p, v in props.items()}
    df = k.scratch.write(state.frame.df.withColumns(cols))
    kind = state.g.id_type()
    add_nodes(state, n.labels, df.select(F.col(f"{prefix}__id").cast(kind).alias("id"), *[F.col(f"{prefix}__{p}").alias(p) for p in props]))
    rows = df.count()
    state.counts["nodes_created"] += rows
    state.counts["properties_set"] += rows * len(props)
    state.counts["labels_set"] += rows * len(n.labels)
    phys = {"_id": f"{prefix}__id", "_labels": f"{prefix}__labels"} | {p: f"{prefix}__{p}" for p in props}
    fields = {p: Value(F.col(c), type_of(df.schema[c].dataType), phys={"": c}) for p, c in phys.items()}
    v = Value(fields["_id"].col, "node", fields, True, phys)
    state.frame = Frame(df, state.frame.scope | {n.var or "#" + prefix: v})
    return v


def create_edge(state: State, r: A.RelPat, a: Value, b: Value) -> None:
    k = state.compiler
    if r.many or len(r.types) != 1 or r.direction == "both":
        raise CypherError("a relationship is created with one type and a direction")
    if r.direction == "in":
        a, b = b, a
    props = given(state, r)
    prefix = k.fresh("r")
    cols = {f"{prefix}__type": F.lit(r.types[0]), f"{prefix}__src": V.part(a, "_id").col, f"{prefix}__dst": V.part(b, "_id").col} | {f"{prefix}__{p}": v.col for p, v in props.items()}
    df = k.scratch.write(state.frame.df.withColumns(cols))
    order = F.col(state.order) if state.order in df.columns else F.monotonically_increasing_id()
    edges = df.select(F.col(f"{prefix}__src").alias("src"), F.col(f"{prefix}__dst").alias("dst"), *[F.col(f"{prefix}__{p}").alias(p) for p in props], order.alias("__order")).where("src IS NOT NULL AND dst IS NOT NULL")
    add_edges(state, r.types[0], edges)
    rows = edges.select("src", "dst").distinct().count()
    state.counts["relationships_created"] += rows
    state.counts["properties_set"] += rows * len(props)
    phys = {"_type": f"{prefix}__type", "_src": f"{prefix}__src", "_dst": f"{prefix}__dst"} | {p: f"{prefix}__{p}" for p in props}
    fields = {p: Value(F.col(c), type_of(df.schema[c].dataType), phys={"": c}) for p, c in phys.items()}
    state.frame = Frame(df, state.frame.scope | {r.var or "#" + prefix: Value(fields["_src"].col, "rel", fields, True, phys)})


def merge(state: State, m: A.Merge) -> None:
    """Match the pattern for each row, else create it once per distinct set of its values."""
    c, k = m.chain, state.compiler
    if len(c.rels) > 1 or c.path:
        raise CypherError("MERGE takes one node, or one relationship between two")
    if c.rels:
        for n in c.nodes:
            if n.var not in state.frame.scope:
                merge(state, A.Merge(A.Chain((n,), ())))
                if not n.var:
                    raise CypherError("MERGE needs names for the ends of its relationship")
    before = state.frame
    names = set(before.scope)
    found = k.optional(A.Match([c], None, True), before)
    found = Frame(k.scratch.write(found.df), found.scope)
    var = c.rels[0].var if c.rels else c.nodes[0].var
    if var is None:
        var = "#" + k.fresh("m")
        c = A.Chain(c.nodes, tuple(replace(r, var=var) for r in c.rels)) if c.rels else A.Chain((replace(c.nodes[0], var=var),), ())
        found = k.optional(A.Match([c], None, True), before)
        found = Frame(k.scratch.write(found.df), found.scope)
    key = V.key_part(found.scope[var])
    hit = Frame(found.df.where(key.isNotNull()), found.scope)
    missing = Frame(found.df.where(key.isNull()).select(*before.df.columns), before.scope)
    if not missing.df.isEmpty():
        values = [v.col for n in [*c.nodes, *c.rels] for v in given(Wrapped(k, missing), n).values()]
        ends = [V.part(before.scope[n.var], "_id").col for n in c.nodes if n.var in names and c.rels]
        marks = {k.fresh("q"): x for x in [*values, *ends]}
        tagged = k.scratch.write(missing.df.withColumns(marks)) if marks else missing.df
        once = tagged.dropDuplicates(list(marks)) if marks else tagged.limit(1)
        state.frame = Frame(k.scratch.write(once), before.scope)
        create(state, c)
        for item in m.on_create:
            set_item(state, item, False)
    if not hit.df.isEmpty():
        state.frame = hit
        for item in m.on_match:
            set_item(state, item, False)
    # all rows again, now that each has a match
    state.frame = k.match([c], None, before)
    settle(state)


@dataclass
class Wrapped:
    compiler: Compiler
    frame: Frame


def set_item(state: State, item: A.SetItem, remove: bool) -> None:
    k, f = state.compiler, state.frame
    if item.target not in f.scope:
        raise CypherError(f"unknown variable {item.target}")
    v = f.scope[item.target]
    if v.type not in ("node", "rel"):
        raise CypherError(f"{item.target} has no properties")
    keys = ["_id"] if v.type == "node" else ["_type", "_src", "_dst"]
    if item.kind == "labels":
        return set_labels(state, v, item.name, remove)
    if item.kind == "prop":
        changes = {item.name: k.ev(item.value, f.scope)}
        clear = False
    else:
        source = k.ev(item.value, f.scope)
        changes = {p: V.part(source, p) for p in source.fields if not p.startswith("_")}
        clear = item.kind == "replace"
    # rows are applied in order: of those for one entity the last wins
    order = F.col(state.order) if state.order in f.df.columns else F.monotonically_increasing_id()
    rows = f.df.select(*[V.part(v, x).col.alias(f"__k{x}") for x in keys], *[x.col.alias(f"__n_{p}") for p, x in changes.items()], order.alias("__order"))
    rows = k.scratch.write(last_rows(rows.where(F.col(f"__k{keys[0]}").isNotNull()), [f"__k{x}" for x in keys], "__order"))
    state.counts["properties_set"] += rows.count() * len(changes)

    def changed(df: DataFrame, on: Column, ids: tuple, type_: str | None = None) -> DataFrame:
        new = rows if type_ is None else rows.where(F.col("__k_type") == type_)
        joined = df.join(new.withColumn("__hit", F.lit(True)), on, "left")
        cols = []
        for c in [*df.columns, *[p for p in changes if p not in df.columns]]:
            if c in ids:
                cols.append(F.col(c))
            elif c in changes:
                x = F.col(f"__n_{c}")
                old = F.col(c) if c in df.columns else F.lit(None)
                if c in df.columns and df.schema[c].dataType != new.schema[f"__n_{c}"].dataType and changes[c].type != "null":
                    t = wider({df.schema[c].dataType.simpleString(), new.schema[f"__n_{c}"].dataType.simpleString()})
                    x, old = x.cast(t), old.cast(t)
                cols.append(F.when(F.col("__hit"), x).otherwise(old).alias(c))
            else:
                cols.append(F.when(F.col("__hit"), None).otherwise(F.col(c)).alias(c) if clear else F.col(c))
        return k.scratch.write(joined.select(*cols))

    changes = {p: x for p, x in changes.items() if x.type != "null"} | {p: Value(F.lit(None).cast("string"), "null") for p, x in changes.items() if x.type == "null"}
    g = state.g
    # only tables that hold a changed entity are written anew
    if v.type == "node":
        for i, t in enumerate(g.nodes):
            if t.df.select("id").join(rows, F.col("id") == F.col("__k_id"), "left_semi").isEmpty():
                continue
            typed = {p: x for p, x in changes.items() if x.type != "null" or p in t.df.columns}
            if typed or clear:
                g.nodes[i] = replace(t, df=changed(t.df, F.col("id") == F.col("__k_id"), ("id",)))
    else:
        types = {r[0] for r in rows.select("__k_type").distinct().collect()}
        for i, t in enumerate(g.edges):
            if t.type not in types:
                continue
            g.edges[i] = replace(t, df=changed(t.df, (F.col("src") == F.col("__k_src")) & (F.col("dst") == F.col("__k_dst")), ("src", "dst"), t.type))
    refresh(state)


def refresh(state: State) -> None:
    """Bind the rows again, with the values that entities have now."""
    k, f = state.compiler, state.frame
    df, scope = f.df, dict(f.scope)
    for name, v in f.scope.items():
        if not v.flat or v.type not in ("node", "rel"):
            continue
        if v.type == "node":
            table = k.catalog.scan()
            prefix = k.fresh("n")
            new = k.node_value(prefix, table)
            table = table.select(*[F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in table.columns])
            on = v.fields["_id"].col == F.col(f"{prefix}__id")
        else:
            prefix = k.fresh("r")
            table, new = k.steps(k.catalog.edges, "out", None, prefix)
            table = table.drop("near", "far")
            on = V.entity_key(v) == V.entity_key(new)
        df = df.join(table, on, "left").drop(*physical(v))
        scope[name] = new
    state.frame = Frame(k.scratch.write(df), scope)


def set_labels(state: State, v: Value, labels: tuple, remove: bool) -> None:
    """Nodes move to the table of their new set of labels."""
    k, g = state.compiler, state.g
    ids = k.scratch.write(state.frame.df.select(V.part(v, "_id").col.alias("id")).where("id IS NOT NULL").distinct())
    moved = []
    for i, t in enumerate(list(g.nodes)):
        to = t.labels - set(labels) if remove else t.labels | set(labels)
        if to == t.labels:
            continue
        gone = k.scratch.write(t.df.join(ids, "id", "left_semi"))
        n = gone.count()
        if n:
            g.nodes[i] = replace(t, df=k.scratch.write(t.df.join(ids, "id", "left_anti")))
            moved.append((to, gone))
            state.counts["labels_set"] += n * len(t.labels ^ to)
    for to, rows in moved:
        add_nodes(state, tuple(to), rows)
    refresh(state)


def delete(state: State, d: A.Delete) -> None:
    k, f, g = state.compiler, state.frame, state.g
    for name in d.targets:  # relationships first, so that their nodes may go in the same clause
        if name not in f.scope:
            raise CypherError(f"unknown variable {name}")
    for name in sorted(d.targets, key=lambda x: f.scope[x].type != "rel"):
        v = f.scope[name]
        if v.type == "rel":
            rows = k.scratch.write(f.df.select(*[V.part(v, x).col.alias(x) for x in ("_type", "_src", "_dst")]).where("_src IS NOT NULL").distinct())
            for i, t in enumerate(g.edges):
                own = rows.where(F.col("_type") == t.type).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
                lost = t.df.join(own, ["src", "dst"], "left_semi").count()
                if lost:
                    state.counts["relationships_deleted"] += lost
                    g.edges[i] = replace(t, df=k.scratch.write(t.df.join(own, ["src", "dst"], "left_anti")))
        elif v.type == "node":
            ids = k.scratch.write(f.df.select(V.part(v, "_id").col.alias("id")).where("id IS NOT NULL").distinct())
            for i, t in enumerate(g.edges):
                from_, to = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
                out = t.df.select("src", "dst").join(from_, "src", "left_semi").count()
                into = t.df.select("src", "dst").join(from_, "src", "left_anti").join(to, "dst", "left_semi").count()
                if not out + into:
                    continue
                if not d.detach:
                    raise CypherError("a node with relationships needs DETACH DELETE")
                state.counts["relationships_deleted"] += out + into
                g.edges[i] = replace(t, df=k.scratch.write(t.df.join(from_, "src", "left_anti").join(to, "dst", "left_anti").select(*t.df.columns)))
            for i, t in enumerate(g.nodes):
                lost = t.df.select("id").join(ids, "id", "left_semi").count()
                if lost:
                    state.counts["nodes_deleted"] += lost
                    g.nodes[i] = replace(t, df=k.scratch.write(t.df.join(ids, "id", "left_anti")))
        elif v.type != "null":
            raise CypherError(f"{name} can't be deleted")


__all__ = ["is_write", "run_write", "schema"]
