"""Expressions of the pattern language as typed columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F

from weft.cypher import ast as A
from weft.cypher.ast import CypherError
from weft.functions.scalars import SCALARS, get, slice_
from weft.plans import values as V
from weft.plans.values import Value, null, part

Scope = dict[str, Value]


class Expressions:
    def __init__(self, params: dict[str, Any] | None = None):
        self.params = params or {}

    def param(self, name: str) -> Any:
        if name not in self.params:
            raise CypherError(f"no parameter ${name}")
        return self.params[name]

    def number(self, e: Any) -> int:
        v = self.param(e.name) if isinstance(e, A.Param) else e.value
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherError("a bound is an integer that isn't negative")
        return v

    def bool(self, e: Any, scope: Scope) -> Column:
        v = self(e, scope)
        if v.type == "null":
            return F.lit(None).cast("boolean")
        if v.type != "bool":
            raise CypherError(f"a condition is true or false, not {v.type}")
        return v.col

    def __call__(self, e: Any, scope: Scope) -> Value:
        if isinstance(e, A.Lit):
            return V.literal(e.value)
        if isinstance(e, A.Param):
            return V.literal(self.param(e.name))
        if isinstance(e, A.Var):
            if e.name not in scope:
                raise CypherError(f"unknown variable {e.name}")
            return scope[e.name]
        if isinstance(e, A.Prop):
            v = self(e.of, scope)
            return part(v, e.name) if v.type in ("node", "rel", "map") else null()
        if isinstance(e, A.Index):
            v, at = self(e.of, scope), self(e.at, scope)
            if v.type in ("map", "node", "rel") and isinstance(e.at, (A.Lit, A.Param)):
                return part(v, e.at.value if isinstance(e.at, A.Lit) else self.param(e.at.name))
            out = get(v, at)
            return out
        if isinstance(e, A.Slice):
            return slice_(self(e.of, scope), None if e.low is None else self(e.low, scope), None if e.high is None else self(e.high, scope))
        if isinstance(e, A.Unary):
            if e.op == "NOT":
                return Value(~self.bool(e.arg, scope), "bool")
            v = self(e.arg, scope)
            if v.type != "null" and not V.is_number(v.type):
                raise CypherError(f"- of {v.type}")
            return Value(-v.col, v.type) if v.type != "null" else null()
        if isinstance(e, A.Binary):
            return self.binary(e, scope)
        if isinstance(e, A.IsNull):
            v = self(e.arg, scope)
            c = V.key_part(v) if v.type in ("node", "rel") else v.col
            return Value(c.isNotNull() if e.negated else c.isNull(), "bool")
        if isinstance(e, A.HasLabels):
            v = self(e.arg, scope)
            own = part(v, "_labels").col
            tests = [F.array_contains(own, x) for x in e.labels]
            c = tests[0]
            for t in tests[1:]:
                c = c | t if e.any_of else c & t
            return Value(c, "bool")
        if isinstance(e, A.ListLit):
            return V.make_list([self(x, scope) for x in e.items])
        if isinstance(e, A.MapLit):
            return V.make_map({k: self(x, scope) for k, x in e.items})
        if isinstance(e, A.Case):
            return self.case(e, scope)
        if isinstance(e, A.Comprehension):
            return self.comprehension(e, scope)
        if isinstance(e, A.Quantifier):
            return self.quantifier(e, scope)
        if isinstance(e, A.Call):
            return self.call(e, scope)
        if isinstance(e, (A.Exists, A.PatternComp)):
            raise CypherError("a pattern can't stand here")
        raise CypherError(f"no expression: {e}")

    def binary(self, e: A.Binary, scope: Scope) -> Value:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.bool(e.left, scope), self.bool(e.right, scope)
            return Value(a & b if op == "AND" else a | b if op == "OR" else a != b, "bool")
        a, b = self(e.left, scope), self(e.right, scope)
        if op == "=":
            return Value(V.equal(a, b), "bool")
        if op == "<>":
            return Value(~V.equal(a, b), "bool")
        if op in ("<", "<=", ">", ">="):
            return Value(V.ordered(op, a, b), "bool")
        if op == "IN":
            return Value(V.in_list(a, b), "bool")
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            if a.type != "str" or b.type != "str":
                return Value(F.lit(None).cast("boolean"), "bool")
            if op == "=~":
                return Value(F.rlike(a.col, F.concat(F.lit(r"\A(?:"), b.col, F.lit(r")\z"))), "bool")
            return Value({"STARTS WITH": a.col.startswith, "ENDS WITH": a.col.endswith, "CONTAINS": a.col.contains}[op](b.col), "bool")
        return V.arithmetic(op, a, b)

    def case(self, e: A.Case, scope: Scope) -> Value:
        subject = None if e.subject is None else self(e.subject, scope)
        outs = [self(x, scope) for _, x in e.whens] + [null() if e.default is None else self(e.default, scope)]
        cols, t = V.unify(outs)
        c = None
        for (when, _), out in zip(e.whens, cols):
            test = self.bool(when, scope) if subject is None else V.equal(subject, self(when, scope))
            c = F.when(test, out) if c is None else c.when(test, out)
        return Value(c.otherwise(cols[-1]), t, next((o.fields for o in outs if o.fields), {}))

    def _item(self, of: Value, x: Column) -> Value:
        return Value(x, V.item_type(of.type), of.fields)

    def comprehension(self, e: A.Comprehension, scope: Scope) -> Value:
        of = self(e.of, scope)
        if of.type == "null":
            return null()
        if not of.type.startswith("list<"):
            raise CypherError("a comprehension runs over a list")
        c = of.col
        if e.where is not None:
            c = F.filter(c, lambda x: F.coalesce(self.bool(e.where, scope | {e.var: self._item(of, x)}), F.lit(False)))
        if e.out is None:
            return Value(c, of.type, of.fields)
        kind: list[Value] = []

        def out(x: Column) -> Column:
            v = self(e.out, scope | {e.var: self._item(of, x)})
            kind.append(v)
            return V.whole(v)

        c = F.transform(c, out)
        return Value(c, f"list<{kind[0].type}>", kind[0].fields)

    def quantifier(self, e: A.Quantifier, scope: Scope) -> Value:
        of = self(e.of, scope)
        if of.type == "null":
            return null()
        test = lambda x: self.bool(e.where, scope | {e.var: self._item(of, x)})
        if e.kind == "all":
            return Value(F.forall(of.col, test), "bool")
        if e.kind == "single":
            return Value(F.when(of.col.isNotNull(), F.size(F.filter(of.col, lambda x: F.coalesce(test(x), F.lit(False)))) == 1), "bool")
        c = F.exists(of.col, test)
        return Value(~c if e.kind == "none" else c, "bool")

    def call(self, e: A.Call, scope: Scope) -> Value:
        args = [self(x, scope) for x in e.args]
        first = args[0] if args else None
        if e.name in ("id", "elementid"):
            if first.type == "node":
                return part(first, "_id")
            src, dst, kind = (part(first, k).col.cast("string") for k in ("_src", "_dst", "_type"))
            return Value(F.concat(src, F.lit(":"), dst) if e.name == "id" else F.concat(kind, F.lit("-"), src, F.lit("->"), dst), "str")
        if e.name == "labels":
            return part(first, "_labels")
        if e.name == "type":
            return part(first, "_type")
        if e.name in ("startnode", "endnode"):
            key = part(first, "_src" if e.name == "startnode" else "_dst")
            return Value(F.struct(key.col.alias("_id")), "node", {"_id": key})
        if e.name == "properties":
            if first.type == "map":
                return first
            return V.make_map({k: part(first, k) for k in first.fields if not k.startswith("_")})
        if e.name in ("nodes", "relationships"):
            if first.type == "null":
                return null()
            of = "nodes" if e.name == "nodes" else "rels"
            return Value(first.col[of], f"list<{of[:-1]}>", first.fields[of].fields)
        if e.name == "exists":
            return Value(first.col.isNotNull(), "bool")
        if e.name in SCALARS:
            try:
                return SCALARS[e.name](*args)
            except TypeError as x:
                raise CypherError(f"{e.name}() doesn't take {len(args)} arguments") from x
        raise CypherError(f"{e.name}() is not supported")


def rewrite(x: Any, change: Any) -> Any:
    """A copy of a syntax tree; ``change`` gives a replacement or None for each node."""
    if isinstance(x, tuple):
        return tuple(rewrite(y, change) for y in x)
    if isinstance(x, list):
        return [rewrite(y, change) for y in x]
    if not hasattr(x, "__dataclass_fields__"):
        return x
    new = change(x)
    if new is not None:
        return new
    return type(x)(**{f: rewrite(getattr(x, f), change) for f in x.__dataclass_fields__})
