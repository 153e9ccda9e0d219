"""Scalar functions of the pattern language as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from weft.cypher.ast import CypherError
from weft.plans.values import Value, arithmetic, cast, is_number, item_type, null, to_string, unify

_SPACE = r"[\p{IsWhite_Space}]+"


def _strings(fn: Callable[..., Column]) -> Callable[..., Value]:
    def run(*args: Value) -> Value:
        if any(a.type == "null" for a in args):
            return null()
        if args[0].type not in ("str", "any"):
            raise CypherError("a string function needs a string")
        return Value(fn(*[a.col for a in args]), "str")

    return run


def _floats(fn: Callable[[Column], Column]) -> Callable[[Value], Value]:
    def run(a: Value) -> Value:
        if a.type == "null":
            return null()
        if not is_number(a.type):
            raise CypherError("a number function needs a number")
        return Value(fn(a.col.cast("double")).cast("double"), "float")

    return run


def size(v: Value) -> Value:
    if v.type == "null":
        return null()
    if v.type == "str":
        return Value(F.length(v.col).cast("long"), "int")
    if v.type.startswith("list<"):
        return Value(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), "int")
    if v.type == "path":
        return Value(F.when(v.col.isNotNull(), F.size(v.col["rels"])).cast("long"), "int")
    if v.type == "map":
        return Value(F.lit(len(v.fields)).cast("long"), "int")
    raise CypherError(f"size() of {v.type}")


def get(v: Value, at: Value) -> Value:
    """An item by position, negative from the end, null outside; of a map by key."""
    if v.type == "null" or at.type == "null":
        return null()
    if v.type.startswith("list<"):
        n = F.size(v.col)
        where = F.when(at.col < 0, at.col + n).otherwise(at.col)
        return Value(F.when((where >= 0) & (where < n), F.get(v.col, where.cast("int"))), item_type(v.type), v.fields)
    raise CypherError(f"an index into {v.type}")


def slice_(v: Value, low: Value | None, high: Value | None) -> Value:
    if v.type == "null" or any(x is not None and x.type == "null" for x in (low, high)):
        return null()
    n = F.size(v.col).cast("long")

    def place(x: Value | None, default: Column) -> Column:
        if x is None:
            return default
        c = F.when(x.col < 0, x.col + n).otherwise(x.col)
        return F.least(F.greatest(c, F.lit(0)), n)

    a, b = place(low, F.lit(0).cast("long")), place(high, n)
    return Value(F.slice(v.col, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), v.type, v.fields)


def _head(v: Value) -> Value:
    return null() if v.type == "null" else Value(F.get(v.col, F.lit(0)), item_type(v.type), v.fields)


def _last(v: Value) -> Value:
    return null() if v.type == "null" else Value(F.try_element_at(v.col, F.lit(-1)), item_type(v.type), v.fields)


def _tail(v: Value) -> Value:
    return null() if v.type == "null" else Value(F.slice(v.col, F.lit(2), F.greatest(F.size(v.col) - 1, F.lit(0))), v.type, v.fields)


def _reverse(v: Value) -> Value:
    return null() if v.type == "null" else Value(F.reverse(v.col), v.type, v.fields)


def _coalesce(*args: Value) -> Value:
    cols, t = unify(list(args))
    return Value(F.coalesce(*cols), t, next((a.fields for a in args if a.fields), {}))


def _range(a: Value, b: Value, step: Value | None = None) -> Value:
    s = step.col if step else F.lit(1).cast("long")
    empty = F.array().cast("array<bigint>")
    fine = F.when(s > 0, a.col <= b.col).otherwise(a.col >= b.col)
    checked = F.when(s == 0, F.raise_error(F.lit("range() with step 0")).cast("array<bigint>")).when(fine, F.sequence(a.col, F.when(fine, b.col).otherwise(a.col), F.when(fine, s).otherwise(F.lit(1)))).otherwise(empty)
    return Value(F.when(a.col.isNotNull() & b.col.isNotNull() & s.isNotNull(), checked), "list<int>")


def _abs(v: Value) -> Value:
    return null() if v.type == "null" else Value(F.abs(v.col), v.type)


def _sign(v: Value) -> Value:
    return null() if v.type == "null" else Value(F.signum(v.col).cast("long"), "int")


def _to_string(v: Value) -> Value:
    return null() if v.type == "null" else Value(to_string(v), "str")


def _to_integer(v: Value) -> Value:
    if v.type == "str":
        return Value(F.when(F.trim(v.col).rlike(r"\A[+-]?\d+\z"), F.trim(v.col).try_cast("bigint")), "int")
    if v.type == "float":
        inside = F.least(F.greatest(v.col, F.lit(-9.2e18)), F.lit(9.2e18))
        return Value(F.when(F.isnan(v.col), F.lit(0)).when(v.col >= 9.223372036854775e18, F.lit(2**63 - 1)).when(v.col <= -9.223372036854775e18, F.lit(-(2**63))).otherwise(inside.cast("bigint")), "int")
    if v.type == "bool":
        return Value(v.col.cast("bigint"), "int")
    return v if v.type == "int" else null()


def _to_float(v: Value) -> Value:
    if v.type == "str":
        return Value(F.trim(v.col).try_cast("double"), "float")
    return Value(v.col.cast("double"), "float") if is_number(v.type) else null()


def _to_boolean(v: Value) -> Value:
    if v.type == "str":
        low = F.lower(F.trim(v.col))
        return Value(F.when(low == "true", True).when(low == "false", False), "bool")
    if v.type == "int":
        return Value(F.when(v.col == 1, True).when(v.col == 0, False), "bool")
    return v if v.type == "bool" else null()


def _split(v: Value, by: Value) -> Value:
    if "null" in (v.type, by.type):
        return null()
    quoted = F.concat(F.lit(r"\Q"), F.replace(by.col, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    chars = F.filter(F.split(v.col, ""), lambda c: c != "")
    return Value(F.when(by.col == "", chars).otherwise(F.split(v.col, quoted)), "list<str>")


def _cut(side: str) -> Callable[[Value, Value], Value]:
    def run(v: Value, n: Value) -> Value:
        if "null" in (v.type, n.type):
            return null()
        checked = F.when(n.col < 0, F.raise_error(F.lit(f"{side}() of a negative length")).cast("int")).otherwise(n.col.cast("int"))
        c = F.substring(v.col, F.lit(1), checked) if side == "left" else F.when(n.col == 0, "").otherwise(F.right(v.col, checked))
        return Value(c, "str")

    return run


def _substring(v: Value, start: Value, n: Value | None = None) -> Value:
    if v.type == "null" or start.type == "null":
        return null()
    low = (start.col + 1).cast("int")
    return Value(F.substring(v.col, low, n.col.cast("int") if n else F.lit(2**31 - 1)), "str")


def vector(v: Value) -> Column:
    if not v.type.startswith("list<"):
        raise CypherError("a vector function needs lists of numbers")
    return v.col.cast("array<float>").cast("array<double>")


def _pairwise(fn: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    def run(a: Value, b: Value) -> Value:
        if "null" in (a.type, b.type):
            return null()
        x, y = vector(a), vector(b)
        same = F.size(x) == F.size(y)
        bad = F.raise_error(F.lit("vectors of different dimension")).cast("double")
        return Value(F.when(x.isNull() | y.isNull(), F.lit(None)).when(~same, bad).otherwise(fn(x, y)), "float")

    return run


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Null where a vector has no length."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / F.when(norms > 0, norms).otherwise(1.0))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def _as_vector(v: Value) -> Value:
    if v.type == "null":
        return null()
    bad = F.raise_error(F.lit("a vector has no null elements")).cast("array<float>")
    return Value(F.when(F.exists(v.col, lambda x: x.isNull()), bad).otherwise(v.col.cast("array<float>")), "list<float>")


def _bm25(doc: Value, query: Value) -> Value:
    """Without a corpus: every query term has idf 1 and a document has 120 terms on average (fixed values)."""
    def terms(c: Column) -> Column:
        return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")

    d, q = terms(doc.col), F.array_distinct(terms(query.col))
    norm = 1.5 * (1 - 0.75 + 0.75 * F.size(d) / 120.0)

    def score(t: Column) -> Column:
        tf = F.size(F.filter(d, lambda x: x == t))
        return F.when(tf > 0, tf * 2.5 / (tf + norm)).otherwise(0.0)

    return Value(F.aggregate(F.transform(q, score), F.lit(0.0), lambda s, v: s + v), "float")


def _date(v: Value | None = None) -> Value:
    return Value(F.current_date() if v is None else F.to_date(v.col, "yyyy-MM-dd"), "date")


def _datetime(v: Value | None = None) -> Value:
    if v is None:
        return Value(F.current_timestamp(), "datetime")
    iso = F.regexp_replace(v.col, " ", "T")
    return Value(iso.try_cast("timestamp"), "datetime")


def _keys(v: Value) -> Value:
    if v.type in ("node", "rel"):
        stored = {k: x for k, x in v.fields.items() if not k.startswith("_")}
        names = [F.when(stored[k].col.isNotNull(), F.lit(k)) for k in sorted(stored)]
        return Value(F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"), "list<str>")
    if v.type == "map":
        return Value(F.array(*[F.lit(k) for k in sorted(v.fields)]), "list<str>")
    return null()


def _round(c: Column) -> Column:
    return F.when(c >= 0, F.floor(c + 0.5)).otherwise(-F.floor(-c + 0.5)).cast("double")  # halves away from zero


SCALARS: dict[str, Callable[..., Value]] = {
    "size": size, "length": size, "head": _head, "last": _last, "tail": _tail, "reverse": _reverse, "coalesce": _coalesce, "range": _range,
    "tolower": _strings(F.lower), "toupper": _strings(F.upper), "lower": _strings(F.lower), "upper": _strings(F.upper),
    "trim": _strings(lambda c: F.regexp_replace(c, rf"\A{_SPACE}|{_SPACE}\z", "")),
    "ltrim": _strings(lambda c: F.regexp_replace(c, rf"\A{_SPACE}", "")), "rtrim": _strings(lambda c: F.regexp_replace(c, rf"{_SPACE}\z", "")),
    "replace": _strings(lambda s, a, b: F.replace(s, a, b)), "split": _split, "left": _cut("left"), "right": _cut("right"), "substring": _substring,
    "tostring": _to_string, "tointeger": _to_integer, "tofloat": _to_float, "toboolean": _to_boolean,
    "abs": _abs, "sign": _sign, "round": _floats(_round), "floor": _floats(F.floor), "ceil": _floats(F.ceil),
    "sqrt": _floats(lambda c: F.when(c < 0, F.lit(math.nan)).otherwise(F.sqrt(c))),
    "vector": _as_vector, "cosine_similarity": _pairwise(cosine), "dot_product": _pairwise(dot), "euclidean_distance": _pairwise(euclidean), "bm25": _bm25,
    "timestamp": lambda: Value(F.unix_millis(F.current_timestamp()), "int"), "date": _date, "datetime": _datetime, "localdatetime": _datetime, "keys": _keys,
}

__all__ = ["SCALARS", "arithmetic", "cast", "get", "size", "slice_"]
