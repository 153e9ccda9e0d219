"""Typed columns and the value rules of the pattern language, each in one place.

Types are short names: int, float, str, bool, bytes, date, datetime, null, any, node, rel, path, ``list<t>``, ``map``.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from weft.cypher.ast import CypherError


@dataclass
class Value:
    """A column with its type; maps and entities carry the types of their fields."""

    col: Column
    type: str
    fields: dict[str, "Value"] = field(default_factory=dict)
    flat: bool = False  # the fields are columns of their own, not parts of col
    phys: dict[str, str] = field(default_factory=dict)  # and these are their names


def part(v: Value, name: str) -> Value:
    """A field of an entity or map; null if there is none."""
    f = v.fields.get(name)
    if f is None:
        return null()
    return f if v.flat else Value(v.col[name], f.type, f.fields)


def whole(v: Value) -> Column:
    """An entity as one column: null if it is missing."""
    if not v.flat or v.type not in ("node", "rel"):
        return v.col
    there = v.fields["_id" if v.type == "node" else "_src"].col.isNotNull()
    return F.when(there, F.struct(*[f.col.alias(k) for k, f in v.fields.items()]))


def key_part(v: Value) -> Column:
    return part(v, "_id" if v.type == "node" else "_src").col


def item_type(t: str) -> str:
    return t[5:-1] if t.startswith("list<") else "any"


def is_number(t: str) -> bool:
    return t in ("int", "float")


def null() -> Value:
    return Value(F.lit(None), "null")


def type_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.ArrayType):
        return f"list<{type_of(t.elementType)}>"
    if isinstance(t, T.NullType):
        return "null"
    return "any"


def stored(df_type: T.DataType, c: Column) -> Column:
    """A stored property as the language sees it: all integers wide, all floats double."""
    if isinstance(df_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long")
    if isinstance(df_type, (T.FloatType, T.DecimalType)):
        return c.cast("double")
    if isinstance(df_type, T.TimestampNTZType):
        return c.cast("timestamp")
    return c


def literal(v: Any) -> Value:
    """A Python value, from a parameter or the text."""
    if v is None:
        return null()
    if isinstance(v, bool):
        return Value(F.lit(v), "bool")
    if isinstance(v, int):
        return Value(F.lit(v).cast("long"), "int")
    if isinstance(v, float):
        return Value(F.lit(v), "float")
    if isinstance(v, str):
        return Value(F.lit(v), "str")
    if isinstance(v, (bytes, bytearray)):
        return Value(F.lit(bytes(v)), "bytes")
    if isinstance(v, datetime.datetime):
        return Value(F.lit(v), "datetime")
    if isinstance(v, datetime.date):
        return Value(F.lit(v), "date")
    if isinstance(v, dict):
        return make_map({k: literal(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return make_list([literal(x) for x in (v.tolist() if hasattr(v, "tolist") else v)])
    raise CypherError(f"no value of the language is a {type(v).__name__}")


def common_type(types: list[str]) -> str:
    known = [t for t in dict.fromkeys(types) if t != "null"]
    if not known:
        return "null"
    if len(known) == 1:
        return known[0]
    if set(known) <= {"int", "float"}:
        return "float"
    if all(t.startswith("list<") for t in known):
        return f"list<{common_type([item_type(t) for t in known])}>"
    raise CypherError(f"values of the types {', '.join(known)} can't stand in one column")


SPARK = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "date": "date", "datetime": "timestamp", "bytes": "binary", "null": "void", "any": None}


def spark_type(t: str) -> str | None:
    if t.startswith("list<"):
        inner = spark_type(item_type(t))
        return f"array<{inner}>" if inner else None
    return SPARK.get(t)


def cast(v: Value, t: str) -> Column:
    """v as a column of type t, one that common_type gave."""
    s = spark_type(t)
    return v.col.cast(s) if s and s != "void" and v.type != t and not (v.type == "int" and t == "any") else v.col


def unify(values: list[Value]) -> tuple[list[Column], str]:
    t = common_type([v.type for v in values])
    return [cast(v, t) for v in values], t


def make_list(items: list[Value]) -> Value:
    if not items:
        return Value(F.array(), "list<null>")
    if items[0].type in ("node", "rel"):
        return Value(F.array(*[whole(v) for v in items]), f"list<{items[0].type}>", items[0].fields)
    cols, t = unify(items)
    return Value(F.array(*cols), f"list<{t}>", items[0].fields)


def make_map(items: dict[str, Value]) -> Value:
    keys = sorted(items)
    if not keys:
        return Value(F.struct(F.lit(None).alias("_")), "map", {}, True)
    return Value(F.struct(*[whole(items[k]).alias(k) for k in keys]), "map", dict(items), True)


def entity_key(v: Value) -> Column:
    """What makes two nodes or relationships the same."""
    if v.type == "node":
        return part(v, "_id").col
    if v.type == "rel":
        return F.struct(part(v, "_type").col, part(v, "_src").col, part(v, "_dst").col)
    return v.col


# --- comparison -----------------------------------------------------------------------------------------------------


def equal(a: Value, b: Value) -> Column:
    """``=``: null for a null operand, numbers by value, other types that differ are unequal, NaN equals nothing."""
    no_null = a.col.isNotNull() & b.col.isNotNull()
    if "null" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if is_number(a.type) and is_number(b.type):
        if a.type == b.type == "int":
            return a.col == b.col
        x, y = a.col.cast("double"), b.col.cast("double")
        return (x == y) & ~F.isnan(x) & ~F.isnan(y)
    if a.type in ("node", "rel") and a.type == b.type:
        return entity_key(a) == entity_key(b)
    if a.type.startswith("list<") and b.type.startswith("list<"):
        try:
            (x, y), _ = unify([a, b])
        except CypherError:
            return F.when(no_null, F.lit(False))
        return x == y
    if a.type != b.type and "any" not in (a.type, b.type):
        return F.when(no_null, F.lit(False))
    return a.col == b.col


def ordered(op: str, a: Value, b: Value) -> Column:
    """``< <= > >=``: null unless both are numbers or of one orderable type; null for NaN."""
    if is_number(a.type) and is_number(b.type):
        x, y = a.col, b.col
        ok = None
        if "float" in (a.type, b.type):
            x, y = x.cast("double"), y.cast("double")
            ok = ~F.isnan(x) & ~F.isnan(y)
    elif a.type == b.type and a.type in ("str", "bool", "date", "datetime"):
        x, y, ok = a.col, b.col, None
    else:
        return F.lit(None).cast("boolean")
    c = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return c if ok is None else F.when(ok, c)


def in_list(a: Value, b: Value) -> Column:
    if b.type == "null":
        return F.lit(None).cast("boolean")
    if not b.type.startswith("list<"):
        raise CypherError("IN needs a list")
    t = item_type(b.type)
    if t == "null":
        return F.when(F.size(b.col) == 0, F.lit(False)).otherwise(F.lit(None))
    if a.type == "null":
        return F.when(F.size(b.col) == 0, F.lit(False))
    try:
        common = common_type([a.type, t])
    except CypherError:
        none = F.exists(b.col, lambda x: x.isNull())
        return F.when(F.size(b.col) == 0, F.lit(False)).when(a.col.isNull() | none, F.lit(None)).otherwise(F.lit(False))
    items = b.col.cast(f"array<{spark_type(common)}>") if spark_type(common) and common != t else b.col
    return F.when(F.size(items) == 0, F.lit(False)).otherwise(F.array_contains(items, cast(a, common)))


# --- arithmetic -----------------------------------------------------------------------------------------------------


def to_string(v: Value) -> Column:
    """Whole floats lose their fraction, booleans are true and false, dates are in ISO form."""
    if v.type == "float":
        c = v.col
        s = c.cast("string")
        # the shortest digits that give the number back, without an exponent
        power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
        digits = F.concat(F.regexp_extract(s, r"^-?(\d)\.", 1), F.regexp_replace(F.regexp_extract(s, r"\.(\d+)E", 1), "0+$", ""))
        after = F.length(digits) - 1
        large = F.when(power >= after, F.concat(digits, F.repeat(F.lit("0"), power - after))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        plain = F.concat(F.when(c < 0, "-").otherwise(""), F.when(power >= 0, large).otherwise(small))
        return (
            F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c == 0, "0")
            .when(s.contains("E"), plain).otherwise(F.regexp_replace(s, r"\.0$", ""))
        )
    if v.type == "datetime":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return v.col.cast("string")


def add(a: Value, b: Value) -> Value:
    if "null" in (a.type, b.type):
        return null()
    if is_number(a.type) and is_number(b.type):
        return Value(a.col + b.col, "float" if "float" in (a.type, b.type) else "int")
    if a.type.startswith("list<") and b.type.startswith("list<"):
        cols, t = unify([a, b])
        return Value(F.concat(*cols), t, a.fields or b.fields)
    if a.type.startswith("list<"):
        cols, t = unify([a, Value(F.array(b.col), f"list<{b.type}>")])
        return Value(F.concat(*cols), t, a.fields)
    if "str" in (a.type, b.type):
        return Value(F.concat(to_string(a), to_string(b)), "str")
    raise CypherError(f"can't add {a.type} and {b.type}")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+":
        return add(a, b)
    if "null" in (a.type, b.type):
        return null()
    if not (is_number(a.type) and is_number(b.type)):
        raise CypherError(f"{op} needs numbers, not {a.type} and {b.type}")
    ints = a.type == b.type == "int"
    if op == "-":
        return Value(a.col - b.col, "int" if ints else "float")
    if op == "*":
        return Value(a.col * b.col, "int" if ints else "float")
    if op == "^":
        return Value(F.pow(a.col.cast("double"), b.col.cast("double")), "float")
    zero = F.raise_error(F.lit("division by zero"))
    if op == "/":
        if ints:  # truncates, an error on zero
            return Value(F.when(b.col == 0, zero.cast("bigint")).otherwise(F.call_function("div", a.col, F.when(b.col == 0, 1).otherwise(b.col))), "int")
        x, y = a.col.cast("double"), b.col.cast("double")
        if b.type == "int":
            return Value(F.when(b.col == 0, zero.cast("double")).otherwise(x / F.when(y == 0, 1.0).otherwise(y)), "float")
        by_zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return Value(F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(x / F.when(y == 0, 1.0).otherwise(y)), "float")
    if ints:  # remainders of integers aren't negative
        return Value(F.when(b.col == 0, zero.cast("bigint")).otherwise(F.pmod(a.col, F.abs(F.when(b.col == 0, 1).otherwise(b.col)))), "int")
    x, y = a.col.cast("double"), b.col.cast("double")
    return Value(F.when(y == 0, F.when(x.isNotNull(), float("nan"))).otherwise(x % F.when(y == 0, 1.0).otherwise(y)), "float")


def sort_keys(v: Value, down: bool) -> Column:
    """Null is the largest value."""
    c = entity_key(v)
    return c.desc_nulls_first() if down else c.asc_nulls_last()
