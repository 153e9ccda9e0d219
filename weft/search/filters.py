"""Filter maps of searches."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from weft.cypher.ast import CypherError
from weft.plans import values as V
from weft.plans.values import Value, type_of

_OPS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def apply_filter(df: DataFrame, conditions: dict[str, Any] | None) -> DataFrame:
    """Keep rows for which all keys hold: a scalar is =, a list IN, a map of eq, ne, gt, gte, lt, lte, in their AND."""
    for key, want in (conditions or {}).items():
        known = {f.name: f.dataType for f in df.schema}
        v = Value(F.col(f"`{key}`"), type_of(known[key])) if key in known else V.null()
        if not isinstance(want, dict):
            want = {"in" if isinstance(want, (list, tuple)) else "eq": want}
        if not want:
            raise CypherError(f"the filter on {key} says nothing")
        for op, x in want.items():
            other = V.literal(x)
            if op == "in":
                df = df.where(V.in_list(v, other))
            elif op == "ne":
                df = df.where(~V.equal(v, other))
            elif op == "eq":
                df = df.where(V.equal(v, other))
            elif op in _OPS:
                df = df.where(V.ordered(_OPS[op], v, other))
            else:
                raise CypherError(f"unknown filter {op}")
    return df


def settings(config: dict[str, Any], needed: set[str], also: set[str]) -> dict[str, Any]:
    if missing := needed - set(config):
        raise CypherError(f"a search needs {sorted(missing)[0]}")
    if extra := set(config) - needed - also:
        raise CypherError(f"unknown setting {sorted(extra)[0]}")
    if "filter" in config and config["filter"] is not None and not config["filter"]:
        raise CypherError("an empty filter")
    return config
