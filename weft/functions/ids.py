"""Node identifiers: 32 lower-case hex digits, however they were written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain_id(c: Column | str) -> Column:
    """The plain form of a node id; null stays null, and text that isn't an id is only trimmed and lowered."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(F.trim(c))
    digits = F.regexp_replace(F.regexp_replace(low, "^urn:uuid:", ""), "[^0-9a-f]", "")
    return F.when(F.length(digits) == 32, digits).otherwise(low)


def plain_entry_key(c: Column | str) -> Column:
    """``node:<id>`` and ``edge:<type>:<src>:<dst>`` with plain ids; the type stays as written."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.split(F.trim(c), ":")
    node = F.concat(F.lit("node:"), plain_id(F.get(p, F.lit(1))))
    edge = F.concat(F.lit("edge:"), F.get(p, F.lit(1)), F.lit(":"), plain_id(F.get(p, F.lit(2))), F.lit(":"), plain_id(F.get(p, F.lit(3))))
    return (
        F.when((F.size(p) == 2) & (F.lower(F.get(p, F.lit(0))) == "node"), node)
        .when((F.size(p) == 4) & (F.lower(F.get(p, F.lit(0))) == "edge"), edge)
        .otherwise(F.trim(c))
    )
