"""Results per key where a few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_NULL, _SEP = "\u0000", "\u0001"


def _code(keys: list[str]) -> Column:
    return F.concat_ws(_SEP, *[F.coalesce(F.col(k).cast("string"), F.lit(_NULL)) for k in keys])


def heavy_keys(df: DataFrame, keys: list[str], share: float, tracked: int | None = None) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with their exact ``n_rows`` and ``row_share``.

    A frequent-items sketch of every task names the candidates: with ``tracked`` counters no key above the share can be
    missed, since the sketch is off by less than 4/tracked of the rows and the counters default to 40/share. At most
    2/share candidates remain, few enough to be broadcast whatever the input; their exact counts then decide. Null is a
    key value of its own. An empty table has no heavy key.
    """
    tracked = tracked or max(1024, 1 << (int(40 / share) - 1).bit_length())
    wanted = min(tracked, int(2 / share) + 1)
    coded = df.select(*keys, _code(keys).alias("__code"))
    sketch = coded.agg(F.count(F.lit(1)).alias("__n"), F.call_function("approx_top_k", F.col("__code"), F.lit(wanted), F.lit(tracked)).alias("__top"))
    top = sketch.select("__n", F.explode("__top").alias("__t")).select("__n", F.col("__t.item").alias("__code"))
    counted = coded.join(F.broadcast(top), "__code").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.first("__n").alias("__n"))
    # the allowance is for rounding: a key of exactly the share counts
    return counted.where(F.col("n_rows") >= share * F.col("__n") - 1e-9).select(*keys, "n_rows", (F.col("n_rows") / F.col("__n")).alias("row_share"))


def per_key(df: DataFrame, keys: list[str], distinct: list[str], share: float = 0.005, salts: int = 64, extra: dict[str, Column] | None = None) -> DataFrame:
    """``n_rows``, ``n_<column>`` distinct non-null values and the extra decomposable sums per key, and whether it is heavy.

    Rows of heavy keys meet their key list by a broadcast join (its size is bound by 1/share) and are reduced in two
    steps over ``salts`` pieces of the counted value, so no task holds a whole heavy key. All other rows go through an
    ordinary shuffle by key. ``extra`` maps a name to a column to be summed. Nulls in keys form a key of their own;
    an empty table gives no row.
    """
    extra = extra or {}
    hot = F.broadcast(heavy_keys(df, keys, share).select(_code(keys).alias("__code")))
    rows = df.select(*keys, *distinct, *[c.alias(n) for n, c in extra.items()]).withColumn("__code", _code(keys))
    heavy, rest = rows.join(hot, "__code"), rows.join(hot, "__code", "left_anti")
    sums = [F.sum(n).alias(n) for n in extra]

    plain = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct], *sums)
    counts = heavy.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    parts = [counts]
    for c in distinct:
        # a value lies in one piece only, so the pieces' counts add up
        pieces = heavy.groupBy(*keys, F.pmod(F.xxhash64(c), F.lit(salts)).alias("__piece"), c).agg(F.lit(1).alias("__one"))
        inner = pieces.groupBy(*keys, "__piece").agg(F.count(c).alias("__n"))
        parts.append(inner.groupBy(*keys).agg(F.sum("__n").alias(f"n_{c}")))

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
        return a.join(b, on).drop(*[f"__r_{k}" for k in keys])

    columns = [*keys, "n_rows", *[f"n_{c}" for c in distinct], *extra]
    heavy_result = reduce(join, parts).select(*columns, F.lit(True).alias("is_heavy"))
    return plain.select(*columns, F.lit(False).alias("is_heavy")).unionByName(heavy_result)
