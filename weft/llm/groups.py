"""One group identifier for all records linked directly or over others: hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.functions.ids import plain_id
from weft.storage import Scratch


def current_matches(rels: DataFrame, edge_type: str = "SAME_AS") -> DataFrame:
    """src, dst of the matches that count: the row with the highest lsn of each directed pair, unless a tombstone.

    Rows with a null end and self-loops are left out. A null lsn is older than any other, a null tombstone is false,
    and of rows with the same lsn a tombstone wins.
    """
    rows = rels.where((F.col("edge_type") == edge_type) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
        plain_id("src").alias("src"), plain_id("dst").alias("dst"), F.struct("lsn", F.coalesce("tombstone", F.lit(False)).alias("gone")).alias("state")
    )
    last = rows.where("src <> dst").groupBy("src", "dst").agg(F.max("state").alias("state"))
    return last.where(~F.col("state.gone")).select("src", "dst")


def link_groups(pairs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, group for every node of the pairs (src, dst): the smallest node linked with it over any number of pairs.

    Hash-to-min: each vertex holds a set of vertices, at first itself and its neighbours. In a round it sends its set
    to the smallest member and the smallest member to all others; a vertex's new set is what it receives. When nothing
    changes, each vertex holds the smallest vertex of its component. A set is a relation of (vertex, member) rows and
    is never gathered, so a component that holds a third of all vertices costs rows, not one task's memory; the
    smallest member is found with partial aggregation. Rounds grow with the logarithm of the longest chain. Rows are
    read whole: null ends and self-loops add nothing, repeated pairs count once, an empty table gives no rows.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    links = pairs.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    both = links.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")), F.struct(F.col("src").alias("v"), F.col("src").alias("u")), F.struct(F.col("dst").alias("v"), F.col("dst").alias("u")))).alias("e"))
    sets = scratch.write(both.select("e.v", "e.u").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first())

    seen = mark(sets)
    for _ in range(max_rounds):
        least = sets.groupBy("v").agg(F.min("u").alias("m"))
        sent = sets.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        new = scratch.write(sent.select("e.v", "e.u").distinct())
        now = mark(new)
        scratch.drop(sets)
        sets = new
        if now == seen:
            return sets.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("group"))
        seen = now
    raise RuntimeError(f"groups still change after {max_rounds} rounds")
