import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import distinct as D, queries as Q


@pytest.mark.parametrize("n", [1, 2, 5, 37, 1000, 60_000])
def test_error(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), F.concat(F.lit("v"), F.col("id")).alias("value"))
    df = df.unionByName(df.limit(500))  # repeated values change nothing
    r = D.count_distinct(df, ["g"], "value").first()
    assert abs(r.estimate - n) <= max(0.4, 4 * D.standard_error() * n)
    assert r.low <= r.estimate <= r.high


def test_many_sets_stay_within_the_stated_error(spark):
    df = spark.range(200_000).select((F.col("id") % 100).alias("g"), F.col("id").alias("value"))
    p = 8
    off = np.array([r.estimate / 2000 - 1 for r in D.count_distinct(df, ["g"], "value", precision=p).collect()])
    assert len(off) == 100 and abs(off.mean()) < 0.01
    assert 0.7 * D.standard_error(p) < off.std() < 1.3 * D.standard_error(p)


def test_merging_loses_nothing(spark, rows):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 900).alias("value"))
    whole = D.merge(D.observe(df.repartition(1), ["b"], "value"), ["b"])
    merged = D.merge(D.observe(df.repartition(5), ["a", "b"], "value"), ["b"])
    sets = D.merge(D.observe(df.repartition(5), ["a", "b"], "value", [["a"], ["b"]]), ["level", "a", "b"])
    assert rows(whole) == rows(merged) == rows(sets.where("level = 1").select("b", "sketch"))


def test_registers_are_bytes():
    # ranks 5, 4 and 2 were met: greatest 5, the rank below met, the next not
    assert D.states(np.array([0b11010], np.uint64)).tolist() == [5 * 4 + 0b10]
    some = np.array([1, 2, 3, 5, 6, 7, 1 << 52, 3 << 50], np.uint64)
    assert (D.ranks(D.states(some)) == some).all()  # nothing lies below the indicated ranks
    long = np.array([(1 << 52) | 1], np.uint64)
    assert D.ranks(D.states(long)).tolist() == [1 << 52]
    reg, state = np.arange(4096), np.full(4096, 9, np.uint8)
    assert len(D.encode(reg, state)) == 4096 and len(D.encode(reg[:10], state[:10])) == 30
    for k in (10, 4096):
        back = D.decode(D.encode(reg[:k], state[:k]))
        assert (back[0] == reg[:k]).all() and (back[1] == 9).all()


def test_a_task_that_meets_very_many_groups_gives_parts(spark, rows, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 50).alias("g"), F.col("id").alias("value"))
    want = rows(D.count_distinct(df, ["g"], "value"))
    monkeypatch.setattr(D, "GROUPS", 7)
    assert rows(D.count_distinct(df, ["g"], "value")) == want


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), ("h", None)], "g string, value string").withColumn("sketch", F.lit("q")).withColumn("level", F.lit(1))
    got = {r.g: r.estimate for r in D.count_distinct(df, ["g"], "value").collect()}
    assert got == {None: 1}
    assert D.count_distinct(df.limit(0), ["g"], "value").count() == 0


def test_every_combination_is_counted(spark, tmp_path):
    data = [(s, e, f"{s}{e}{i % (s + 3)}".zfill(32), f"{i}".zfill(32), f"2024-01-0{d}") for s in (1, 2) for e in "AB" for d in (1, 2) for i in range(9)]
    df = spark.createDataFrame(data, "sst_id long, edge_type string, src string, dst string, at string").selectExpr("*", "timestamp(at) AS arrived_at")
    df.write.parquet(f"{tmp_path}/rels.parquet")
    keys = ["sst_id", "day", "edge_type"]
    got = {(r.sst_id, str(r.day), r.edge_type, r.prop_name): r.estimate for r in Q.p5_distinct(spark, str(tmp_path)).dropna(subset=keys).collect()}
    want = {}
    for s, e, src, dst, day in data:
        for p, v in (("src", src), ("dst", dst)):
            want.setdefault((s, day, e, p), set()).add(v)
    assert got == {k: len(v) for k, v in want.items()} and len(got) == 16
