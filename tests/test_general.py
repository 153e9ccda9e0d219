"""Change log, heavy keys and schema drift on small and awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions.ids import plain_entry_key, plain_id
from weft.operators.changelog import ChangeLog, merge_sorted, replay
from weft.operators.heavy_keys import heavy_keys, per_key
from weft.operators.schema_drift import DriftReport, promote

A, B = "43017c1d1f02bb2d00b98fc307eb127d", "50018cbae081e5ebdcc6df2d5f399690"
WAL = "segment_seq long, entry_key string, op string, lsn long, payload string, arrived_at timestamp"


def test_ids_in_all_forms(spark, rows):
    forms = [A, A.upper(), "{43017C1D-1F02-BB2D-00B9-8FC307EB127D}", " 43017c1d-1f02-bb2d-00b9-8fc307eb127d ", "urn:uuid:43017c1d-1f02-bb2d-00b9-8fc307eb127d"]
    df = spark.createDataFrame([(f,) for f in forms], "x string").select(plain_id("x"))
    assert {r[0] for r in df.collect()} == {A}
    df = spark.createDataFrame([(None,), ("Odd",)], "x string").select(plain_id("x"))
    assert [r[0] for r in df.collect()] == [None, "odd"]
    keys = [f"node:{A.upper()}", "edge:KNOWS:{43017C1D-1F02-BB2D-00B9-8FC307EB127D}:" + B]
    df = spark.createDataFrame([(k,) for k in keys], "x string").select(plain_entry_key("x"))
    assert [r[0] for r in df.collect()] == [f"node:{A}", f"edge:KNOWS:{A}:{B}"]


def entries(spark, data):
    return spark.createDataFrame([(i // 3, *d, None, None) for i, d in enumerate(data)], WAL)


def test_replay_equals_a_dictionary_in_any_order(spark):
    rng = random.Random(3)
    data = [(f"node:{k:032x}", rng.choice(["Upsert", " upsert", "TOMBSTONE", "Tombstone "]), lsn) for lsn, k in enumerate(rng.choices(range(20), k=200))]
    last = {k: (op, lsn) for k, op, lsn in data}
    want = {(k, lsn) for k, (op, lsn) in last.items() if op.strip().lower() == "upsert"}
    shuffled = data + rng.sample(data, 50)
    rng.shuffle(shuffled)
    log = replay(entries(spark, shuffled), runs=5)
    assert {(r.key, r.seq) for r in log.state().collect()} == want
    log.compact()
    assert sum(map(len, log.levels)) == 1
    assert {(r.key, r.seq) for r in log.state().collect()} == want


def test_replay_of_torn_tied_and_null_entries(spark):
    k = f"node:{A}"
    data = [(None, "Upsert", 1), (k, "Upsert", None), (k, "Upsert", 5), (k, "Tombstone", 5), ("node:" + B, None, 3), ("node:" + B, "Upsert", 2)]
    log = replay(entries(spark, data))
    assert log.state().count() == 0
    assert log.merged().count() == 2


def test_empty_feed_and_log(spark):
    assert replay(spark.createDataFrame([], WAL)).state().count() == 0
    with pytest.raises(ValueError):
        ChangeLog(spark, []).merged()


def test_late_change_does_not_revive(spark):
    log = ChangeLog(spark, [], fanout=2)
    for seq, op in ((9, "Tombstone"), (4, "Upsert"), (7, "Upsert")):
        log.append(spark.createDataFrame([("a", op, seq, "x")], "key string, op string, seq long, extra string"))
    assert log.state().count() == 0


def test_k_way_merge_of_sorted_runs():
    import pyarrow as pa

    rng = random.Random(5)
    changes = [(f"k{rng.randrange(60)}é", seq) for seq in range(500)]
    runs = []
    for _ in range(7):
        last = {}
        for k, seq in rng.sample(changes, 200):
            last[k] = max(seq, last.get(k, -1))
        runs.append(sorted(last.items(), key=lambda r: r[0].encode()))
    runs += [[], [("a", None)]]

    def batches(run, size=9):
        for a in range(0, len(run), size):
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in run[a : a + size]], pa.string()), "seq": pa.array([s for _, s in run[a : a + size]], pa.int64())})

    got = [tuple(r.values()) for t in merge_sorted([batches(r) for r in runs], ["seq"]) for r in t.to_pylist()]
    want = {"a": None}
    for run in runs[:-1]:
        for k, seq in run:
            want[k] = max(seq, want.get(k, -1))
    assert got == sorted(want.items(), key=lambda r: r[0].encode())


def test_a_log_is_opened_again_from_its_manifest_and_purges_below_the_low_water_mark(spark):
    one = "key string, op string, seq long"
    log = ChangeLog(spark, [], fanout=3, buckets=2)
    log.append(spark.createDataFrame([("a", "Upsert", 1), ("b", "Upsert", 2), ("c", "Tombstone", 3)], one))
    log.append(spark.createDataFrame([("a", "Tombstone", 4), ("d", "Upsert", 8)], one))
    again = ChangeLog(spark, [], fanout=3, root=log.scratch)
    assert again.buckets == 2 and {r.key for r in again.state().collect()} == {"b", "d"}
    again.compact(low_water=5)
    assert {r.key for r in again.merged().collect()} == {"b", "d"}
    again.append(spark.createDataFrame([("a", "Upsert", 2), ("c", "Upsert", 6)], one))
    assert {r.key for r in ChangeLog(spark, [], root=log.scratch).state().collect()} == {"b", "c", "d"}


def test_heavy_keys_and_results_per_key(spark, rows):
    data = [("K", "hot", i % 7) for i in range(400)] + [("K", None, 1)] * 100 + [("L", f"s{i}", i) for i in range(300)]
    df = spark.createDataFrame(data, "edge_type string, src string, dst long").withColumn("n_rows", F.lit(9)).withColumn("v", F.lit(2))
    hot = heavy_keys(df, ["edge_type", "src"], 0.1)
    assert rows(hot.select("edge_type", "src", hot.n_rows)) == [("K", None, 100), ("K", "hot", 400)]
    out = per_key(df, ["edge_type", "src"], ["dst"], share=0.1, extra={"total": F.col("v")})
    got = {(r.edge_type, r.src): (r.n_rows, r.n_dst, r.total, r.is_heavy) for r in out.collect()}
    assert got["K", "hot"] == (400, 7, 800, True)
    assert got["K", None] == (100, 1, 200, True)
    assert got["L", "s5"] == (1, 1, 2, False) and len(got) == 302


def test_heavy_keys_of_nothing(spark):
    df = spark.createDataFrame([], "edge_type string, src string, dst long")
    assert heavy_keys(df, ["edge_type", "src"], 0.01).count() == 0
    assert per_key(df, ["edge_type", "src"], ["dst"]).count() == 0


def test_distinct_of_null_values(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("a", None)], "k string, v long")
    assert per_key(df, ["k"], ["v"]).first()[:3] == ("a", 3, 1)


DRIFT = "ns string, version long, node_id string, file string, lsn long, json string"


def drift(spark, data):
    return DriftReport(spark.createDataFrame(data, DRIFT))


def changes(report):
    return sorted((r.ns, r.schema_version, r.field_name, r.change_kind) for r in report.changes().collect())


def test_drift_kinds(spark):
    data = []
    for i in range(20):
        data.append(("n", 1, f"x{i}", "f1", i, f'{{"a": {i}, "b": "t{i}", "gone": 1, "t": "{i}"}}'))
        data.append(("n", 3, f"x{i}", "f2", 50 + i, f'{{"a": {i}.5, "c": "t{i}", "fresh": true, "t": {i}}}'))
    report = drift(spark, data)
    assert changes(report) == [("n", 3, "a", "retyped"), ("n", 3, "c", "renamed"), ("n", 3, "fresh", "added"), ("n", 3, "gone", "removed"), ("n", 3, "t", "retyped")]
    types = {(r.field_name, r.field_type) for r in report.unified().select("field_name", "field_type").distinct().collect()}
    assert types == {("a", "number"), ("c", "string"), ("fresh", "boolean"), ("gone", "integer"), ("t", "string")}
    assert report.unified().where("field_name = 'c'").count() == 20


def test_drift_of_awkward_rows(spark):
    data = [("n", 1, "x", "f", 1, '{"a": null}'), ("n", 1, "x", "f", 1, "[1]"), ("n", 1, None, "f", 1, "{broken"), ("n", 2, None, None, None, '{"a": 1}'), (None, 2, "x", "f", 1, '{"q": 1}'), ("n", None, "x", "f", 1, '{"q": 1}'), ("n", 2, "x", "f", 2, None), ("n", 2, "y", "f", 1, '{"a": ' + "9" * 60 + "}")]
    assert changes(drift(spark, data)) == [("n", 2, "a", "added")]
    assert changes(drift(spark, [])) == [] and drift(spark, []).unified().count() == 0


def test_rare_fields_are_no_fields(spark):
    data = [("n", 1, f"x{i}", "f", i, '{"a": 1}') for i in range(30)] + [("n", 2, f"x{i}", "f", i, '{"a": 1, "stray": 1}' if i < 2 else '{"a": 1}') for i in range(30)]
    assert changes(drift(spark, data)) == []


def test_unified_keeps_sparse_and_stray_values(spark):
    data = []
    for i in range(40):
        for v in (1, 2, 3):
            old = f'"old": {i}' if v == 1 else f'"new": {i}'
            sparse = ', "often": 2.5' if v == 2 and 20 <= i < 23 else ', "often": 1' if v != 2 and i < 10 else ""
            odd = ', "new": "other"' if v == 1 and i == 7 else ', "once": true' if v == 2 and i == 8 else ""
            data.append(("n", v, f"x{i}", "f", v * 100 + i, "{" + old + sparse + odd + "}"))
    got = drift(spark, data).unified()
    assert got.groupBy("field_name", "stray").count().sort("field_name", "stray").collect() == [("new", False, 40), ("new", True, 1), ("often", False, 13), ("once", True, 1)]
    assert [tuple(r) for r in got.where("stray").select("node_id", "field_name", "value", "as_boolean").sort("node_id").collect()] == [("x7", "new", "other", None), ("x8", "once", "true", True)]
    assert got.where("field_name = 'often' AND field_type = 'integer' AND NOT fits AND value = '2.5' AND as_integer IS NULL").count() == 3
    assert got.where("field_name = 'often' AND fits AND as_integer = 1").count() == 10


def test_promotion_is_a_lattice():
    kinds = [None, "boolean", "integer", "number", "string", "array", "object"]
    for a in kinds:
        for b in kinds:
            assert promote(a, b) == promote(b, a)
            for c in kinds:
                assert promote(promote(a, b), c) == promote(a, promote(b, c))
