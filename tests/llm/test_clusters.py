import numpy as np
import pytest

from weft.llm import clusters as C, vectors as V

S = 0.85
RAW = "vec_id long, lsn long, vector array<double>, written_at timestamp"


def brute(ids, x):
    """vec_id to cluster, by comparing all pairs."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= S
    out = {}
    for i in range(len(ids)):
        own = near[i]
        if own.sum() >= 3 and all((near[j] == own).all() for j in np.flatnonzero(own)):
            out[ids[i]] = min(ids[j] for j in np.flatnonzero(own))
    return out


def planted(seed, sizes, spread=0.25, loose=60):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((loose, 64))]
    for n in sizes:
        c = rng.standard_normal(64)
        parts.append(c / np.linalg.norm(c) * 8 + rng.standard_normal((n, 64)) * spread)
    x = np.concatenate(parts) * rng.uniform(0.01, 50, (sum(sizes) + loose, 1))
    return x[rng.permutation(len(x))]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")


@pytest.mark.parametrize("block", [24_000, 120])
def test_equals_brute_force(spark, block):
    x = planted(1, [3, 5, 40, 2, 9, 150, 17])
    want = brute(range(len(x)), x)
    got = {r.vec_id: r.cluster_id for r in C.similarity_clusters(frame(spark, x), block_rows=block).collect()}
    assert got == want and len(want) > 200


def test_chains_and_near_misses_are_no_clusters(spark):
    e = np.eye(64)

    def at(degrees, plane=0):
        a = np.radians(degrees)
        return np.cos(a) * e[plane] + np.sin(a) * e[plane + 1]

    chain = [at(d) for d in (0, 25, 50)]  # ends too far apart
    pair = [at(d, 4) for d in (0, 5)]  # too few
    good = [at(d, 8) for d in (0, 5, 10)]
    copies = [e[20]] * 4
    x = np.stack(chain + pair + good + copies)
    got = {r.vec_id: r.cluster_id for r in C.similarity_clusters(frame(spark, x)).collect()}
    assert got == brute(range(len(x)), x) == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 8, 11: 8}


def arc(degrees):
    a = np.radians(degrees)
    return np.stack([np.cos(a), np.sin(a)], 1) @ np.eye(64)[:2]


def test_a_leaf_is_linked_to_every_leaf_it_touches(spark):
    # leaf 8 touches leaf 1 and leaf 4, and 4 touches no smaller one: {4, 5, 6} is no cluster, since 9 is similar to 4
    ids, x = [1, 2, 8, 9, 4, 5, 6], arc([0, 15, 30, 46, 65, 80, 95])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, vector array<double>")
    got = {r.vec_id: r.cluster_id for r in C.similarity_clusters(df).collect()}
    assert got == brute(ids, x) == {}


def test_a_vector_that_links_two_clusters(spark):
    # the leaves are {1, 2, 3, 7} and {4, 5, 6}, their centres far apart, and 7 is similar to all
    ids, x = [1, 2, 3, 4, 5, 6, 7], arc([0, 0, 0, 56, 56, 56, 28])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, vector array<double>")
    assert C.similarity_clusters(df).count() == len(brute(ids, x)) == 0


@pytest.mark.parametrize("cell", [C.CELL_ROWS, 6])
def test_linked_clusters_over_many_pivots_equal_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    parts = [planted(6, [4, 30, 8], loose=20)]
    for degrees in rng.uniform(40, 63, 12):  # two clusters and a vector between them, in a plane of their own
        plane = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        a = np.radians(np.r_[rng.uniform(-2, 2, 4), degrees + rng.uniform(-2, 2, 4), degrees / 2])
        parts.append(np.stack([np.cos(a), np.sin(a)], 1) @ plane)
    x = np.concatenate(parts)
    x = x[rng.permutation(len(x))]
    got = {r.vec_id: r.cluster_id for r in C.similarity_clusters(frame(spark, x), block_rows=40, cell_rows=cell).collect()}
    assert got == brute(range(len(x)), x) and len(got) >= 42


def test_parts_of_random_pairs():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, (2, 200))
    parent = np.arange(300)
    for i in range(0, 200, 50):  # as blocks of pairs come in
        C.join_parts(parent, a[i : i + 50], b[i : i + 50])
    want = np.arange(300)
    while (new := np.minimum.reduce([want] + [np.where(np.arange(300) == p, want[q], want) for i, j in zip(a, b) for p, q in ((i, j), (j, i))])).tolist() != want.tolist():
        want = new
    assert parent.tolist() == want.tolist()


def test_one_compact_cluster_larger_than_blocks(spark):
    x = planted(4, [400], spread=0.1, loose=20)
    got = {r.vec_id: r.cluster_id for r in C.similarity_clusters(frame(spark, x), block_rows=50).collect()}
    assert got == brute(range(len(x)), x) and len(got) == 400


def test_current_vectors(spark):
    ok = [1.0] * 64
    data = [
        (1, 1, ok, None), (1, 2, [2.0] * 64, None), (2, 5, ok, None), (2, 6, None, None), (3, 1, [0.0] * 64, None), (4, 1, [float("nan")] + ok[1:], None),
        (5, 1, ok[:32], None), (6, 1, [float("inf")] + ok[1:], None), (None, 1, ok, None), (7, None, ok, None), (7, None, ok, None), (8, 1, [None] + ok[1:], None), (9, 1, [1e300] * 64, None),
    ]
    df = spark.createDataFrame(data, RAW).selectExpr("*", "1 AS unit", "2 AS cluster_id")
    got = {r.vec_id: r.vector[0] for r in V.current_vectors(df).collect()}
    assert got == {1: 2.0, 7: 1.0, 9: 1e300}
    assert C.similarity_clusters(V.current_vectors(df)).count() == 3


def test_empty(spark):
    empty = V.current_vectors(spark.createDataFrame([], RAW))
    found = C.similarity_clusters(empty)
    assert found.count() == 0 and C.describe(found, empty).count() == 0


def test_description(spark):
    x = planted(7, [6, 4], loose=5)
    df = frame(spark, x)
    found = C.similarity_clusters(df)
    rows = C.describe(found, df, members=3).collect()
    assert sorted(r["size"] for r in rows) == [4, 6]
    for r in rows:
        own = [q.vec_id for q in found.collect() if q.cluster_id == r.cluster_id]
        unit = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
        centre = unit.sum(0)
        order = [own[i] for i in np.argsort(-(unit @ centre), kind="stable")]
        assert r.typical == order[:3] and 0 <= r.dispersion < 0.1
