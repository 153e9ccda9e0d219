import numpy as np

from weft.llm import neighbours as N


def frame(spark, key, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], f"{key} long, vector array<double>")


def brute(base, asked, k=5, least=0.85):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(asked) @ unit(base).T
    out = set()
    for i, row in enumerate(s):
        order = np.argsort(-np.round(row, 12), kind="stable")[:k]
        out |= {(i, int(j)) for j in order if row[j] >= least}
    return out


def data(seed=2, clusters=30):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, 64)) * 1.0
    base = np.concatenate([c + rng.standard_normal((int(n), 64)) * 0.3 for c, n in zip(centres, rng.integers(3, 60, clusters))] + [rng.standard_normal((300, 64))])
    asked = np.concatenate([centres + rng.standard_normal(centres.shape) * 0.2, rng.standard_normal((10, 64))])
    return base * rng.uniform(0.1, 9, (len(base), 1)), asked


def test_recall(spark):
    base, asked = data()
    want = brute(base, asked)
    got = {(r.item_id, r.vec_id) for r in N.most_similar(frame(spark, "vec_id", base), frame(spark, "item_id", asked)).collect()}
    assert len(want) > 100
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_copies_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal(64)
    base = np.stack([v] * 40 + [rng.standard_normal(64) for _ in range(20)])
    got = sorted(r.vec_id for r in N.most_similar(frame(spark, "vec_id", base), frame(spark, "item_id", np.stack([v * 3]))).collect())
    assert got == [0, 1, 2, 3, 4]


def test_repeated_items_and_clashing_columns(spark):
    base, asked = data(5, 4)
    b = frame(spark, "vec_id", base).selectExpr("*", "'x' AS unit", "1 AS id")
    q = frame(spark, "item_id", asked[:4])
    once = {tuple(r)[:2] for r in N.most_similar(b, q).collect()}
    twice = [tuple(r)[:2] for r in N.most_similar(b, q.unionByName(q)).collect()]
    assert len(twice) == len(set(twice)) and set(twice) == once


def test_empty_sides(spark):
    base, asked = data(6, 3)
    none_b, none_q = frame(spark, "vec_id", []), frame(spark, "item_id", [])
    assert N.most_similar(none_b, frame(spark, "item_id", asked)).count() == 0
    assert N.most_similar(frame(spark, "vec_id", base), none_q).count() == 0
    assert N.most_similar(frame(spark, "vec_id", base[:1]), frame(spark, "item_id", base[:1])).count() == 1


def test_the_graph_comes_from_the_rounds_not_from_its_random_links(spark, tmp_path):
    from pyspark.sql import functions as F

    from weft.storage import Scratch

    base, _ = data(9, 120)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytearray(v.astype(np.float16).tobytes())) for i, v in enumerate(unit)], "id long, unit binary")
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    best = {(i, int(j)) for i, r in enumerate(s) for j in np.argsort(-r)[:5] if r[j] >= 0.85}

    def recall(rounds):
        graph = N.build_graph(nodes, len(unit), Scratch(spark, "t"), rounds)
        assert graph.groupBy("id").agg(F.count("nb").alias("n"), F.count_distinct("nb").alias("m")).where(f"n > {N.LINKS} OR n <> m").isEmpty()
        got = {(r.id, r.nb) for r in graph.collect()}
        return len(got & best) / len(best)

    assert recall(0) < 0.7 and recall(64) >= 0.93
