import random

from weft.llm.groups import current_matches, link_groups

RELS = "edge_type string, src string, dst string, lsn long, tombstone boolean"


def brute(pairs):
    root = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in root and b in root and a != b:
                m = min(root[a], root[b])
                if root[a] != m or root[b] != m:
                    root[a] = root[b] = m
                    changed = True
    return root


def check(spark, pairs):
    found = link_groups(spark.createDataFrame(pairs, "src string, dst string").selectExpr("*", "1 AS v", "2 AS m"))
    rows = found.collect()
    got = {r.node: r.group for r in rows}
    assert len(rows) == len(got) and got == brute(pairs)


def test_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (50, 60)):
        check(spark, [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)])


def test_long_chain_star_and_nulls(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    random.Random(2).shuffle(chain)
    star = [("hub", f"s{i:03}") for i in range(200)]
    check(spark, chain + star + [(None, "x"), ("x", None), (None, None), ("self", "self"), ("a", "b"), ("b", "a"), ("a", "b")])


def test_empty(spark):
    check(spark, [])
    assert current_matches(spark.createDataFrame([], RELS)).count() == 0


def test_current_matches(spark):
    a, b, c = ("%032x" % i for i in (10, 11, 12))
    data = [
        ("SAME_AS", a, b.upper(), 1, False), ("SAME_AS", "{" + a + "}", b, 2, True),  # gone
        ("SAME_AS", b, a, 1, None),  # the other direction stays
        ("SAME_AS", a, c, 3, False), ("SAME_AS", a, c, 3, True),  # a tie goes to the tombstone
        ("SAME_AS", a, a.upper(), 9, False), ("KNOWS", a, c, 9, False), (None, a, c, 9, False), ("SAME_AS", None, c, 1, False), ("SAME_AS", b, c, None, False),
    ]
    got = {tuple(r) for r in current_matches(spark.createDataFrame(data, RELS)).collect()}
    assert got == {(b, a), (b, c)}
