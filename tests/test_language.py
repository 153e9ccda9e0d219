"""The pattern language on a small graph: rules that SQL on the large tables doesn't reach."""


import pytest

from weft.plans.catalog import Catalog
from weft.session import CypherError, GraphSession


@pytest.fixture
def graph(spark):
    g = Catalog(spark)
    people = [("1", "alice", 30), ("2", "bob", 25), ("3", "carol", None), ("4", "dave", 30)]
    g.register_nodes("Person", spark.createDataFrame(people, "pid string, name string, age int"), "pid")
    g.register_nodes("City", spark.createDataFrame([("c1", "Rome")], "cid string, name string"), "cid")
    knows = [("1", "2", 2020), ("2", "3", 2021), ("3", "1", 2022), ("1", "1", 2000), ("3", "4", 2010)]
    g.register_edges("KNOWS", spark.createDataFrame(knows, "a string, b string, since int"), "a", "b", "Person", "Person")
    g.register_edges("LIVES", spark.createDataFrame([("1", "c1"), ("1", "c1")], "a string, b string"), "a", "b", "Person", "City")
    return GraphSession(spark, g)


def ask(s, text, **params):
    return [tuple(r) for r in s.cypher(text, params).collect()]


def test_null_is_greatest(graph):
    assert [a for a, in ask(graph, "MATCH (p:Person) RETURN p.age AS a ORDER BY a")] == [25, 30, 30, None]
    assert [a for a, in ask(graph, "MATCH (p:Person) RETURN p.age AS a ORDER BY a DESC")] == [None, 30, 30, 25]


def test_self_loop_counts_once_both_ways(graph):
    assert ask(graph, "MATCH (a:Person {name: 'alice'})-[:KNOWS]-(b) RETURN count(*) AS n") == [(3,)]


def test_one_edge_per_pair(graph):
    assert ask(graph, "MATCH ()-[r:LIVES]->() RETURN count(r) AS n") == [(1,)]


def test_uniqueness_switch(graph, spark):
    q = "MATCH (a {name: 'alice'})-[:KNOWS]-(b)-[:KNOWS]-(c) RETURN count(*) AS n"
    loose = GraphSession(spark, graph.catalog, uniqueness="segment")
    assert ask(graph, q)[0][0] < ask(loose, q)[0][0]


def test_optional_conditions_stay_inside(graph):
    q = "MATCH (p:Person) OPTIONAL MATCH (p)-[k:KNOWS {since: 2020}]->(b {name: 'bob'}) WHERE b.age > 1 RETURN p.name AS n, b.name AS b ORDER BY n"
    assert ask(graph, q) == [("alice", "bob"), ("bob", None), ("carol", None), ("dave", None)]


def test_second_optional_hop_from_null(graph):
    q = "MATCH (p:Person {name: 'dave'}) OPTIONAL MATCH (p)-[:LIVES]->(c) OPTIONAL MATCH (c)<-[:LIVES]-(q) RETURN c.name AS c, q.name AS q"
    assert ask(graph, q) == [(None, None)]


def test_optional_without_hop(graph):
    assert ask(graph, "OPTIONAL MATCH (n:Nothing) RETURN n IS NULL AS gone") == [(True,)]


def test_anonymous_middle(graph):
    assert ask(graph, "MATCH (a {name: 'alice'})-[:KNOWS]->()-[:KNOWS]->(c) RETURN c.name AS c ORDER BY c") == [("bob",), ("carol",)]


def test_paths(graph):
    q = "MATCH p = (a:Person {name: 'alice'})-[:KNOWS*0..2]->(b) RETURN length(p) AS n, [x IN nodes(p) | x.name] AS ns ORDER BY n, ns[1], ns[2]"
    assert ask(graph, q) == [(0, ["alice"]), (1, ["alice", "alice"]), (1, ["alice", "bob"]), (2, ["alice", "alice", "bob"]), (2, ["alice", "bob", "carol"])]
    q = "MATCH p = shortestPath((a {name: 'alice'})-[:KNOWS*]->(b {name: 'dave'})) RETURN [x IN nodes(p) | x.name] AS ns"
    assert ask(graph, q) == [(["alice", "bob", "carol", "dave"],)]


def test_open_length_ends_when_no_edge_is_left(graph):
    assert ask(graph, "MATCH (a {name: 'alice'})-[r:KNOWS*]->(b {name: 'dave'}) RETURN size(r) AS n ORDER BY n") == [(3,), (4,)]


def test_hops_from_parameters(graph):
    assert ask(graph, "MATCH (a {name: 'alice'})-[r:KNOWS*1..$n]->(b) RETURN max(size(r)) AS n", n=2) == [(2,)]
    with pytest.raises(CypherError):
        ask(graph, "MATCH (a)-[:KNOWS*3..1]->(b) RETURN a")


def test_lateral_limit_and_empty_aggregate(graph):
    q = "MATCH (a:Person) CALL { WITH a MATCH (a)-[:KNOWS]->(b) RETURN b.name AS b ORDER BY b LIMIT 1 } RETURN a.name AS n, b ORDER BY n"
    assert ask(graph, q) == [("alice", "alice"), ("bob", "carol"), ("carol", "alice")]
    q = "MATCH (a:Person) CALL { WITH a MATCH (a)-[:LIVES]->(b) RETURN count(*) AS k, collect(b.name) AS c } RETURN a.name AS n, k, c ORDER BY n"
    assert ask(graph, q)[1] == ("bob", 0, [])


def test_nan_is_equal_to_nothing(graph):
    q = "WITH [1.0 / 0.0, 0.0 / 0.0] AS l RETURN l[0] > 1 AS a, l[1] = l[1] AS b, l[1] < 1 AS c"
    assert ask(graph, q) == [(True, False, None)]


def test_errors(graph):
    for q in ("RETURN 1 / 0 AS x", "RETURN 1 % 0 AS x", "UNWIND range(1, 2, 0) AS x RETURN x", "RETURN left('a', -1) AS x", "RETURN dot_product([1.0], [1.0, 2.0]) AS x"):
        with pytest.raises(Exception):
            ask(graph, q)
    for q in ("MATCH (a) RETURN b", "MATCH (a", "RETURN nope(1) AS x", "RETURN [1, 'a'] AS x", "UNWIND 3 AS x RETURN x", "MATCH (a) SET a.x = 1 UNION RETURN 1 AS x", "RETURN 1 AS a UNION RETURN 1 AS b", "MATCH (a:Person) RETURN a.age + count(*) AS x"):
        with pytest.raises(CypherError):
            ask(graph, q)


def test_to_string_and_integer(graph):
    q = "RETURN toString(3.0) AS a, toString(-0.25) AS b, toString(true) AS c, toInteger('3.7') AS d, toInteger(3.7) AS e, toInteger(' 12 ') AS f, toString(1e16) AS g"
    assert ask(graph, q) == [("3", "-0.25", "true", None, 3, 12, "10000000000000000")]


def test_regex_is_anchored(graph):
    assert ask(graph, "RETURN 'ab\\n' =~ 'ab' AS a, 'ab' =~ 'a|ab' AS b") == [(False, True)]


def test_trim_and_split(graph):
    assert ask(graph, "RETURN trim(' a\t') AS a, split('a.b', '.') AS b, split('ab', '') AS c") == [("a", ["a", "b"], ["a", "b"])]


def test_in_and_quantifiers_with_null(graph):
    q = "RETURN null IN [] AS a, 1 IN [2, null] AS b, any(x IN [null, 1] WHERE x = 2) AS c, all(x IN [] WHERE x = 1) AS d, single(x IN [1, null] WHERE x = 1) AS e, 1 IN ['a'] AS f"
    assert ask(graph, q) == [(False, None, None, True, True, False)]


def test_deep_precedence(graph):
    assert ask(graph, "RETURN 2 ^ 3 ^ 0 AS a, 1 + 2 * 3 AS b, NOT false AND false AS c, true OR true XOR true AS d, 1 < 2 < 3 AS e") == [(2.0, 7, False, True, True)]


def test_writes(graph):
    ask(graph, "CREATE (x:Person {_id: '9', name: 'zed'})-[:KNOWS {since: 1}]->(:Person {name: 'yan'})")
    assert graph.counters["nodes_created"] == 2
    assert ask(graph, "UNWIND ['bob', 'new', 'new'] AS x MERGE (p:Person {name: x}) ON CREATE SET p.made = true RETURN x, p.made AS m ORDER BY x") == [("bob", None), ("new", True), ("new", True)]
    assert ask(graph, "MATCH (p:Person {name: 'zed'}) SET p.age = 8, p += {nick: 'Z'} RETURN p.age AS a, p.nick AS n") == [(8, "Z")]
    assert ask(graph, "MATCH (p:Person {name: 'zed'}) SET p:Admin RETURN labels(p) AS l") == [(["Admin", "Person"],)]
    assert ask(graph, "MATCH (a:Person {name: 'alice'}), (b:Person {name: 'dave'}) MERGE (a)-[k:KNOWS]->(b) ON CREATE SET k.since = 7 RETURN k.since AS s") == [(7,)]
    assert ask(graph, "MATCH (a:Person {name: 'alice'}), (b:Person {name: 'dave'}) MERGE (a)-[k:KNOWS]->(b) ON CREATE SET k.since = 8 RETURN k.since AS s") == [(7,)]
    with pytest.raises(CypherError):
        ask(graph, "MATCH (p {name: 'zed'}) DELETE p")
    ask(graph, "MATCH (p {name: 'zed'}) DETACH DELETE p")
    assert ask(graph, "MATCH (p {name: 'zed'}) RETURN count(*) AS n") == [(0,)]
    ask(graph, "MATCH (:Person {name: 'alice'})-[k:KNOWS]->(:Person {name: 'dave'}) DELETE k")
    assert ask(graph, "MATCH (:Person {name: 'alice'})-[k:KNOWS]->(:Person {name: 'dave'}) RETURN count(k) AS n") == [(0,)]


def test_constraints(graph):
    ask(graph, "CREATE CONSTRAINT one FOR (p:Person) REQUIRE p.name IS UNIQUE")
    with pytest.raises(CypherError, match="bob"):
        ask(graph, "CREATE (:Person {name: 'bob'})")
    with pytest.raises(CypherError):
        ask(graph, "CREATE CONSTRAINT some FOR (p:Person) REQUIRE p.age IS NOT NULL")
    assert ask(graph, "SHOW CONSTRAINTS") == [("one", "UNIQUE", "NODE", ["Person"], ["name"])]
    ask(graph, "DROP CONSTRAINT one")
    assert ask(graph, "SHOW CONSTRAINTS") == []
    ask(graph, "CREATE VECTOR INDEX v FOR (p:Person) ON (p.emb)")
    assert ask(graph, "SHOW INDEXES")[0][:2] == ("v", "VECTOR INDEX")


def test_pages(graph):
    q = "MATCH (p:Person) RETURN p.name AS name"
    first = [r.name for r in graph.page(q, None, ["name"], 2).collect()]
    assert first == ["alice", "bob"]
    assert [r.name for r in graph.page(q, None, ["name"], 2, after=("bob",)).collect()] == ["carol", "dave"]


def test_explain_and_profile(graph):
    assert any("Scan" in x for _, x in ask(graph, "EXPLAIN MATCH (p:Person) RETURN p.name AS n"))
    assert any("rows 4" in x for _, x in ask(graph, "PROFILE MATCH (p:Person) RETURN p.name AS n"))


def test_unknown_names(graph):
    assert ask(graph, "MATCH (n:Ghost)-[:HAUNTS]->(m) RETURN n") == []
    with pytest.raises(CypherError):
        ask(graph, "CALL algo.wcc({labels: ['Ghost']}) YIELD node_id RETURN node_id")


def test_algorithms(graph, spark):
    cfg = "{labels: ['Person'], edge_types: ['KNOWS']}"

    def run(name, more=""):
        c = cfg[:-1] + more + "}"
        return {r[0]._id: tuple(r[1:]) for r in graph.cypher(f"CALL algo.{name}({c})").collect()}

    assert set(run("wcc").values()) == {(0,)}
    assert run("scc") == {"1": (0,), "2": (0,), "3": (0,), "4": (1,)}
    assert run("degree")["1"] == (2, 2, 4)
    assert run("triangle_count")["3"] == (1, pytest.approx(1 / 3))
    rank = run("pagerank")
    assert sum(v[0] for v in rank.values()) == pytest.approx(1)
    assert run("shortest_path", ", source: '1'") == {"1": (0.0, 0), "2": (1.0, 1), "3": (2.0, 2), "4": (3.0, 3)}
    assert run("betweenness") == {"1": (1.0,), "2": (2.0,), "3": (3.0,), "4": (0.0,)}
    assert set(run("label_propagation")) == set(run("louvain")) == set("1234")
    assert len(run("fastRP", ", dimension: 8")["1"][0]) == 8


def social_tables(spark, path, label, kind, edges, n):
    """graph_nodes and rels of n nodes of one label and the edges (a, b) of one type."""
    name = lambda i: f"{i:032x}"
    spark.createDataFrame([(name(i), label) for i in range(n)], "node_id string, label string").selectExpr("*", "'a' AS firstname", "'b' AS lastname", "1 AS age", "1L AS content_chars", "timestamp('2024-01-01') AS creationdate").write.parquet(f"{path}/graph_nodes.parquet")
    spark.createDataFrame([(kind, name(a), name(b)) for a, b in edges], "edge_type string, src string, dst string").selectExpr("*", "timestamp('2024-01-01') AS since", "1.0D AS weight", "1L AS lsn", "false AS tombstone").write.parquet(f"{path}/rels.parquet")


def test_registered_pagerank_runs_to_the_default_tolerance(spark, tmp_path):
    from weft.queries_graph import QUERIES

    n, edges = 6, [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]
    social_tables(spark, tmp_path, "Person", "KNOWS", edges, n)
    want = [1 / n] * n
    for _ in range(300):  # each vertex has one edge out
        want = [0.15 / n + 0.85 * sum(want[a] for a, b in edges if b == i) for i in range(n)]
    got = {int(r.id, 16): r.score for r in QUERIES["algo_pagerank"](spark, str(tmp_path)).collect()}
    assert sum(abs(got[i] - want[i]) for i in range(n)) < 1e-5


def test_betweenness_by_joins_is_the_same(graph, monkeypatch):
    from weft.algo import communities

    q = "CALL algo.betweenness({labels: ['Person'], edge_types: ['KNOWS'], direction: 'undirected'})"
    sent = {r[0]._id: r[1] for r in graph.cypher(q).collect()}
    monkeypatch.setattr(communities, "SENT_EDGES", 0)
    assert {r[0]._id: r[1] for r in graph.cypher(q).collect()} == pytest.approx(sent)


def test_components_of_random_graphs(spark):
    import random

    from weft.algo.components import weak_roots
    from weft.storage import Scratch

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.range(60)
    found = weak_roots(nodes, spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"))
    assert {r.id: r.root for r in found.collect()} == dict(enumerate(root))




def test_shortest_path_between_known_pairs(graph):
    q = "MATCH (a:Person), (b:Person) WHERE a.name < 'c' MATCH p = shortestPath((a)-[:KNOWS*..5]->(b)) RETURN a.name AS a, b.name AS b, length(p) AS n ORDER BY a, b"
    assert ask(graph, q) == [("alice", "bob", 1), ("alice", "carol", 2), ("alice", "dave", 3), ("bob", "alice", 2), ("bob", "carol", 1), ("bob", "dave", 2)]


def test_whole_shortest_paths_equal_brute_force(spark, tmp_path):
    from weft.queries_graph import QUERIES

    n, edges = 9, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (4, 8), (8, 6), (7, 3)]
    social_tables(spark, tmp_path, "Post", "LINKS_TO", edges, n)
    pairs, paths = {}, {}
    for a in range(n):
        level, seen, hops = {a: 1}, {a}, 0
        while level:
            hops, new = hops + 1, {}
            for x, y in edges:
                if x in level and y not in seen:
                    new[y] = new.get(y, 0) + level[x]
            if new:
                pairs[hops] = pairs.get(hops, 0) + len(new)
                paths[hops] = paths.get(hops, 0) + sum(new.values())
            level, seen = new, seen | set(new)
    found = {q: {r.hops: r.n for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("shortest_path_whole", "all_shortest_paths_whole")}
    assert found == {"shortest_path_whole": pairs, "all_shortest_paths_whole": paths} and max(pairs) > 4 and paths != pairs


def test_command_line_parses(capsys):
    from weft.__main__ import main

    assert main(["parse", "MATCH (n) RETURN n"]) == 0
    assert "Match" in capsys.readouterr().out


def test_floats_as_text_without_exponent(spark):
    s = GraphSession(spark, Catalog(spark))
    got = s.cypher("UNWIND [1e-20, 1e300, -2.5e17, 0.00012, 1.5, 3.0, -0.5, 123456789.125] AS x RETURN toString(x) AS t").collect()
    assert [r.t for r in got] == ["0." + "0" * 19 + "1", "1" + "0" * 300, "-250000000000000000", "0.00012", "1.5", "3", "-0.5", "123456789.125"]


def test_a_change_writes_only_the_tables_it_touches_and_rows_apply_in_order(spark):
    g = Catalog(spark).register_nodes("A", spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), "k").register_nodes("B", spark.createDataFrame([("c", 3)], "k string, n int"), "k")
    s = GraphSession(spark, g)
    other = next(t.df for t in g.nodes if t.labels == {"B"})
    s.cypher("MATCH (x:A) UNWIND [7, 9, 8] AS v SET x.v = v")
    assert {r.v for r in s.cypher("MATCH (x:A) RETURN x.v AS v").collect()} == {8}
    s.cypher("MATCH (x:A {n: 2}) DELETE x")
    assert s.counters["nodes_deleted"] == 1
    assert next(t.df for t in s.catalog.nodes if t.labels == {"B"}) is other
    s.cypher("MATCH (x:A), (y:B) UNWIND [1, 2, 3] AS w CREATE (x)-[:R {w: w}]->(y)")
    assert [r.w for r in s.cypher("MATCH ()-[r:R]->() RETURN r.w AS w").collect()] == [3]
