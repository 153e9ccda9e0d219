"""Explaining, limits, pages, indexes in use, and the helpers around vaults and edges."""

import numpy as np
import pytest

from weft.plans.catalog import Catalog
from weft.search.vector import InvertedFile, nearest, nearest_codes, quantize
from weft.session import CypherError, GraphSession
from weft.sources import graph_files
from weft.sources.vault import list_notes, list_tags, note_neighbours, notes_with_tag, vault_graph, vault_sync


def pond(spark):
    g = Catalog(spark).register_nodes("Frog", spark.createDataFrame([(f"f{i}", i) for i in range(10)], "k string, n int"), "k")
    g.register_edges("NEAR", spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(9)], "a string, b string"), "a", "b")
    return GraphSession(spark, g)


def test_explain_gives_the_operators_as_a_tree(spark):
    s = pond(spark)
    q = "MATCH (a:Frog)-[:NEAR]->(b:Frog) WHERE a.n > 2 WITH b, count(*) AS c RETURN b.n AS n, c ORDER BY n LIMIT 3"
    lines = [r.plan for r in s.cypher("EXPLAIN " + q).orderBy("line").collect()]
    assert [x.strip() for x in lines[:6]] == ["TopN", "Project(n, c)", "Aggregate(b, c)", "Filter", "Expand(NEAR out -> b:Frog)", "NodeScan(a:Frog)"]
    assert [len(x) - len(x.lstrip()) for x in lines[:6]] == [0, 2, 4, 6, 8, 10]
    assert lines[6].startswith("estimated rows")
    ran = [r.plan for r in s.cypher("PROFILE " + q).orderBy("line").collect()]
    assert any(x.startswith("rows 3, seconds") for x in ran) and any("rows=" in x for x in ran)


def test_limits_of_a_statement(spark):
    s = pond(spark)
    assert len(s.rows("MATCH (f:Frog) RETURN f.n AS n", max_rows=10, seconds=300)) == 10
    with pytest.raises(CypherError, match="more than 9 rows"):
        s.rows("MATCH (f:Frog) RETURN f.n AS n", max_rows=9)
    slow = "UNWIND range(1, 30000) AS x UNWIND range(1, 30000) AS y WITH x, y WHERE x * y % 7 = 8 RETURN count(*) AS n"
    with pytest.raises(CypherError, match="longer than"):
        s.rows(slow, seconds=1.0)
    assert len(s.rows("MATCH (f:Frog) RETURN f.n AS n")) == 10


def test_cursor_pages(spark):
    s, seen, cursor = pond(spark), [], None
    while True:
        page, cursor = s.cursor_page("MATCH (f:Frog) RETURN f.n AS n ORDER BY n", cursor=cursor, size=4)
        seen += [r.n for r in page.collect()]
        if cursor is None:
            break
    assert seen == list(range(10))
    for bad in ("v2:4", "v1:x", "4"):
        with pytest.raises(CypherError):
            s.cursor_page("MATCH (f:Frog) RETURN f.n AS n", cursor=bad)


def test_vectors_of_an_index_have_one_dimension(spark):
    g = Catalog(spark).register_nodes("V", spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "k string, emb array<float>"), "k")
    s = GraphSession(spark, g)
    s.cypher("CREATE VECTOR INDEX vs FOR (v:V) ON (v.emb)")
    s.cypher("MATCH (v:V) WHERE v.emb IS NULL SET v.emb = [0.5, 0.5]")
    with pytest.raises(CypherError, match="values"):
        s.cypher("MATCH (v:V) SET v.emb = CASE WHEN id(v) = 'a' THEN [1.0, 2.0, 3.0] ELSE v.emb END")
    assert {len(r.e) for r in s.cypher("MATCH (v:V) RETURN v.emb AS e").collect()} == {2}


def test_approximate_search_uses_the_index_and_keeps_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 24))).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, emb array<float>")
    g = Catalog(spark).register_nodes("V", df, "k")
    s = GraphSession(spark, g)
    s.cypher("CREATE VECTOR INDEX vs FOR (v:V) ON (v.emb)")
    hit = 0
    for i in range(0, 3000, 600):
        q = "CALL search.vector({label: 'V', property: 'emb', query: $q, k: 10%s}) YIELD node, score RETURN id(node) AS i"
        exact = {r.i for r in s.cypher(q % "", {"q": x[i].tolist()}).collect()}
        got = {r.i for r in s.cypher(q % ", ef: 64", {"q": x[i].tolist()}).collect()}
        hit += len(exact & got)
    assert hit / 50 >= 0.9
    tables, index = s.catalog.built["V", "emb"]
    assert isinstance(index, InvertedFile) and index.probes(64) < len(index.centres)


def test_search_over_quantised_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 16), (901, None)], "id long, v array<float>")
    codes = quantize(df, "id", "v")
    hit = sum(len({r.id for r in nearest(df, "v", x[i].tolist(), 10).collect()} & {r.id for r in nearest_codes(codes, "id", x[i].tolist(), 10).collect()}) for i in (0, 7, 99))
    assert hit / 30 >= 0.9


def test_edges_are_removed_by_their_ends(spark):
    s = pond(spark)
    g = graph_files.remove_edges(s.catalog, "NEAR", spark.createDataFrame([("f0", "f1"), ("f0", "f9")], "src string, dst string"))
    assert GraphSession(spark, g).cypher("MATCH (:Frog)-[r:NEAR]->(:Frog) RETURN count(*) AS n").first().n == 8
    assert s.cypher("MATCH (:Frog)-[r:NEAR]->(:Frog) RETURN count(*) AS n").first().n == 9


def test_vault_is_synced_and_listed(spark, rows):
    one = "vault string, path string, text string"
    old = spark.createDataFrame([("v", "a.md", "[[b]] #x/y"), ("v", "b.md", "plain"), ("v", "c.md", "old")], one)
    new = spark.createDataFrame([("v", "a.md", "[[b]] #x/y"), ("v", "b.md", "[[d]] #z"), ("v", "d.md", "")], one)
    notes, changes = vault_sync(old, new)
    assert rows(changes) == [("v", "b.md", "changed"), ("v", "c.md", "removed"), ("v", "d.md", "added")]
    assert rows(notes) == rows(new)
    assert {r.path for r in vault_sync(old, new, prune=False)[0].collect()} == {"a.md", "b.md", "c.md", "d.md"}
    g = vault_graph(notes)
    assert [r.note for r in list_notes(g).collect()] == ["v/a.md", "v/b.md", "v/d.md"]
    assert {r.note for r in note_neighbours(g, "v/b.md").collect()} == {"v/a.md", "v/d.md"}
    assert {r.tag: r.notes for r in list_tags(g).collect()} == {"x": 0, "x/y": 1, "z": 1}
    assert [r.note for r in notes_with_tag(g, "#x").collect()] == ["v/a.md"]
    assert vault_sync(new, new)[1].count() == 0


def test_louvain_counts_a_loop_for_both_ends(spark):
    g = Catalog(spark).register_nodes("N", spark.createDataFrame([(x,) for x in "abcd"], "k string"), "k")
    g.register_edges("E", spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "a", 4.0), ("d", "d", 4.0)], "s string, d string, weight double"), "s", "d")
    got = {r.i: r.c for r in GraphSession(spark, g).cypher("CALL algo.louvain({}) YIELD node_id, community RETURN id(node_id) AS i, community AS c").collect()}
    # with loops counted twice in strength, joining the looped ends never pays
    assert got["a"] != got["d"] and set(got) == set("abcd")
