"""Vaults, searches, files and feeds."""

import pytest

from weft.plans.catalog import Catalog
from weft.search.text import parse_query, tokens
from weft.search.vector import InvertedFile, nearest, quantize
from weft.session import CypherError, GraphSession
from weft.sources import graph_files
from weft.sources.vault import hash_embedding, parse_note, read_vault, vault_graph

NOTES = [
    ("v", "a/one.md", "---\ntitle: First\ntags: [x/y, z]\naliases: [uno]\n---\nSee [[two|that]] and ![[pic]] #x/y/w `#no` \n```\n[[no]]\n```\n"),
    ("v", "two.md", "Back to [[UNO]] and [[one#part]] and [[ghost]]. #12 is no tag"),
    ("v", "empty.md", None),
    ("w", "two.md", "[[one]]"),
    ("v", "two.md", ""),
]


def test_note_parser():
    note = parse_note(NOTES[0][2])
    assert note == {"title": "First", "aliases": ["uno"], "tags": ["x/y", "z", "x/y/w"], "links": ["two"], "embeds": ["pic"]}
    assert parse_note("")["links"] == []
    assert parse_note("﻿---\r\ntags: a, b\r\n---\r\ntext")["tags"] == ["a", "b"]


def test_vault_graph(spark, rows):
    s = GraphSession(spark, vault_graph(spark.createDataFrame(NOTES, "vault string, path string, text string")))
    got = rows(s.cypher("MATCH (a:Note)-[r]->(b:Note) RETURN id(a) AS a, type(r) AS t, id(b) AS b"))
    assert got == [("v/a/one.md", "EMBEDS", "v/?pic"), ("v/a/one.md", "LINKS_TO", "v/two.md"), ("v/two.md", "LINKS_TO", "v/?ghost"), ("v/two.md", "LINKS_TO", "v/a/one.md"), ("w/two.md", "LINKS_TO", "w/?one")]
    assert rows(s.cypher("MATCH (a:Tag)-[:SUBTAG_OF]->(b) RETURN a.name AS a, b.name AS b")) == [("x/y", "x"), ("x/y/w", "x/y")]
    pruned = GraphSession(spark, vault_graph(spark.createDataFrame(NOTES, "vault string, path string, text string"), placeholders=False))
    assert rows(pruned.cypher("MATCH ()-[r:EMBEDS]->() RETURN count(r) AS n")) == [(0,)]


def test_read_vault(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("hello\n[[m]]\n")
    (tmp_path / "m.md").write_text("x")
    assert {(r.path, r.text) for r in read_vault(spark, str(tmp_path)).collect()} == {("sub/n.md", "hello\n[[m]]\n"), ("m.md", "x")}


def test_tokens():
    assert tokens("Éclair-123 東京都 x_y") == ["éclair", "123", "東京", "京都", "x", "y"]
    assert parse_query('"a b" c pre*') == (["c", "a", "b"], ["pre"], [["a", "b"]])
    assert tokens("") == []


def shelf(spark):
    books = [
        ("tide", "harbour tide tables for small boats", [0.0, 2.0, 1.0], 4),
        ("loom", "repairing a wooden loom", [3.0, 0.0, -1.0], 5),
        ("knot", "knots for boats and a loom", [1.0, 1.0, 0.0], 5),
        ("void", None, None, None),
        ("flat", "", [0.0, 0.0, 0.0], 6),
    ]
    return GraphSession(spark, Catalog(spark).register_nodes("Book", spark.createDataFrame(books, "k string, body string, emb array<float>, kind int"), "k"))


def test_vector_search(spark):
    s = shelf(spark)
    q = "CALL search.vector({label: 'Book', property: 'emb', query: [0.0, 1.0, 0.0], k: 9%s}) YIELD node, score RETURN id(node) AS i"
    assert [r.i for r in s.cypher(q % "").collect()] == ["tide", "knot", "loom"]
    assert [r.i for r in s.cypher(q % ", filter: {kind: 5}").collect()] == ["knot", "loom"]
    assert [r.i for r in s.cypher(q % ", filter: {kind: {gt: 3, lte: 4}}").collect()] == ["tide"]
    assert [r.i for r in s.cypher(q % ", metric: 'euclidean'").collect()][:2] == ["flat", "knot"]
    with pytest.raises(CypherError):
        s.cypher(q % ", filter: {}").collect()


def test_text_search(spark):
    s = shelf(spark)
    q = "CALL search.bm25({label: 'Book', text_property: 'body', query: %r}) YIELD node, score RETURN id(node) AS i"
    assert [r.i for r in s.cypher(q % "boats loom").collect()] == ["knot", "loom", "tide"]
    assert [r.i for r in s.cypher(q % '"small boats"').collect()] == ["tide"]
    assert [r.i for r in s.cypher(q % "harb*").collect()] == ["tide"]
    assert s.cypher(q % "anchor").count() == 0 and s.cypher(q % "").count() == 0


def test_hybrid_search(spark):
    s = shelf(spark)
    q = "CALL search.hybrid({label: 'Book', text_property: 'body', query_text: 'boats loom', query_vector: [1.0, 1.0, 0.0], vector_property: 'emb', k: 2, fusion: '%s'}) YIELD node, score RETURN id(node) AS i, score"
    assert s.cypher(q % "rrf").first().i == "knot"
    assert s.cypher(q % "linear").first() == ("knot", 1.0)


def test_quantised_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, -0.5, 0.0]), (2, [0.0, 0.0, 0.0])], "id int, v array<float>")
    got = {r.id: [c * r.scale for c in r.codes] for r in quantize(df, "id", "v").collect()}
    assert got[1] == pytest.approx([1.0, -0.5, 0.0], abs=0.005) and got[2] == [0, 0, 0]


def test_inverted_file(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>")
    index = InvertedFile(df, "v", cells=16)
    hit = 0
    for i in range(0, 600, 50):
        exact = {r.id for r in nearest(df, "v", x[i].tolist(), 5).collect()}
        hit += len(exact & {r.id for r in index.search(x[i].tolist(), 5, probes=12).collect()})
    assert hit / 60 >= 0.9


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b  A"), (3, None)], "k int, t string")
    got = {r.k: r.embedding for r in hash_embedding(df, "k", "t").collect()}
    assert got[1] == got[2] and not any(got[3])


def test_files(spark, tmp_path, rows):
    spark.createDataFrame([(bytes(16), "x", 1), (bytes([1] * 16), "y", 2)], "node_id binary, name string, n int").write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([(bytes(16), bytes([1] * 16), 0.5)], "src binary, dst binary, w double").write.parquet(f"{tmp_path}/e")
    g = graph_files.load_edges(graph_files.load_nodes(Catalog(spark), f"{tmp_path}/n", "P"), f"{tmp_path}/e", "R")
    q = "MATCH (a:P)-[r:R]->(b) RETURN a.name AS a, r.w AS w, b.n AS n"
    assert rows(GraphSession(spark, g).cypher(q)) == [("x", 0.5, 2)]
    graph_files.backup(g, f"{tmp_path}/copy")
    assert rows(GraphSession(spark, graph_files.restore(spark, f"{tmp_path}/copy")).cypher(q)) == [("x", 0.5, 2)]
    g = graph_files.merge_nodes(g, "P", [{"node_id": "0" * 32, "name": "new", "n": 9}])
    g = graph_files.merge_edges(g, "R", [{"src": "0" * 32, "dst": "01" * 16, "w": 2.0}])
    assert rows(GraphSession(spark, g).cypher(q)) == [("new", 2.0, 2)]
    assert graph_files.out_edges(g, "0" * 32).count() == 1 and graph_files.in_edges(g, "0" * 32).count() == 0
    gone = graph_files.remove_nodes(g, spark.createDataFrame([("0" * 32,)], "id string"))
    assert rows(GraphSession(spark, gone).cypher("MATCH (a:P) RETURN count(*) AS n")) == [(1,)]
    spark.createDataFrame([("q", 1)], "node_id string, v int").createOrReplaceTempView("mem")
    assert graph_files.load_nodes(Catalog(spark), "memory://mem", "M").scan(("M",)).count() == 1
    spark.createDataFrame([("q", 1)], "node_id string, v int").write.csv(f"{tmp_path}/c", header=True)
    assert graph_files.load_nodes(Catalog(spark), f"{tmp_path}/c", "C", "csv", header=True, inferSchema=True).scan(("C",)).first().v == 1


def test_the_rest_does_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['weft.' + 'llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_vault_helpers(spark, rows):
    from weft.sources.vault import backlinks, orphans, vault_diff

    notes = spark.createDataFrame(NOTES, "vault string, path string, text string")
    g = vault_graph(notes)
    assert rows(backlinks(g, "v/two.md")) == [("v/a/one.md", "LINKS_TO")]
    assert rows(orphans(g)) == [("v/empty.md",)]
    new = spark.createDataFrame([("v", "two.md", "changed"), ("v", "empty.md", ""), ("v", "new.md", "x"), ("w", "two.md", "[[one]]")], notes.schema)
    assert rows(vault_diff(notes, new)) == [("v", "a/one.md", "removed"), ("v", "new.md", "added"), ("v", "two.md", "changed")]
    assert vault_diff(notes, notes).count() == 0 and vault_diff(notes.limit(0), notes.limit(0)).count() == 0
