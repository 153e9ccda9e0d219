import random

import pytest

from weft.llm.mixture import Mixture, count_tokens, source_key

DOCS = "doc_id long, text string, source string"


def frame(spark, seed=1):
    rng = random.Random(seed)
    data, n = [], 0
    for source, k, spell in (("notes", 1500, ["notes", "Notes", " NOTES "]), ("chat_log", 400, ["chat_log", "chat-log", "Chat Log"]), ("wiki", 60, ["wiki"])):
        for _ in range(k):
            data.append((n, "word number seven " * rng.randint(1, 60), rng.choice(spell)))
            n += 1
    data += [(n, None, "notes"), (n + 1, "", "notes"), (n + 2, "text", None), (n + 3, "text", "other"), (None, "some words here", "notes")]
    return spark.createDataFrame(data, DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    m = Mixture(frame(spark), targets(spark, [("notes", 0.5, 1), ("chat_log", 0.3, 2), ("wiki", 0.2, 5)]))
    got = {r.source_name: r for r in m.report().collect()}
    for s, want, cap in (("notes", 0.5, 1), ("chat_log", 0.3, 2), ("wiki", 0.2, 5)):
        assert got[s].actual_share == pytest.approx(want, abs=0.01) and got[s].most_copies <= cap
    rows = m.drawn().collect()
    assert all(abs(r.copies - r.rate) < 1 + 1e-9 for r in rows)
    assert {r.source_name for r in rows} == {"notes", "chat_log", "wiki"}
    again = Mixture(frame(spark), targets(spark, [("notes", 0.5, 1), ("chat_log", 0.3, 2), ("wiki", 0.2, 5)])).drawn()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in again.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in rows)


def test_token_constraints_are_met_before_rounding(spark):
    m = Mixture(frame(spark, 2), targets(spark, [("notes", 0.7, 1), ("chat_log", 0.2, 1), ("wiki", 0.1, 3)]))
    mass = {}
    for r in m.drawn().collect():
        mass[r.source_name] = mass.get(r.source_name, 0) + r.rate * r.tokens
    whole = sum(mass.values())
    assert {s: x / whole for s, x in mass.items()} == pytest.approx({"notes": 0.7, "chat_log": 0.2, "wiki": 0.1}, abs=1e-6)


def test_missing_null_and_repeated_targets(spark):
    m = Mixture(frame(spark), targets(spark, [("notes", 0.5, None), ("nowhere", 0.5, 1), (None, 0.1, 1), ("wiki", None, 1), ("Notes", 0.5, 1)]))
    got = {r.source_name: r.actual_share for r in m.report().collect()}
    assert got == {"notes": 1.0, "nowhere": 0.0, "wiki": 0.0}


def test_empty(spark):
    t = targets(spark, [("notes", 1.0, 1)])
    assert [r.tokens for r in Mixture(frame(spark).limit(0), t).report().collect()] == [0]
    m = Mixture(frame(spark), targets(spark, []))
    assert m.report().count() == 0 and m.drawn().count() == 0


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hello world", "a"), (4, "x" * 200_000, "a"), (5, "<|endoftext|>", "a")], DOCS).selectExpr("*", "1 AS tokens")
    got = {r.doc_id: r.tokens for r in count_tokens(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1000 and got[5] > 1


def test_source_names(spark):
    df = spark.createDataFrame([(" Vault-Note ",), ("VAULT_NOTE",), ("vault  note",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(source_key(df.s)).collect()] == ["vault_note"] * 3 + [None, ""]
