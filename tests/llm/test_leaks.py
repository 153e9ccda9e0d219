import random

from weft.llm import leaks as L

ITEM = "Suppose the rival ferries of Yllstad compete with exactly 351 orreries at low tide while none of the workshops illuminate"


def brute(text, item, n=10):
    a, b = L.words(text), L.words(item)
    return bool({tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})


def run(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "9 AS eval_id")
    evals = spark.createDataFrame(items, "eval_id long, eval_text string")
    return {tuple(r) for r in L.find_leaks(docs, evals).collect()}


def test_altered_writing(spark):
    ten = " ".join(ITEM.split()[3:13])
    texts = [
        f"x {ten} y", ten.upper(), ten.replace(" ", " \n- "), ten.replace("e", "é"), "".join(c + "́" if c == "a" else c for c in ten), " ".join(ten.split()[:9]),
        " ".join(reversed(ten.split())), ten.replace("with", "within"), None, "", "« " + ten.replace(" ", " … ") + " »", "word " * 20_000 + ten,
    ]
    assert run(spark, texts, [(7, ITEM)]) == {(i, 7) for i in (0, 1, 2, 3, 4, 10, 11)}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(vocabulary, k=14))) for i in range(12)]
    texts = []
    for _ in range(60):
        body = rng.choices(vocabulary, k=30)
        if rng.random() < 0.5:
            w = rng.choice(items)[1].split()
            a = rng.randrange(5)
            body[10:20] = w[a : a + rng.choice([9, 10])]
        texts.append(" ".join(body))
    want = {(i, e) for i, t in enumerate(texts) for e, x in items if brute(t, x)}
    assert run(spark, texts, items) == want and want


def test_shared_short_and_null_items(spark):
    items = [(1, ITEM), (2, ITEM), (2, ITEM), (3, "too short"), (4, None), (None, ITEM)]
    assert run(spark, [ITEM], items) == {(0, 1), (0, 2)}


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == set()
    assert run(spark, [ITEM], []) == set()


def test_passes(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_WINDOWS", 10)
    other = ITEM.replace("ferries", "mills")
    assert run(spark, [ITEM, other], [(1, ITEM), (2, other)]) >= {(0, 1), (1, 2)}
