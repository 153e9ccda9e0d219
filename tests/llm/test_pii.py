import random

import pytest

from weft.llm import pii as P

FIRST = "Marit Otto Nuria Teodor Vesna Imre Paloma Hanno Elio Saskia".split()
LAST = [a + b for a in ("Gald", "Vel", "Nor", "Kel", "Bris", "Tol") for b in ("quist", "rell", "vane", "zund", "tano")]
CUES = ["Reported by {}.", "Thanks to {} for the patch.", "owner: {}", "Signed-off-by: {}", "Assigned to {} since Monday.", "Ask Dr. {} before you merge."]
FILLER = ["The Planner reads every page twice.", "On Copper Ledger the same query returns 40 rows.", "Release 2.3.1 changed how the Loader drops notes.", "My first guess was a missing check."]


def person(rng):
    f, s = rng.choice(FIRST), rng.choice(LAST)
    return rng.choice([f"{f} {s}", f"{f[0]}. {s}", f"{s}, {f}", f"{f} {rng.choice(LAST)}-{s}", f"{f} {f[0]}. {s}"])


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        names = [person(rng) for _ in range(2)]
        lines = [rng.choice(CUES).format(names[0]), rng.choice(FILLER), f"{names[1]} looked at it first.", rng.choice(FILLER)]
        rng.shuffle(lines)
        out.append(("\n".join(lines), set(names)))
    return out


@pytest.fixture(scope="module")
def field():
    return P.Field().fit([t for t, _ in corpus(600, 1)])


def test_names_on_held_out_texts(field):
    hit = want = given = 0
    for text, names in corpus(200, 99):
        got = {text[a:b] for a, b, k in P.find(text, field) if k == "name"}
        hit += len(got & names)
        want += len(names)
        given += len(got)
    assert hit / want > 0.93 and hit / given > 0.93


def test_a_name_without_cue_is_helped_by_its_repetition(field):
    text = "Reported by Marit Galdquist.\n\nmarit galdquist\n"
    assert [text[a:b] for a, b, k in P.find(text, field) if k == "name"][0] == "Marit Galdquist"


FORMS = [
    ("email", "a.b+c@mail.harbor.test"), ("email", "ana (at) post.example"), ("email", "ana[at]post[dot]example"), ("email", "ana at post dot example"), ("email", "ANA @ POST.EXAMPLE"),
    ("phone", "+44 (0)20 7946 0874"), ("phone", "(646) 555-0125 ext. 7"), ("phone", "+13125550147"), ("phone", "001 718 555 0171"), ("phone", "1‑202‑555‑0116"), ("phone", "030 / 23125-904"), ("phone", "0034-555-307-218"), ("phone", "01632 960 650"),
    ("national_id", "000-12-3456"), ("national_id", "QQ 12 34 56 C"), ("national_id", "X-9994467-F"), ("national_id", "99.908.355-P"), ("national_id", "00 549 843 333"), ("national_id", "ZZ9995736"),
    ("address", "Unit 36, 121 Foxglove Court"), ("address", "105 Old Quarry Ct., Apt 1C".replace("Ct.", "Court")), ("address", "24 Copperwell Terrace #12"), ("address", "C/ Puerta Nueva 228, 1º D"), ("address", "Plaza Olmo Gris n.º 64"), ("address", "Brunnenstraße 185b"), ("address", "Am Alten Speicher 4"),
]


@pytest.mark.parametrize("kind,form", FORMS)
def test_fixed_forms(kind, form):
    text = f"Before: {form}, and after."
    assert (kind, form) in [(k, text[a:b]) for a, b, k in P.find(text, P.Field())]


@pytest.mark.parametrize("text", ["host=10.0.0.7 port=7687", "Order 4155550 rows", "created 1700000000123 now", "lsn=202555014 lease=41", "Range 1632-9601 holds", "2024-03-07T11:22:34Z", "12 Lane detectors", "graph-tools@0.14.2", "Ping @oncall", "issue 555-01 and build 2024.10.31", "1881 Road segments"])
def test_look_alikes(text):
    assert P.find(text, P.Field()) == []


def test_operator_and_placeholders(spark, field):
    text = "cc Otto Velvane\nMail ana@post.example or call +44 1632 960580.\nHome: 12 Old Quarry Way."
    data = [(1, text), (1, text), (2, None), (3, ""), (None, "id: 000-12-3456"), (4, "plain " * 50_000 + "x@y.example")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'k' AS pii_kind")
    got = {tuple(r) for r in P.find_pii(df, field).collect()}
    assert got == {(1, "name", "Otto Velvane"), (1, "email", "ana@post.example"), (1, "phone", "+44 1632 960580"), (1, "address", "12 Old Quarry Way"), (None, "national_id", "000-12-3456"), (4, "email", "x@y.example")}
    out = {r.doc_id: r.text for r in P.redact(df, field).collect()}
    assert out[1] == "cc [NAME]\nMail [EMAIL] or call [PHONE].\nHome: [ADDRESS]."
    assert out[2] is None and out[3] == "" and out[4].endswith("plain [EMAIL]")
    assert P.redact(df, field).count() == len(data)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.find_pii(df).count() == 0 and P.redact(df).count() == 0


def test_very_repetitive_text_is_linear(field):
    text = "Marit Galdquist " * 3000
    assert P.find(text, field)


def test_candidates_exclude_and_support_each_other():
    f = P.Field()
    assert f.spans("00 549 843 333") == [(0, 14, "national_id")]
    text = "SSN 123456789 is on file.\nLater 123456789 was read again."
    alone = P.Field()
    alone.span_skip = 0.0
    assert [a for a, _, _ in alone.spans(text)] == [4]
    f.span_skip = 8.0
    assert [a for a, _, _ in f.spans(text)] == [4, 32]


def test_context_is_learned_for_candidates():
    f = P.Field()
    f.fit_spans([P.Read.of(f"Call ({n}) 555-0{n} when it stops.") for n in range(200, 400)])
    assert f.spans("Call (646) 555-0125 when it stops.") == [(5, 19, "phone")]


def test_chain_and_skip_potentials_find_names_of_unknown_words():
    import copy
    import random

    from weft.llm.pii import Field, find

    rng = random.Random(4)
    firsts, lasts = ["Anna", "Bruno", "Carla", "Dario", "Elena", "Fabian"], ["Holberg", "Marston", "Quint", "Rosdal", "Tarland", "Vesper"]
    filler = ["the cache was cold again", "we read every page twice", "nothing broke on the way", "Indexes were slow after lunch", "Pages stay open for a day"]
    train = []
    for i in range(400):
        f, s = rng.choice(firsts), rng.choice(lasts)
        cue = rng.choice([f"Signed-off-by: {f} {s}\n", f"Thanks to {f} {s} for the note.", f"Owner: {f} {s}\n", f"It was {f} {s} who found it."])
        train.append(". ".join(rng.sample(filler, 3)) + ".\n" + cue)
    held_f, held_s = ["Ysolde", "Ragnar", "Oktavia"], ["Brimsel", "Korvath", "Wexlund"]
    texts, truth = [], []
    for f in held_f:
        for s in held_s:
            text = f"{rng.choice(filler)}.\nSigned-off-by: {f} {s}\n{rng.choice(filler)}. Over at the desk {f} {s} keeps notes."
            texts.append(text)
            truth.append({(m, m + len(f"{f} {s}")) for m in (text.find(f"{f} {s}"), text.rfind(f"{f} {s}"))})
    field = Field().fit(train)

    def recall(skip, chain):
        other = copy.deepcopy(field)
        other.skip *= skip
        other.chain *= chain
        return sum(len({(a, b) for a, b, k in find(t, other) if k == "name"} & want) for t, want in zip(texts, truth)) / sum(map(len, truth))

    got = {(s, c): recall(s, c) for s in (0, 1) for c in (0, 1)}
    print(got)
    assert got[1, 1] > got[0, 1] and got[1, 1] > got[1, 0]
