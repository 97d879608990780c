import re

from hypothesis import given, settings
from hypothesis import strategies as st

from zonaria.llm import leakage as L

DOCS = "doc_id long, text string, item_id int, ventanas int"
ITEMS = "item_id long, text string, conjunto string"


def brute(docs, items, n=12):
    word = re.compile(r"\\[^\W\d_]+|([^\W_]+)")
    grams = {}
    for i, t in items:
        w = [x for x in word.findall((t or "").lower()) if x]
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x for x in word.findall((t or "").lower()) if x]
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 4))
def test_automaton_against_ngrams(items, stream, n):
    a = L.Automaton(list(enumerate(items)), n)
    grams = {i: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for i, t in enumerate(items)}
    want = {}
    for k in range(len(stream) - n + 1):
        for i, g in grams.items():
            if tuple(stream[k : k + n]) in g:
                want[i] = want.get(i, 0) + 1
    found, spans = a.leaks(stream)
    assert {i: f[0] for i, f in found.items()} == want
    inside = {j for s, e in spans for j in range(s, e + 1)}
    assert inside == {j for k in range(len(stream) - n + 1) if any(tuple(stream[k : k + n]) in g for g in grams.values()) for j in range(k, k + n)}
    longest = {i: m for i, m, _ in a.positions(stream)}
    subs = {tuple(t[i:j]) for t in items for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, m in longest.items():
        assert tuple(stream[i - m + 1 : i + 1]) in subs and tuple(stream[i - m : i + 1]) not in subs or i - m < 0


TEXT = "Uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce."
CASES = [
    (1, TEXT), (2, "% comentado \\emph{UNO dos, tres} cuatro--cinco_seis\\alpha siete\nocho nueve $diez$ once doce"),
    (3, "dos tres cuatro cinco seis siete ocho nueve diez once doce"), (4, None), (5, ""), (6, "x " * 200_000 + TEXT + " y" * 200_000), (1, TEXT), (7, TEXT.replace("siete", "7")),
]
ITEMS_ = [(1, TEXT), (2, TEXT.lower() + " quince"), (3, "corto"), (4, None), (5, TEXT)]


def frames(spark):
    return spark.createDataFrame([(*c, 1, 2) for c in CASES], DOCS), spark.createDataFrame([(*i, "c") for i in ITEMS_], ITEMS)


def test_found(spark, monkeypatch):
    docs, items = frames(spark)
    want = brute(CASES, ITEMS_)
    assert {(d, i) for d in (1, 2, 6) for i in (1, 2, 5)} == want
    got = L.leaks(docs, items)
    assert {tuple(r)[:2] for r in got.collect()} == want
    assert {r["tramo"] for r in got.filter("doc_id = 1").collect()} == {14} and {r["ventanas"] for r in got.filter("doc_id = 2").collect()} == {1}
    monkeypatch.setattr(L, "BLOCK_WORDS", 15)
    assert {tuple(r)[:2] for r in L.leaks(docs, items).collect()} == want
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_cleaned(spark):
    docs, items = frames(spark)
    extra = spark.createDataFrame([(9, "A partir de aquí hay texto propio y luego " + TEXT + " Y más texto propio que no sale de ninguna parte ni de nadie", 1, 2)], DOCS)
    got = {r["doc_id"]: r["text"] for r in L.cleaned(docs.unionByName(extra), items).collect()}
    assert 1 not in got and 2 not in got
    assert got[4] is None and got[5] == "" and got[3] == CASES[2][1] and got[7] == CASES[7][1]
    assert got[9] == "A partir de aquí hay texto propio y luego . Y más texto propio que no sale de ninguna parte ni de nadie"
    assert got[6] == "x " * 200_000 + "." + " y" * 200_000


def test_cleaned_does_not_depend_on_the_blocks(spark, monkeypatch):
    """30 % leaked from one block and 30 % from another are more than half; overlapping passages are cut once."""
    other = "alfa beta gama delta épsilon zeta eta theta iota kappa lambda mi ni xi"
    own = " ".join(f"propia{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"{TEXT} {own} {other}"), (2, f"{TEXT} {own} {own}"), (2, own), (None, f"{own} {other} {own}"), (4, None), (5, f"{own} {TEXT} quince dieciséis {own} {own}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, TEXT), (2, other), (3, " ".join(TEXT.split()[2:]) + " quince dieciséis")], "item_id long, text string")
    key = lambda r: (str(r[0]), str(r[1]))
    one = sorted((tuple(r) for r in L.cleaned(docs, items).collect()), key=key)
    monkeypatch.setattr(L, "BLOCK_WORDS", 14)
    assert sorted((tuple(r) for r in L.cleaned(docs, items).collect()), key=key) == one
    assert [r[0] for r in one] == [2, 2, 4, 5, None] and "trece" not in str(one) and "dieciséis" not in str(one)


def test_one_automaton_at_a_time(spark, monkeypatch):
    """Of many blocks, each is written and let go before the next is built."""
    monkeypatch.setattr(L, "BLOCK_WORDS", 12)
    alive = []

    build = L.Automaton.__init__
    monkeypatch.setattr(L.Automaton, "__init__", lambda self, *a: (build(self, *a), alive.append(1))[0])
    destroyed = []
    real = L.Broadcast.destroy
    monkeypatch.setattr(L.Broadcast, "destroy", lambda self, *a: (destroyed.append(len(alive)), real(self, *a)))
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(4)], "doc_id long, text string")
    assert {tuple(r)[:2] for r in L.leaks(docs, items).collect()} == {(k, k) for k in range(4)}
    assert destroyed == [1, 2, 3, 4, 5, 6]


def test_items_shorter_than_the_default_length(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f"), (8, "a b c d")], "item_id long, text string")
    assert [tuple(r) for r in L.leaks(docs, items, length=5).collect()] == [(1, 7, 2, 6)]
