import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonaria.llm import mixture as M

DOCS = "doc_id long, source string, text string, copia int, tasa double, n_tokens int, _s string"
GOAL = "source string, peso_objetivo double, tope_repeticion int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3, "x") for r in rows], DOCS)


def test_water_filling():
    r = {s.source: s for s in M.rates({"a": 1000, "b": 100, "c": 10}, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 5), ("d", 0.1, 3)])}
    assert r["c"].rate == 5 and r["d"].rate == 0
    assert r["a"].rate * 1000 / (r["b"].rate * 100) == pytest.approx(0.5 / 0.3) or r["b"].rate == 4
    assert sum(x.rate * x.tokens for x in r.values()) == pytest.approx(1110)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), st.integers(0, 1000)), min_size=1, max_size=6))
def test_rates_hold_their_bounds(items):
    targets = [(f"s{k}", w, c) for k, (w, c, _) in enumerate(items)]
    have = {f"s{k}": t for k, (_, _, t) in enumerate(items)}
    got = M.rates(have, targets)
    assert all(0 <= g.rate <= g.cap * (1 + 1e-9) for g in got)
    total = sum(g.rate * g.tokens for g in got)
    live = [g for g in got if g.weight > 0 and g.cap > 0 and g.tokens > 0]
    room = sum(g.cap * g.tokens for g in live)
    assert total == pytest.approx(min(room, sum(have.values())), rel=1e-6, abs=1e-6)
    free = [g for g in live if g.rate < g.cap * (1 - 1e-9)]
    assert len({round(g.rate * g.tokens / g.weight / max(total, 1), 6) for g in free if g.weight > 1e-3}) <= 1


def test_mix_and_shares(spark):
    rng = np.random.default_rng(3)
    rows = [(k, ["a", "a", "a", "a", "b", "c"][k % 6], " ".join(["palabra"] * int(rng.integers(1, 60)))) for k in range(3000)]
    rows += [(5000, None, "sin fuente"), (5001, "otra", "sin meta"), (5002, "a", None), (5003, "a", "")]
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("d", 0.05, 9), (None, 0.1, 1)], GOAL)
    docs = frame(spark, rows)
    got = {r["source"]: r for r in M.shares_reached(docs, goal).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["d"]["tokens_mezcla"] == 0
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert got[s]["proporcion"] == pytest.approx(w / 0.95, abs=0.02) and got[s]["tasa"] <= got[s]["tope_repeticion"]
    mixed = M.mixed(docs, goal)
    assert mixed.columns == ["doc_id", "source", "text", "tasa", "n_tokens", "_s", "copia"]
    n = {(r["source"], r["doc_id"]): r["count"] for r in mixed.groupBy("source", "doc_id").count().collect()}
    assert {s for s, _ in n} <= {"a", "b", "c"}
    assert all(int(np.floor(got[s]["tasa"])) <= k <= int(np.ceil(got[s]["tasa"])) for (s, _), k in n.items())
    sizes = {r["doc_id"]: r["n_tokens"] for r in M.token_counts(docs).collect()}
    assert sum(k * sizes[d] for (s, d), k in n.items() if s == "b") == got["b"]["tokens_mezcla"]
    assert {tuple(r) for r in M.mixed(docs, goal).select("doc_id", "copia").collect()} == {tuple(r) for r in mixed.select("doc_id", "copia").collect()}


def test_exact_shares(spark):
    """The exact mix meets every weight of the sources there are; its size follows from the scarcest."""
    have, goal = {"a": 1000, "b": 100, "c": 10}, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 5), ("d", 0.1, 3)]
    total = M.uncapped_total(have, goal)
    assert total == pytest.approx(250)
    got = {s.source: s.rate * s.tokens for s in M.rates(have, goal, total)}
    assert got == pytest.approx({"a": 125, "b": 75, "c": 50, "d": 0})
    assert M.uncapped_total({}, goal) == 0.0 and all(s.rate == 0 for s in M.rates({}, goal, 0.0))
    docs = frame(spark, [(k, "abc"[k % 3], "palabra " * 20) for k in range(3000)])
    d = {r["source"]: r for r in M.shares_reached(docs, spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1)], GOAL)).collect()}
    assert d["a"]["proporcion_exacta"] == pytest.approx(0.6, abs=0.02) and d["c"]["proporcion_exacta"] == pytest.approx(0.1, abs=0.02)
    assert sum(r["tokens_exactos"] for r in d.values()) < sum(r["tokens_mezcla"] for r in d.values())


def test_tokens_of_odd_texts(spark):
    enc = M.encoder(open(M.vocabulary_path(), "rb").read())
    for t in (" " * 30_000 + "abc def", "x" + " " * 20_000 + "\n" * 3000 + "y", "a " + "\t" * 12_000, "plain <|endoftext|> text"):
        assert M.count_tokens(t, enc) == len(enc.encode_ordinary(t))
    assert M.count_tokens(" " * 1_000_000 + "z", enc) > 0
    docs = frame(spark, [(1, "a", "z" * 300_000), (2, "a", " " * 300_000)])
    assert all(r["n_tokens"] > 0 for r in M.token_counts(docs).collect())


def test_empty(spark):
    docs, goal = frame(spark, [(1, "a", "uno")]), spark.createDataFrame([("a", 1.0, 1)], GOAL)
    assert M.mixed(docs.limit(0), goal).count() == 0 and M.mixed(docs, goal.limit(0)).count() == 0
    assert M.shares_reached(docs, goal.limit(0)).count() == 0
    assert [r["tokens_mezcla"] for r in M.shares_reached(docs.limit(0), goal).collect()] == [0]
    assert M.mixed(docs, spark.createDataFrame([("a", None, None)], GOAL)).count() == 0
