import random

import numpy as np

from zonaria.llm import stuffing as S

DOCS = "doc_id long, text string, coleccion string, f int, _k int, p double"
NOUNS = "graph flow lattice sensor cluster kernel sheaf market wage photon prior tensor".split()
ADJ = "robust sparse local dual weak smooth linear joint compact exact".split()


def sentence(r):
    return f"The {r.choice(ADJ)} {r.choice(NOUNS)} of the {r.choice(NOUNS)} is {r.choice(ADJ)} when a {r.choice(NOUNS)} follows it."


def prose(r, n):
    return "\n\n".join(" ".join(sentence(r) for _ in range(3)) for _ in range(n // 36 + 1))


def keywords(r, n):
    ks = [f"{r.choice(ADJ)} {r.choice(NOUNS)}" for _ in range(6)]
    return "\\keywords{" + ", ".join(r.choice(ks) for _ in range(n // 2)) + "}"


def links(r, n):
    return "\\begin{itemize}\n" + "\n".join(f"\\item \\url{{http://{r.choice(NOUNS)}.example/{r.choice(ADJ)}-{r.choice(NOUNS)}/{k}}}" for k in range(n // 6)) + "\n\\end{itemize}"


def tags(r, n):
    return "\n".join(f"{r.choice(ADJ)} {r.choice(NOUNS)} & SKU-{10000 + k} & {k}.99 & \\#sale \\#{r.choice(NOUNS)} \\\\" for k in range(n // 8))


def adverts(r, n):
    ks = [f"{r.choice(ADJ)} {r.choice(NOUNS)}" for _ in range(4)]
    return " ".join(f"{r.choice(['Buy', 'Cheap', 'Best'])} {r.choice(ks)} {r.choice(['free', 'online', 'top'])}." for _ in range(n // 4))


def formulas(r, n):
    return "\n".join(f"\\begin{{equation}}\n x_{{{k}}} = a b c d e + f g h\n\\end{{equation}}" for k in range(n // 9))


def results(r, n):
    return "\\begin{tabular}{lrr}\n" + "\n".join(f"{r.choice(ADJ)} {r.choice(NOUNS)} & {k}.{k} & 0.{k} \\\\" for k in range(n // 6)) + "\n\\end{tabular}"


def references(r, n):
    return "\n".join(f"\\bibitem{{r{k}}} Quorvane. {r.choice(ADJ)} {r.choice(NOUNS)}, {1990 + k % 30}." for k in range(n // 6))


def page(parts):
    return "\\documentclass{article}\n\\begin{document}\n" + "\n\n".join(parts) + "\n\\end{document}\n"


def corpus(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        bad = k % 4 == 0
        kinds = (keywords, links, tags, adverts)
        share = r.uniform(0.65, 0.95) if bad else r.choice([0, 0, r.uniform(0.05, 0.33)])
        size = r.randint(200, 900)
        parts = [prose(r, int(size * (1 - share))), *([r.choice(kinds)(r, int(size * share))] if share else [])]
        if not bad and k % 3 == 0:
            parts = [r.choice((formulas, results, references))(r, size), prose(r, size // 3)]
        r.shuffle(parts)
        out.append((k, page(parts), f"h{k % 7}", bad))
    return out


def test_held_out_accuracy(spark):
    pages = corpus(11, 240)
    df = spark.createDataFrame([(k, t, h, 1, 2, 0.5) for k, t, h, _ in pages], DOCS)
    got = {r["doc_id"] for r in S.stuffed(df).collect()}
    want = {k for k, _, _, bad in pages if bad}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(pages)
    shown = {r["doc_id"]: r for r in S.scores(df).collect()}
    assert len(shown) == len(pages) and all(0 <= r["puntaje"] <= 1 for r in shown.values())


def middling(seed, n):
    """Pages whose planted spam makes up 40 to 60 % of the words, and the part."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        share, size = r.choice([r.uniform(0.40, 0.46), r.uniform(0.54, 0.60)]), r.randint(300, 900)
        parts = [prose(r, int(size * (1 - share))), r.choice((keywords, links, tags, adverts))(r, int(size * share))]
        r.shuffle(parts)
        out.append(page(parts))
    return out


def fitted(pages, share, blends):
    x = np.array([S.features(t) for t in pages])
    more, more_share = S.blended(x, share, blends)
    label = S.weak_label(np.concatenate([share, more_share]))
    return S.train(np.vstack([x, more])[label >= 0], label[label >= 0].astype(float))[0]


def test_trees_use_several_features_and_find_mixed_pages():
    pages = [t for _, t, _, _ in corpus(12, 400)]
    model = fitted(pages, np.array([S.spam_share(t) for t in pages]), 200)
    used = {k for t in model for k in t.feature if k >= 0}
    assert len({t.feature[0] for t in model}) >= 3 and len(used) >= 6
    held = middling(13, 200)
    truth = np.array([S.spam_share(t) > 0.5 for t in held])
    p = np.mean([t.score(np.array([S.features(t_) for t_ in held])) for t in model], axis=0)
    assert 0.25 < truth.mean() < 0.75
    assert (p[truth] >= S.CANDIDATE).mean() >= 0.9  # the exact count that follows drops the others
    assert ((p > 0.5) == truth).mean() > 0.6


def test_hosts_move_pages_when_they_tell_something(spark):
    """Half of the hosts hold spam; a page the trees leave open goes with its host."""
    rng = np.random.default_rng(3)
    y = (np.arange(4000) % 2).astype(float)
    odds = rng.normal(2 * y - 1, 2.0)
    shift = np.where(rng.random(4000) < 0.9, 2 * y - 1, 1 - 2 * y) * S.HOST_LIMIT
    w = S.host_weight(odds, shift, y)
    assert w > 0.5
    alone, smoothed = ((odds > 0) == y).mean(), ((odds + w * shift > 0) == y).mean()
    assert smoothed > alone + 0.05 and ((odds > 0) != (odds + w * shift > 0)).sum() > 200
    assert S.host_weight(odds, rng.permutation(shift), y) < 0.1
    assert S.host_weight(odds[:0], shift[:0], y[:0]) == 0.0


def test_scores_follow_the_host(spark):
    """The same clean page scores higher in a host of spam than in a clean one, when hosts differ in the sample."""
    r = random.Random(17)
    doubtful = [page([prose(r, 250), keywords(r, 250)]) for _ in range(40)]
    rows = [(k, page([keywords(r, 500), prose(r, 60)] if k % 2 else [prose(r, 500)]), "malo" if k % 2 else "bueno", 1, 2, 0.5) for k in range(200)]
    rows += [(1000 + k, t, "malo" if k % 2 else "bueno", 1, 2, 0.5) for k, t in enumerate(doubtful)]
    d = {x["doc_id"]: x for x in S.scores(spark.createDataFrame(rows, DOCS)).collect()}
    assert d[1]["anfitrion"] > 0.5 > d[0]["anfitrion"]
    moved = [(d[1000 + k]["puntaje"] - d[1000 + k]["propio"], k % 2) for k in range(40)]
    assert all(m >= -0.01 for m, bad in moved if bad) and all(m <= 0.01 for m, bad in moved if not bad)


def test_trees_learn_on_held_out_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 1] > 0.2) ^ (x[:, 4] > 0.5)).astype(float)
    model, bagged = S.train(x[:3000], y[:3000])
    assert ((bagged > 0.5) == y[:3000]).mean() > 0.9
    p = np.mean([t.score(x[3000:]) for t in model], axis=0)
    assert ((p > 0.5) == y[3000:]).mean() > 0.93


def test_body_and_units():
    assert S.body("a\\begin{document}b\\end{document}c") == "b" and S.body("frag") == "frag"
    assert S.features(None) == S.features("") == S.features("\\begin{document}\\end{document}") == [0.0] * len(S.FEATURES)
    assert S.spam_share(None) == S.spam_share("") == 0.0
    kinds = [k for k, _ in S.units("The flow is weak.\n\\begin{align}\n a &= b \\\\\n\\end{align}\nsparse flow & 1.0 & 2.0 \\\\\n\\bibitem{a} X. Weak flow, 2001.\nwww.a.example/b")]
    assert kinds == ["prosa", "formula", "formula", "formula", "tabla", "cita", "enlace"]


def test_long_texts_stay_linear():
    for t in ("$" * 300_000, "\\[" * 200_000, "\\begin{" * 100_000, "word " * 300_000, "#" * 300_000, "& " * 200_000, "a. " * 200_000):
        assert len(S.features(t)) == len(S.FEATURES) and 0 <= S.spam_share(t) <= 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, 1, 2, 0.1), (2, "", "h", 1, 2, 0.1), (2, "", "h", 1, 2, 0.1), (3, "The flow is weak.", None, 1, 2, 0.1)], DOCS)
    assert S.stuffed(df).count() == 0 and S.scores(df).count() == 4
    assert S.stuffed(df.limit(0)).count() == 0
