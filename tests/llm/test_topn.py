import math
from collections import defaultdict

from zonaria.llm import topn

SCHEMA = "fila_id long, cvegeo string, sector_serio string, empleo_total double, puesto int, w int"


def brute(rows, n=5):
    zs, z, mun = defaultdict(float), defaultdict(float), defaultdict(list)
    for _, c, s, e in {r[0]: r for r in rows}.values():
        if c is None:
            continue
        w = e if e is not None and math.isfinite(e) and e >= 0 else 0.0
        z[c] += w
        k = (s or "").strip().upper().removesuffix(".0")
        if k:
            zs[c, k] += w
    out, best = set(), {}
    for (c, s), w in zs.items():
        best[c] = min(best.get(c, (math.inf, "")), (-w, s))
    out |= {("sector_dominante", c, 1, s) for c, (_, s) in best.items()}
    for c, w in z.items():
        mun[c[:5]].append((-w, c))
    for g, l in mun.items():
        out |= {("agebs_principales", g, k, c) for k, (_, c) in enumerate(sorted(l)[:n], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_leaders(spark):
    rows = [(i, f"01001{i % 9:08d}", f"S{i % 4}", float(i % 3)) for i in range(400)]
    rows += [(500 + i, f"02002{i % 3:08d}", None if i % 2 else " s1.0", [None, math.nan, math.inf, -5.0, 0.0][i % 5]) for i in range(40)]
    rows += [(600, None, "S1", 9.0), (601, "03", "S1", 1.0), (602, "03", "S0", 1.0), (603, "0300", None, 1e25), (604, "0300", "S9", 0.1), (605, "0300", "S8", 0.1)]
    rows += rows[:50]
    got = [tuple(r) for r in topn.leaders(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_sums_do_not_depend_on_order(spark):
    a = [(i, "A", "X", v) for i, v in enumerate([0.1] * 10 + [0.7])]
    b = [(100 + i, "A", "W", v) for i, v in enumerate([0.7] + [0.1] * 10)]
    assert ("sector_dominante", "A", 1, "W") in {tuple(r) for r in topn.leaders(frame(spark, a + b)).collect()}


def test_weights_of_any_size(spark):
    """Ten rows of 5e23 outweigh one of 1e24, and totals of huge weights are exact."""
    rows = [(k, "01001A", "S2", 5e23) for k in range(10)] + [(10, "01001A", "S1", 1e24)]
    rows += [(20, "01001B", "S1", 1e300), (21, "01001B", "S2", 1e300), (22, "01001B", "S2", 0.1), (23, "01001B", "S3", 9e299)]
    rows += [(30, "01001C", "S1", 1e25), (31, "01001C", "S2", 5e24), (32, "01001C", "S2", 5e24), (33, "01001C", None, 1e308)]
    rows += [(40, "01001D", "S9", 1.7e308), (41, "01001D", "S9", 1.7e308), (42, "01001E", "S9", 1.7e308), (43, "01001E", "S8", 3.0)]
    got = {tuple(r) for r in topn.leaders(frame(spark, rows)).collect()}
    assert {(g, e) for l, g, _, e in got if l == "sector_dominante"} == {("01001A", "S2"), ("01001B", "S2"), ("01001C", "S1"), ("01001D", "S9"), ("01001E", "S9")}
    assert [e for _, _, _, e in sorted(r for r in got if r[0] == "agebs_principales")] == ["01001D", "01001E", "01001C", "01001B", "01001A"]


def test_empty(spark):
    assert topn.leaders(frame(spark, [])).count() == 0


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as item", "id % 7 as score").unionAll(spark.sql("select null, null, null"))
    got = topn.top_n(df, "g", "item", ["score desc nulls last", "item"], 2)
    assert got.count() == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
