import math
from collections import Counter, defaultdict

from zonaria.operators import skew

SCHEMA = "fila_id long, sector_serio string, empleo_total double, nombre string, n int"


def test_totals_match_and_hot_keys_are_split(spark):
    rows = [(i, "sec005 " if i % 3 else "SEC005.0", 1.5) for i in range(700)] + [(1000 + i, f"S{i % 37}", float(i)) for i in range(300)]
    rows += [(2000, None, 5.0), (2001, " ", None), (2002, "S1", math.nan), (2003, "S1", -4.0), (2004, "S1", math.inf)]
    rows += rows[:100]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    names = spark.createDataFrame([("SEC005", "b"), ("sec005", "a"), ("S1", "uno"), ("X", "sin filas"), (None, "nada")], "scian string, nombre string")
    got = {r["sector_serio"]: r for r in skew.sector_totals(df, names, tasks=7).collect()}
    want_n, want_e = Counter(), defaultdict(float)
    for i, s, e in {r[0]: r for r in rows}.values():
        k = (s or "").strip().upper().removesuffix(".0") or None
        want_n[k] += 1
        want_e[k] += e if e is not None and math.isfinite(e) and e >= 0 else 0.0
    assert {k: r["filas"] for k, r in got.items()} == want_n
    assert {k: r["empleo_total"] for k, r in got.items()} == want_e
    assert got["SEC005"]["nombre"] == "a" and got["S1"]["nombre"] == "uno" and got["S2"]["nombre"] is None
    assert [r[0] for r in skew.dominant_sectors(df, names, tasks=3).collect()] == ["SEC005"]


def test_no_task_holds_much_more_than_its_share(spark):
    df = spark.range(20_000).selectExpr("id as fila_id", "case when id % 10 < 6 then 'HOT' else concat('K', id % 997) end as k")
    loads = df.groupBy("k").count()
    p = skew.plan(loads, "k", "count", 8)
    assert len(set(p.heavy["HOT"])) >= 5
    sizes = [r["count"] for r in skew.fragment(p, df, "k", "fila_id").groupBy("_slot").count().collect()]
    assert max(sizes) < 1.35 * 20_000 / 8
    copies = skew.replicate(p, spark.createDataFrame([("HOT",), ("K1",)], "k string"), "k").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in copies} == {"HOT": len(set(p.heavy["HOT"])), "K1": 1}


def test_edges(spark):
    names = spark.createDataFrame([], "scian string, nombre string")
    empty = spark.createDataFrame([], SCHEMA)
    assert skew.sector_totals(empty, names).count() == 0
    five = spark.createDataFrame([(i, "A" if i < 1 else f"B{i}", 0.0, "", 0) for i in range(20)], SCHEMA)
    assert skew.dominant_sectors(five, names).count() == 20  # 1 of 20 is 5 %
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], SCHEMA)
    assert [tuple(r)[:1] for r in skew.sector_totals(nulls, names).collect()] == [(None,)]


def test_a_hot_null_key_is_split(spark):
    """Rows without key that own a third of all are weighed and sharded like any other key."""
    df = spark.range(12_000).selectExpr("id as fila_id", "case when id % 3 > 0 then concat('K', id % 997) end as k")
    p = skew.plan(df.groupBy("k").count(), "k", "count", 8)
    assert len(set(p.heavy[""])) >= 2
    sizes = [r["count"] for r in skew.fragment(p, df, "k", "fila_id").groupBy("_slot").count().collect()]
    assert max(sizes) < 1.5 * 12_000 / 8
    assert skew.fragment(p, df, "k", "fila_id").filter("k is null").count() == 4000
