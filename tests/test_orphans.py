import datetime as dt

import pytest

from zonaria.operators import orphans as O

D = dt.datetime
W = "fila_id long, sector_serio string, periodo string, tabla string, llave int"
X = "fila_id long, scian_codigo string, sector_serio string, vigente_desde timestamp, vigente_hasta timestamp"


def frames(spark, warehouse=(), denue=(), crosswalk=(), sectores=(), scian=()):
    return (
        spark.createDataFrame([(*r, "t", 1) for r in warehouse], W),
        spark.createDataFrame(list(denue), "fila_id long, codigo_act string, periodo string"),
        spark.createDataFrame(list(crosswalk), X),
        spark.createDataFrame(list(sectores), "scian string, vigente_desde timestamp, vigente_hasta timestamp"),
        spark.createDataFrame(list(scian), "scian_codigo string, vigente_desde timestamp, vigente_hasta timestamp"),
    )


def found(fs):
    return sorted((tuple(r) for r in O.orphans(*O.economy(*fs)).collect()), key=str)


SECTORS = [("SEC001", D(2020, 1, 1), None), ("SEC002", D(2021, 3, 1), None), ("SEC003", D(2020, 1, 1), D(2021, 2, 1)), ("SEC004", D(2020, 1, 1), D(2020, 5, 1)), ("SEC004", D(2021, 6, 1), None), (None, None, None)]


def test_motives(spark):
    w = [(1, "sec001.0 ", "2021-02"), (1, "sec001.0 ", "2021-02"), (2, "SEC002", "2021-02"), (2, "SEC002", "2021-02"), (3, "SEC002", "2021-03"), (4, "SEC003", "2021-02"), (5, "SEC003", "2021-01"), (6, "SEC004", "2021-02"), (7, "NADA", "2021-02"), (8, " ", "2021-02"), (9, None, "2021-02"), (10, "NADA", None), (11, "SEC002", "algo")]
    got = found(frames(spark, w, sectores=SECTORS))
    assert {(r[3], r[4]) for r in got} == {(2, "posterior"), (4, "retirada"), (6, "retirada"), (7, "inexistente"), (10, "inexistente")}


def test_all_references(spark):
    c = [(1, "111111", "SEC001", D(2021, 1, 5), None), (2, " 222222", "NADA", D(2021, 2, 5), None), (2, " 222222", "NADA", D(2021, 2, 5), None)]
    s = [("111111", D(2016, 1, 1), None)]
    got = found(frames(spark, denue=[(1, "222222.0", "2021-01"), (2, "222222", "2021-02"), (3, "9", "2021-02")], crosswalk=c, sectores=SECTORS, scian=s))
    assert got == [("crosswalk", "scian_codigo", "2021-02", 2, "inexistente"), ("crosswalk", "sector_serio", "2021-02", 2, "inexistente"), ("denue", "codigo_act", "2021-01", 1, "posterior"), ("denue", "codigo_act", "2021-02", 3, "inexistente")]
    rep = {tuple(r) for r in O.report(*O.economy(*frames(spark, denue=[(3, "9", "2021-02"), (4, "9", "2021-02")], crosswalk=c, sectores=SECTORS, scian=s))).filter("tabla = 'denue'").collect()}
    assert rep == {("denue", "codigo_act", "2021-02", "inexistente", 2)}


def test_empty(spark):
    assert found(frames(spark)) == []
    assert len(found(frames(spark, [(1, "A", "2021-01")]))) == 1


@pytest.mark.parametrize("keys, probe, small", [(7, 3, 0), (1, 1, 0), (10**6, 10**6, 10**6)])
def test_ranges_and_shards_change_nothing(spark, monkeypatch, keys, probe, small):
    w = [(i, f"K{i % 40:03d}", f"2021-{1 + i % 12:02d}") for i in range(300)]
    parents = [(f"K{i:03d}", D(2021, 1 + i % 12, 1), None) for i in range(0, 40, 2)]
    want = found(frames(spark, w, sectores=parents))
    monkeypatch.setattr(O, "RANGE_KEYS", keys)
    monkeypatch.setattr(O, "LEAST_KEYS", keys)
    monkeypatch.setattr(O, "PROBE_KEYS", probe)
    monkeypatch.setattr(O, "SMALL_MISSES", small)
    assert found(frames(spark, w, sectores=parents)) == want and want


def test_a_key_with_many_rows_is_left_with_one_per_month(spark):
    """100 000 rows of force of one key: reduced before they are probed, verdicts as by definition."""
    rows = spark.range(100_000).selectExpr("'A' as scian", "timestamp'2020-01-15' + make_interval(0, cast(id % 24 as int)) + make_interval(0, 0, 0, cast(id % 9 as int)) as vigente_desde", "case when id % 24 < 20 then timestamp'2020-03-01' + make_interval(0, cast(id % 24 as int)) else timestamp'2020-06-01' end as vigente_hasta")
    w, d, c, _, x = frames(spark, [(k, "A", f"20{19 + k // 12:02d}-{1 + k % 12:02d}") for k in range(48)])
    refs, parents = O.economy(w, d, c, rows, x)
    assert O._parent_table(parents).count() == 24
    got = {(r["periodo"], r["motivo"]) for r in O.orphans(refs, parents).collect()}
    facts = [(r[0], r[1]) for r in rows.select("vigente_desde", "vigente_hasta").distinct().collect()]
    want = set()
    for k in range(48):
        y, m = 2019 + k // 12, 1 + k % 12
        a, b = D(y, m, 1), D(y + m // 12, m % 12 + 1, 1)
        begun = [h for s, h in facts if s < b]
        if not any(h > a for h in begun):
            want.add((f"{y}-{m:02d}", "retirada" if begun else "posterior"))
    assert got == want and len(want) > 10


def test_ranges_follow_the_data(spark):
    """Small catalogues too are cut into several ranges, and nothing is joined by a nested loop."""
    parents = spark.range(1000).selectExpr("'o' as objetivo", "cast(id as string) as llave", "cast(null as timestamp) as desde", "cast(null as timestamp) as hasta")
    assert len(O._ranges(parents)) == 1 and O._ranges(parents.limit(100)) == []
    m = O.misses(*O.economy(*frames(spark, [(1, "A", "2021-01")], sectores=SECTORS)))
    assert "NestedLoop" not in m._jdf.queryExecution().toString()
