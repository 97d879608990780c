import datetime as dt
import json

from zonaria.operators import drift

SCHEMA = "registro_id long, serie string, archivo string, fecha_corte timestamp, recibido_en timestamp, registro string, campo string, orden int"
D = dt.datetime


def frame(spark, files):
    """files: [(serie, archivo, month, [records])]"""
    rows, n = [], 0
    for serie, archivo, month, recs in files:
        for r in recs:
            n += 1
            rows.append((n, serie, archivo, D(2021, month, 1), D(2022, 1, 1), r if isinstance(r, str) or r is None else json.dumps(r), "c", 9))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {tuple(r) for r in drift.changes(df).collect()}


def recs(n, **fields):
    return [{"id": f"{i:03d}"} | {k: (v(i) if callable(v) else v) for k, v in fields.items()} for i in range(n)]


def test_changes(spark):
    a = recs(10, codigo_act=lambda i: f"{i}00", lat=lambda i: i + 0.5, viejo="x")
    b = recs(10, **{" ACT ": lambda i: f"{i}00" if i < 5 else "otro", "lat": lambda i: str(i + 0.5), "nuevo": True})
    c = recs(10, act=lambda i: int(f"{i + 1}00"), lat=None, nuevo=False)
    d = recs(10, act=lambda i: int(f"{i + 1}00"), lat=lambda i: i + 0.5, viejo="x")
    df = frame(spark, [("S", "b", 2, b), ("S", "a", 1, a), ("S", "d", 4, d), ("S", "c", 3, c)])
    df = df.union(df.filter("registro_id < 5"))  # delivered again
    assert found(df) == {
        ("b", "renombrado", "codigo_act", "act"), ("b", "tipo", "lat", "lat"), ("b", "eliminado", "viejo", ""), ("b", "agregado", "", "nuevo"),
        ("c", "tipo", "act", "act"), ("d", "tipo", "lat", "lat"), ("d", "eliminado", "nuevo", ""), ("d", "agregado", "", "viejo"),
    }


def test_rename_needs_half(spark):
    a, b = recs(9, x=lambda i: f"v{i}"), recs(9, y=lambda i: f"v{i}" if i < 4 else None)
    assert found(frame(spark, [("S", "a", 1, a), ("S", "b", 2, b)])) == {("b", "eliminado", "x", ""), ("b", "agregado", "", "y")}


def test_rename_with_new_kind(spark):
    a, b = recs(4, x=lambda i: str(i)), recs(4, y=lambda i: i)
    assert found(frame(spark, [("S", "a", 1, a), ("S", "b", 2, b)])) == {("b", "renombrado", "x", "y"), ("b", "tipo", "x", "y")}


def test_odd_records(spark):
    odd = [None, "", "[1]", "no json", "{}", '{"id": null, "q": {"z": 1}}']
    df = frame(spark, [("S", "a", 1, odd), ("S", "b", 2, recs(2, q="t")), (None, "c", 3, recs(1)), ("S", None, 3, recs(1))])
    assert found(df) == {("b", "tipo", "q", "q")}
    assert found(df.limit(0)) == set()
    assert drift.unified(df.limit(0)).count() == 0


def test_unified(spark):
    a = recs(3, codigo_act=lambda i: f"{i}11111.0", latitud=lambda i: i + 20.5, extra="e")
    b = recs(3, clave_x=lambda i: f"{i}11111.0", lat_nueva=lambda i: str(i + 20.5), extra=1)
    t = drift.unified(frame(spark, [("S", "a", 1, a), ("S", "b", 2, b)]))
    got = {(r["archivo"], r["id"]): (r["codigo_act"], r["latitud"], r["otros"]) for r in t.collect()}
    assert len(got) == 6
    assert got["a", "001"] == ("111111", 21.5, {"extra": "e"})
    assert got["b", "001"] == ("111111", 21.5, {"extra": "1"})


def test_lifespans(spark, rows):
    df = frame(spark, [("S", "a", 1, recs(1, x=1)), ("S", "b", 2, recs(1, x=2)), ("S", "c", 3, recs(1)), ("S", "d", 4, recs(1, x="t"))])
    assert rows(drift.lifespans(df).filter("campo = 'x'")) == [("S", "x", "number", "a", "b", 2), ("S", "x", "text", "d", "d", 1)]
