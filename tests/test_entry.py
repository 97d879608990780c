import duckdb
import pytest

import __spark_entry__ as entry

CHOSEN = ["p1_found", "p4_found", "p7_totals", "build_warehouse", "omega", "crosswalk_resolve", "allocate_shock", "propagate_exact", "leontief_shock", "municipality_profile", "opportunity_score", "quantile_classes"]


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and set(CHOSEN) <= set(sql)
    for n in (1, 2, 4, 5, 6, 7):
        assert f"p{n}_found" in q


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "zonaria"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "zonaria.llm" not in p.read_text()


@pytest.mark.parametrize("name", CHOSEN)
def test_against_duckdb(spark, data, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    clean = lambda v: float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(clean(r[k]) for k in at) for r in want.fetchall()), key=key)
    got = sorted((tuple(clean(v) for v in r) for r in entry.queries()[name](spark, data).select(*cols).collect()), key=key)
    assert got == rows
