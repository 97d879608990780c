import datetime as dt
import math
from collections import Counter, defaultdict
from decimal import Decimal, localcontext

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from zonaria.operators import profile as P

SCHEMA = "fila_id long, cvegeo string, sector_serio string, n_establecimientos long, empleo_total double, n_empleo_faltante long, omega double, omega_metodo string, periodo string, lote string, cargado_en timestamp"
T0 = dt.datetime(2021, 1, 1)


def row(i, lote, emp=1.0, falt=0, met="empleo", n=5):
    return (i, "z", "SEC001", n, emp, falt, 0.1, met, "2021-01", lote, T0)


def brute(rows):
    """Findings straight from the definitions."""
    seen = {r[0]: r for r in rows}
    loads = defaultdict(list)
    for r in seen.values():
        loads[r[9]].append(r)
    names = sorted(loads)
    before = {b: a for a, b in zip(names, names[1:], strict=False) if a[:-7] == b[:-7]}
    at = {"empleo_total": 4, "n_empleo_faltante": 5, "omega_metodo": 7}

    def valid(r, c):
        v = r[at[c]]
        if v is None:
            return False
        if c == "empleo_total":
            return math.isfinite(v) and v >= 0
        if c == "n_empleo_faltante":
            return r[3] is not None and 0 <= v <= r[3]
        return v in ("empleo", "establecimientos", "sin_datos")

    out = set()
    for l, rs in loads.items():
        for c, k in at.items():
            vals = [r[k] for r in rs if r[k] is not None]
            good = [r[k] for r in rs if valid(r, c)]
            if len(good) < len(vals):
                out.add((l, c, "patron" if c == "omega_metodo" else "rango"))
            if vals and len({str(v + 0.0) if isinstance(v, float) else v for v in vals}) == 1:
                out.add((l, c, "constante"))
            if l not in before:
                continue
            ps = loads[before[l]]
            if 10 * (sum(r[k] is None for r in rs) * len(ps) - sum(r[k] is None for r in ps) * len(rs)) > len(ps) * len(rs):
                out.add((l, c, "nulos"))
            old = [r[k] for r in ps if valid(r, c)]
            if good and old:
                if c == "omega_metodo":
                    a, b = Counter(good), Counter(old)
                    num = sum(abs(a[w] * len(old) - b[w] * len(good)) for w in {*a, *b})
                    far = 2 * num > len(good) * len(old)
                else:
                    grid = sorted({*good, *old})
                    num = max(abs(sum(x <= v for x in good) * len(old) - sum(x <= v for x in old) * len(good)) for v in grid)
                    far = 4 * num > len(good) * len(old)
                if far:
                    out.add((l, c, "distribucion"))
    return out


def found(spark, rows):
    return {tuple(r) for r in P.warehouse_findings(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_finding(spark):
    rows = [row(i, "A-202101", float(i % 7), i % 3) for i in range(40)]
    rows += [row(100 + i, "A-202102", None if i < 10 else float(i % 7), i % 3) for i in range(40)]
    rows += [row(200 + i, "A-202103", float(i % 7) + 50, 9 if i == 0 else i % 3, "empleo " if i == 1 else "empleo") for i in range(40)]
    rows += [row(300 + i, "B-202101", math.nan, None, "sin_datos") for i in range(3)]
    got = found(spark, rows)
    assert ("A-202102", "empleo_total", "nulos") in got
    assert ("A-202103", "empleo_total", "distribucion") in got
    assert ("A-202103", "n_empleo_faltante", "rango") in got
    assert ("A-202103", "omega_metodo", "patron") in got
    assert ("B-202101", "empleo_total", "constante") in got and ("B-202101", "empleo_total", "rango") in got
    assert not any(l == "B-202101" and c == "n_empleo_faltante" for l, c, _ in got)
    assert got == brute(rows)


def test_repeated_rows_count_once_and_thresholds_are_strict(spark):
    base = [row(i, "A-202101") for i in range(10)]
    again = [r[:-1] + (T0 + dt.timedelta(days=1),) for r in base[:5]]
    # one null of ten: exactly 0.10 more, no finding
    now = [row(50 + i, "A-202102", None if i == 0 else 1.0) for i in range(10)]
    got = found(spark, base + again + now)
    assert not any(h == "nulos" for _, _, h in got)
    assert got == brute(base + now)


values = st.sampled_from([None, 0.0, -0.0, 1.0, 2.5, 2.5, 8.0, -1.0, math.nan, math.inf, 1e300])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(values, st.sampled_from([None, -1, 0, 1, 6]), st.sampled_from([None, "", "empleo", "sin_datos", "x"]), st.sampled_from(["A-202101", "A-202102", "A-202105"]), st.sampled_from([None, 5])), min_size=1, max_size=30))
def test_against_brute_force(spark, items):
    rows = [row(i, l, e, f, m, n) for i, (e, f, m, l, n) in enumerate(items)]
    assert found(spark, rows) == brute(rows)


def test_empty_null_and_extra_columns(spark):
    assert found(spark, []) == set()
    df = spark.createDataFrame([row(1, None), row(None, "no-load"), row(None, "no-load")], SCHEMA).selectExpr("*", "1 as columna", "'x' as n", "2 as v")
    got = {tuple(r) for r in P.warehouse_findings(df).collect()}
    assert all(l == "no-load" and h == "constante" for l, _, h in got)


def test_power_sums_are_exact_and_mergeable(spark):
    rng = np.random.default_rng(1)
    xs = [float(x) / 2 for x in rng.integers(0, 10**7, 500)]
    rows = [row(i, "A-202101", x) for i, x in enumerate(xs)]
    whole = P.warehouse_profile(spark.createDataFrame(rows, SCHEMA)).filter("columna = 'empleo_total'").first()
    parts = [P.warehouse_profile(spark.createDataFrame(p, SCHEMA)).filter("columna = 'empleo_total'").first() for p in (rows[:123], rows[123:])]
    for k in (1, 2, 3, 4):
        with localcontext(prec=60):
            exact = sum(Decimal(str(x)) ** k for x in xs)
            assert Decimal(whole[f"s{k}"]) == exact == sum(Decimal(p[f"s{k}"]) for p in parts)


def test_standardised_difference(spark):
    rows = [row(i, "A-202101", float(i)) for i in range(20)] + [row(50 + i, "A-202102", float(i) + 3) for i in range(20)]
    d = {(r["lote"], r["columna"]): r for r in P.warehouse_profile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert d["A-202102", "empleo_total"]["dif_media"] == pytest.approx(3 / np.std(np.arange(20)))
    assert d["A-202101", "empleo_total"]["dif_media"] is None


def test_power_sums_of_any_size(spark):
    """Values that no decimal of 38 digits holds, and such finer than a tenth, are neither rounded nor left out."""
    rows = [row(1, "A-202101", 1.0), row(2, "A-202101", 2e11), row(3, "A-202101", 0.04), row(4, "B-202101", 1.0), row(5, "B-202101", 5e8), row(6, "C-202101", 1e300), row(7, "C-202101", 3e-7)]
    d = {r["lote"]: r for r in P.warehouse_profile(spark.createDataFrame(rows, SCHEMA)).filter("columna = 'empleo_total'").collect()}
    assert d["A-202101"]["s1"] == "200000000001.04" and d["A-202101"]["media"] == pytest.approx(200000000001.04 / 3)
    assert d["B-202101"]["s4"] == str(5**4 * 10**32 + 1)
    with localcontext(prec=3000):
        for k in (1, 2, 3, 4):
            assert Decimal(d["A-202101"][f"s{k}"]) == 1 + Decimal("2e11") ** k + Decimal("0.04") ** k
            assert Decimal(d["C-202101"][f"s{k}"]) == Decimal("1e300") ** k + Decimal("3e-7") ** k
    assert d["C-202101"]["media"] == pytest.approx(5e299) and d["C-202101"]["varianza"] == math.inf


def test_certain_shifts_are_shifts(spark):
    """Whenever means and variances prove a gap, the running sums find it too."""
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for feed in range(12):
        for month in range(2):
            for x in np.abs(rng.normal(20 + month * feed * 3, 1 + feed % 4, 25)):
                rows.append(row(i := i + 1, f"F{feed}-20210{month + 1}", float(x)))
    df = spark.createDataFrame(rows, SCHEMA)
    d = P.warehouse_profile(df).filter("columna = 'empleo_total'")
    sure = {r["lote"] for r in d.filter(P.certainly_shifted(0.25)).collect()}
    want = {l for l, c, h in brute(rows) if h == "distribucion" and c == "empleo_total"}
    assert 3 <= len(sure) and sure <= want
    assert found(spark, rows) == brute(rows)
