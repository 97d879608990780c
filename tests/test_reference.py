import json
import math

import numpy as np
import pytest

from zonaria import errors
from zonaria.functions import geometry as G
from zonaria.operators import allocate as al
from zonaria.operators import clusters, dissolve, graph, ingest, leontief, profiles, propagate, scenario, score
from zonaria.operators import crosswalk as cw
from zonaria.operators import warehouse as wh
from zonaria.plans import reference
from zonaria.report import Report
from zonaria.service import Service, serve
from zonaria.sources import files
from zonaria.streaming import ingest as stream

GEO = "cvegeo string, geometry array<array<array<struct<x:double,y:double>>>>"
X0, Y0 = -99.20, 19.40


def square(i, j, side=0.01, x0=X0, y0=Y0):
    x, y = lambda k: round(x0 + side * k, 6), lambda k: round(y0 + side * k, 6)
    return [[[{"x": a, "y": b} for a, b in ((x(i), y(j)), (x(i + 1), y(j)), (x(i + 1), y(j + 1)), (x(i), y(j + 1)), (x(i), y(j)))]]]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(f"A{i}{j}", square(i, j)) for i in range(2) for j in range(2)], GEO)


ROWS = [
    ("A1", "111111", .003, .003, "0 a 5 personas"), ("A2", "111111", .004, .004, "6 a 10 personas"), ("A3", "111111", .013, .013, "11 a 30 personas"), ("A4", "222222", .003, .013, "0 a 5 personas"),
    ("A5", "333333", .002, .001, "otra"), ("A6", "333333", .013, .003, "otra"), ("A7", "999999", .001, .002, "0 a 5 personas"), ("A8", "111111", -.30, -.30, "0 a 5 personas"),
]


@pytest.fixture(scope="module")
def raw(spark):
    data = [(i, c, round(Y0 + dy, 6), round(X0 + dx, 6), b, "n") for i, c, dx, dy, b in ROWS]
    return spark.createDataFrame(data, "ID string, Codigo_Act string, latitud double, longitud double, per_ocu string, nom_estab string")


@pytest.fixture(scope="module")
def flat(spark):
    rows = [("111111", "SEC001", ""), ("222222", "SEC002", ""), ("333333", "SEC003", ""), ("444444", "NADA", ""), ("55555", "SEC001", ""), ("666666", "SEC001", ""), (" 666666", "SEC002", ""), (None, "SEC001", ""), (None, "SEC001", "")]
    return cw.tag_flat(spark.createDataFrame(rows, "scian_codigo string, sector_serio string, notas string"), spark.createDataFrame([("SEC001",), ("SEC002",), ("SEC003",)], "sector string"))


@pytest.fixture(scope="module")
def located(raw, grid, flat):
    return cw.apply(wh.locate(ingest.normalise_establishments(raw), grid), cw.lookup(flat)).cache()


@pytest.fixture(scope="module")
def weighted(located):
    return wh.weights(wh.aggregate(located)).cache()


def test_build_warehouse(located, weighted, rows):
    assert wh.join_report(located).first().asDict() == {"n_total": 8, "n_matched": 7, "n_orphan": 1, "n_ambiguous": 0}
    w = {(r["cvegeo"], r["sector_serio"]): r for r in weighted.collect()}
    assert len(w) == 5
    assert w["A00", "SEC001"]["omega"] == pytest.approx(10.5 / 31) and w["A11", "SEC001"]["omega"] == pytest.approx(20.5 / 31)
    assert w["A00", "SEC003"]["omega"] == 0.5 and w["A00", "SEC003"]["omega_metodo"] == "establecimientos" and w["A00", "SEC003"]["n_empleo_faltante"] == 1
    i = wh.integrity(weighted, located).first()
    assert i["cobertura_establecimientos"] == pytest.approx(6 / 8) and i["cobertura_empleo"] == pytest.approx(1 - 2 / 6) and i["sectores_sin_suma_uno"] == 0
    a = wh.audit(weighted, Report.of("join", wh.join_report(located)), universe=3)
    assert a.estado == "WARNING" and "demasiados huérfanos" in a.banderas and a.metodos == {"empleo": 3, "establecimientos": 2, "sin_datos": 0}
    assert json.loads(a.to_json())["estado"] == "WARNING" and "estado" in a.summary()


def test_shared_vertex_is_ambiguous(spark, grid):
    p = spark.createDataFrame([("v", round(X0 + .01, 6), round(Y0 + .01, 6)), ("n", None, 1.0), ("x", math.nan, 1.0)], "id string, x double, y double")
    assert {r["id"]: (r["_join_status"], r["cvegeo"]) for r in wh.locate(p, grid).collect()} == {"v": ("ambiguous", None), "n": ("orphan", None), "x": ("orphan", None)}
    with pytest.raises(errors.ContractError):
        wh.locate(p, grid.union(grid))


def test_weights_without_data(spark):
    w = spark.createDataFrame([("a", "S1", 0, 0.0, 0), ("b", "S1", 0, 0.0, 0)], "cvegeo string, sector_serio string, n_establecimientos long, empleo_total double, n_empleo_faltante long")
    assert {(r["omega"], r["omega_metodo"]) for r in wh.weights(w).collect()} == {(None, "sin_datos")}
    assert wh.integrity(wh.weights(w.limit(0))).first()["n_filas"] == 0


def test_tags_never_drop(spark, raw):
    more = raw.union(spark.createDataFrame([("A1", " ", 50.0, None, None, None)], raw.schema))
    t = ingest.tag_establishments(more)
    assert t.count() == 9 and ingest.filter_valid(t, "_valid").count() == 7
    r = ingest.tag_report(t, "_valid", "denue")
    assert (r.n_total, r.n_valid, r.n_fail_id_unique, r.n_fail_lat_range, r.n_fail_scian_present) == (9, 7, 2, 1, 1)
    with pytest.raises(errors.ContractError):
        ingest.filter_valid(raw, "_valid")
    with pytest.raises(errors.ContractError):
        ingest.tag_establishments(raw.drop("latitud"))


def test_tag_zones(spark, grid):
    bow = [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]]
    two = square(5, 5) + [square(7, 7)[0] + [square(7, 7, 0.001)[0][0]]]
    z = grid.union(spark.createDataFrame([("A00", square(9, 9)), ("N", None), ("E", []), ("B", bow), ("M", two)], GEO))
    t = {r["cvegeo"]: r for r in ingest.tag_zones(z).collect()}
    assert t["M"]["_valid_geometry"] and t["A11"]["_valid_geometry"]
    assert not any(t[k]["_valid_geometry"] for k in ("A00", "N", "E", "B")) and not t["B"]["chk_is_valid"]


def test_crosswalk_flat(flat, rows):
    assert rows(cw.lookup(flat)) == [("111111", "SEC001"), ("222222", "SEC002"), ("333333", "SEC003")]


AUTH = "code string, level string, title string, sector string, status string, evidence string, mapping string, justification string"


def auth(spark, *rs):
    base = {"code": "111111", "level": "CLASE", "title": "t", "sector": "SEC001", "status": "VERIFIED", "evidence": "OFFICIAL", "mapping": "EXACT", "justification": "j"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rs], AUTH)


@pytest.mark.parametrize(
    "rs, error",
    [
        ([{}, {}, {"sector": "X"}], errors.DuplicateCodeError),
        ([{"sector": "X"}, {"code": "22", "level": "CLASE"}], errors.UnknownSectorError),
        ([{"code": "22"}, {"code": "abc", "level": "SUBSECTOR"}], errors.CodeLengthError),
        ([{"code": "abcdef"}], errors.NonNumericCodeError),
        ([{"evidence": "INFERRED"}], errors.StateConsistencyError),
        ([{"status": "PENDING"}], errors.StateConsistencyError),
        ([{"status": "otro"}], errors.StateConsistencyError),
    ],
)
def test_authoring_errors(spark, rs, error):
    u = spark.createDataFrame([("SEC001",)], "sector string")
    with pytest.raises(error):
        cw.check_authoring(cw.tag_authoring(auth(spark, *rs), u))
    assert cw.check_authoring(cw.tag_authoring(auth(spark, {}, {"code": "22", "level": "SECTOR", "status": "PENDING", "sector": None}), u)).n == 2


def test_resolve_longest_prefix(spark):
    rules = cw.check_rules(auth(spark, {"code": "11", "level": "SECTOR", "sector": "S2"}, {"code": "1111", "level": "RAMA", "sector": "S4"}, {"code": "11115", "status": "PENDING", "sector": ""}, {"code": "111199", "sector": "S6"}))
    codes = spark.createDataFrame([("111199",), ("111155",), (" 112233 ",), ("999999",), ("11",), (None,), ("",)], "scian string")
    got = {r["scian"]: (r["nivel"], r["prefijo"], r["sector"]) for r in cw.resolve(codes, rules).collect()}
    assert got == {"111199": ("CLASE", "111199", "S6"), "111155": ("RAMA", "1111", "S4"), "112233": ("SECTOR", "11", "S2"), "999999": (None, None, None), "11": (None, None, None)}
    assert cw.compile_flat(codes, rules).count() == 3
    with pytest.raises(errors.StateConsistencyError):
        cw.check_rules(auth(spark, {}, {}))


def test_master(spark):
    m = "nivel_scian string, codigo_scian string, descripcion_scian string, sector string, confianza string, requiere_revision string, justificacion string"
    names = spark.createDataFrame([("Uno", "SEC001")], "nombre string, sector string")
    got = {r["code"]: r for r in cw.from_master(spark.createDataFrame([("Clase", "111111", "d", "Uno", "Alta", "no", "j"), ("Rama", "2222", "d", "Dos", "baja", "Sí", "j")], m), names).collect()}
    assert (got["111111"]["status"], got["111111"]["sector"], got["2222"]["status"], got["2222"]["sector"], got["2222"]["notes"]) == ("VERIFIED", "SEC001", "REVIEW_REQUIRED", "", "Dos")
    for bad in (("Clase", "1", "d", "Uno", "alta", "si", "j"), ("Clase", "1", "d", "Dos", "alta", "no", "j")):
        with pytest.raises(errors.MasterRuleError):
            cw.from_master(spark.createDataFrame([bad], m), names)


def test_allocation(spark):
    w = spark.createDataFrame([("a", "S1", .6, "empleo"), ("b", "S1", .4, "empleo"), ("a", "S2", 1.0, "empleo"), ("b", "S2", None, "sin_datos"), ("a", "S3", None, "sin_datos"), ("a", "S4", .5, "empleo")], "cvegeo string, sector string, omega double, omega_metodo string")
    s = ingest.shock_table(spark, {"S1": 100.0, "S2": 10.0, "S3": 5.0, "S4": 8.0, "S9": 1.0})
    got = {(r["cvegeo"], r["sector"]): r["shock_ageb"] for r in al.allocate(w, s).collect()}
    assert got == {("a", "S1"): 60.0, ("b", "S1"): 40.0, ("a", "S2"): 10.0, ("a", "S4"): 4.0}
    assert sorted(r[0] for r in al.uncovered(w, s).collect()) == ["S3", "S9"]
    rep = {r["sector"]: r for r in al.allocation_report(w, s).collect()}
    assert rep["S4"]["no_normalizado"] and not rep["S1"]["no_normalizado"] and rep["S2"]["zonas_excluidas"] == 1
    assert {r["cvegeo"]: r["s"] for r in al.shock_vector(al.allocate(w, s)).collect()} == {"a": 74.0, "b": 40.0}
    assert al.allocate(w, ingest.shock_table(spark, {})).columns == ["cvegeo", "sector", "omega", "omega_metodo", "shock_sectorial", "shock_ageb"]
    for bad in (spark.createDataFrame([("S1", 1.0), ("S1", 2.0)], "sector string, delta_x double"), spark.createDataFrame([(1,)], "x int"), 7):
        with pytest.raises(errors.ContractError):
            ingest.shock_table(spark, bad)
    assert ingest.positional_shock(["a"], [1]) == {"a": 1.0}


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_contiguity(spark, grid, rows):
    def z(*items):
        return spark.createDataFrame(list(items), GEO)

    lattice = z(*((f"A{i}{j}", square(i, j)) for i in range(3) for j in range(3)), ("isla", square(50, 50)))
    at = {f"A{i}{j}": (i, j) for i in range(3) for j in range(3)}
    queen = {(a, b) for a, p in at.items() for b, q in at.items() if max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1}
    rook = {(a, b) for a, p in at.items() for b, q in at.items() if abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1}
    assert pairs(graph.contiguity(lattice)) == queen == pairs(graph.vertex_edges(lattice))
    assert pairs(graph.contiguity(lattice, "rook")) == rook
    # a T-junction touches, overlaps and nesting don't, a zone in the hole of another does
    half = [[[{"x": round(X0 + .01, 6), "y": round(Y0 + d, 6)} for d in (.002,)] + [{"x": round(X0 + .02, 6), "y": round(Y0 + d, 6)} for d in (.002, .008)] + [{"x": round(X0 + .01, 6), "y": round(Y0 + .008, 6)}]]]
    assert pairs(graph.contiguity(z(("a", square(0, 0)), ("t", half)), "rook")) == {("a", "t"), ("t", "a")}
    assert pairs(graph.contiguity(z(("a", square(0, 0)), ("o", square(.5, .5))))) == set()
    assert pairs(graph.contiguity(z(("a", square(0, 0)), ("n", square(.25, .25, .004))))) == set()
    assert pairs(graph.contiguity(z(("a", square(0, 0)), ("b", square(0, 0))))) == set()
    assert pairs(graph.contiguity(z(("a", square(0, 0)), ("c", square(0, 0, .004))))) == set()
    inner = square(1, 1, .003)[0][0]
    assert pairs(graph.contiguity(z(("d", [[square(0, 0)[0][0], inner]]), ("h", [[inner]])))) == {("d", "h"), ("h", "d")}
    for bad in (z(("a", None)), z(("a", square(0, 0)), ("a", square(1, 1)))):
        with pytest.raises(errors.ContractError):
            graph.contiguity(bad)
    with pytest.raises(errors.ContractError):
        graph.contiguity(grid, "bishop")


def graph_of(spark, links, ids):
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    edges = spark.createDataFrame(sorted({(a, b) for a, b in links} | {(b, a) for a, b in links}), "src string, dst string")
    return nodes, edges, graph.row_standardise(edges)


def test_matrix_and_gal(spark, tmp_path):
    nodes, edges, w = graph_of(spark, [("a", "b"), ("b", "c")], "abcd")
    assert {(r["src"], r["dst"]): r["w"] for r in w.collect()} == {("a", "b"): 1.0, ("b", "a"): .5, ("b", "c"): .5, ("c", "b"): 1.0}
    assert graph.row_sums(w).count() == 0 and graph.row_sums(graph.row_standardise(edges.union(edges.limit(1)))).count() == 1
    s = graph.graph_stats(nodes, edges).first()
    assert (s["nodos"], s["aristas"], s["islas"], s["grado_max"]) == (4, 2, 1, 2) and [r["id"] for r in graph.islands(nodes, edges).collect()] == ["d"]
    path = str(tmp_path / "g.gal")
    graph.write_gal(nodes, edges, path)
    name, n2, e2 = graph.read_gal(spark, path)
    assert name == "cvegeo" and pairs(e2) == pairs(edges) and n2.count() == 4
    assert [r["dst"] for r in graph.neighbours_of(edges, "b").collect()] == ["a", "c"]


@pytest.mark.parametrize(
    "text",
    ["", "0 1 x", "0 z g id\n", "0 1 g id\na\n\n", "0 1 g id\na x\n\n", "0 1 g id\na 1", "0 1 g id\na 2\nb\n", "0 2 g id\na 0\n\na 0\n\n", "0 3 g id\na 0\n\nb 0\n\n", "0 1 g id\na 1\nz\n"],
)
def test_gal_errors(spark, tmp_path, text):
    p = tmp_path / "g.gal"
    p.write_text(text)
    with pytest.raises(errors.GalFormatError):
        graph.read_gal(spark, str(p))
    with pytest.raises(errors.GalFormatError):
        graph.read_gal(spark, str(tmp_path / "none"))


def dense(ids, w):
    at = {x: k for k, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in w.collect():
        m[at[r["src"]], at[r["dst"]]] = r["w"]
    return m


def test_propagation(spark, monkeypatch):
    ids = "abcdefg"
    nodes, _, w = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("e", "f")], ids)
    s = propagate.align(nodes, spark.createDataFrame([("a", 60.0), ("a", 40.0), ("e", 10.0), ("g", 3.0)], "id string, s double"))
    vec = np.array([100.0, 0, 0, 0, 10, 0, 3])
    for rho in (0.0, 0.35, -0.5, 0.9):
        want = np.linalg.solve(np.eye(7) - rho * dense(ids, w), vec)
        got = {r["id"]: r for r in propagate.propagate(nodes, w, s, rho).collect()}
        assert [got[x]["y"] for x in ids] == pytest.approx(list(want)) and got["g"]["isla"] and got["g"]["y"] == 3.0
    y, k, done = propagate.neumann(nodes, w, s, 0.35)
    want = np.linalg.solve(np.eye(7) - 0.35 * dense(ids, w), vec)
    assert done and {r["id"]: r["y"] for r in y.collect()} == pytest.approx(dict(zip(ids, want, strict=True)))
    rep = propagate.propagation_report(propagate.propagate(nodes, w, s, 0.35), 0.35).first()
    assert rep["multiplicador"] == pytest.approx(want.sum() / 113) and rep["zonas_con_shock"] == 3
    assert propagate.spectral_radius(nodes, w) == pytest.approx(1.0)
    table, bad = propagate.sweep(nodes, w, s, [0.1, 0.5, 2.0])
    assert [r["rho"] for r in table.collect()] == [0.1, 0.5] and list(bad) == [2.0]
    with pytest.raises(errors.AlignmentError):
        propagate.align(nodes, spark.createDataFrame([("zz", 1.0)], "id string, s double"))
    for rho in (1.0, math.nan, "x", True):
        with pytest.raises(errors.InvalidRhoError):
            propagate.check_rho(rho)
    monkeypatch.setattr(propagate, "DENSE_NODES", 3)
    assert propagate.spectral_radius(nodes, w) == pytest.approx(1.0, abs=1e-6)
    got = {r["id"]: r["y"] for r in propagate.propagate(nodes, w, s, 0.35).collect()}
    assert got == pytest.approx(dict(zip(ids, want, strict=True)))


def test_moran_and_calibration(spark):
    nodes, _, w = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "d")], "abcd")
    v = lambda *xs: spark.createDataFrame(list(zip("abcd", map(float, xs), strict=True)), "id string, v double")
    i = lambda *xs: propagate.morans_i(nodes, w, v(*xs)).first()["i"]
    m, d = dense("abcd", w), np.array([0, 0, 10, 10.0]) - 5
    assert i(0, 0, 10, 10) == pytest.approx(4 / m.sum() * (d @ m @ d) / (d @ d)) and i(0, 0, 10, 10) > 0 > i(0, 10, 0, 10) and i(3, 3, 3, 3) == 0
    s = propagate.align(nodes, spark.createDataFrame([("a", 1.0)], "id string, s double"))
    target = spark.createDataFrame(list(zip("abcd", map(float, np.linalg.solve(np.eye(4) - 0.6 * m, [1.0, 0, 0, 0])), strict=True)), "id string, v double")
    got = propagate.calibrate(nodes, w, s, target)
    assert got["convergio"] and got["diferencia"] < 0.01 and got["n_rho_evaluados"] == 26


@pytest.mark.parametrize("series_rows", [300_000, 0])
def test_sweep_and_calibration_beyond_the_dense_solve(spark, monkeypatch, series_rows):
    monkeypatch.setattr(propagate, "SERIES_ROWS", series_rows)
    ids = "abcde"
    nodes, _, w = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "d")], ids)
    vec, rhos = np.array([100.0, 0, 0, 5, 3]), [0.0, 0.35, -0.5]
    s = propagate.align(nodes, spark.createDataFrame(list(zip(ids, map(float, vec), strict=True)), "id string, s double"))
    exact = {r: np.linalg.solve(np.eye(5) - r * dense(ids, w), vec) for r in rhos}
    target = spark.createDataFrame(list(zip(ids, map(float, np.linalg.solve(np.eye(5) - 0.3 * dense(ids, w), vec)), strict=True)), "id string, v double")
    want = propagate.calibrate(nodes, w, s, target, low=-0.2, high=0.4, coarse=3, fine=3)
    monkeypatch.setattr(propagate, "DENSE_NODES", 3)
    table, bad = propagate.sweep(nodes, w, s, [*rhos, 2.0])
    got = table.collect()
    assert [r["rho"] for r in got] == sorted(rhos) and list(bad) == [2.0]
    assert [r["suma_Y"] for r in got] == pytest.approx([exact[r].sum() for r in sorted(rhos)], rel=1e-8)
    y = {(r["rho"], r["id"]): r["y"] for r in propagate.neumann_grid(w, s, rhos).collect()}
    assert y == pytest.approx({(r, i): exact[r][k] for r in rhos for k, i in enumerate(ids)}, rel=1e-8)
    series = propagate.calibrate(nodes, w, s, target, low=-0.2, high=0.4, coarse=3, fine=3)
    assert series["rho"] == want["rho"] and series["i_modelo"] == pytest.approx(want["i_modelo"]) and series["n_rho_evaluados"] == want["n_rho_evaluados"]


def test_the_series_takes_all_its_terms_or_raises(spark, monkeypatch):
    monkeypatch.setattr(propagate, "DENSE_NODES", 1)
    nodes, _, w = graph_of(spark, [("a", "b")], "ab")
    s = propagate.align(nodes, spark.createDataFrame([("a", 1.0)], "id string, s double"))
    got = {r["id"]: r["y"] for r in propagate.propagate(nodes, w, s, 0.93).collect()}
    assert got == pytest.approx({"a": 1 / (1 - 0.93**2), "b": 0.93 / (1 - 0.93**2)}, rel=1e-8)
    got = {r["id"]: r["y"] for r in propagate.propagate(nodes, w, s, 0.99).collect()}
    assert got == pytest.approx({"a": 1 / (1 - 0.99**2), "b": 0.99 / (1 - 0.99**2)}, rel=1e-8)
    for rows in (300_000, 0):
        monkeypatch.setattr(propagate, "SERIES_ROWS", rows)
        with pytest.raises(errors.SingularOperatorError):
            propagate.propagate(nodes, w.withColumn("w", w["w"] * 20), s, 0.9)


def io(spark):
    a = spark.createDataFrame([("N", i, j, v) for (i, j), v in {("x", "x"): .2, ("x", "y"): .3, ("y", "x"): .1, ("y", "y"): .1}.items()] + [("S", "x", "x", .5)], "state string, i string, j string, a double")
    vec = spark.createDataFrame([("N", "x", 10.0, .4, 2.0), ("N", "y", 0.0, .5, 1.0), ("S", "x", 5.0, 0.0, 1.0)], "state string, sector string, x double, v double, e double")
    return a, vec


def test_leontief(spark, rows):
    a, vec = io(spark)
    m = leontief.inverse(a)
    inv = np.linalg.inv(np.eye(2) - np.array([[.2, .3], [.1, .1]]))
    got = {(r["state"], r["i"], r["j"]): r["l"] for r in m.collect()}
    assert got["N", "x", "y"] == pytest.approx(inv[0, 1]) and got["S", "x", "x"] == pytest.approx(2.0)
    demand = spark.createDataFrame([(0, "N", "x", 1e6), (1, "N", "y", 2e6), (2, "N", "x", 1e6), (2, "N", "y", 2e6)], "escenario int, state string, sector string, monto double")
    d = {(r["escenario"], r["sector"]): r for r in leontief.shock(m, demand, vec).collect()}
    for s in "xy":
        assert d[2, s]["delta_X"] == pytest.approx(d[0, s]["delta_X"] + d[1, s]["delta_X"])  # shocks superpose
    assert d[0, "x"]["delta_X_pesos"] == pytest.approx(inv[0, 0] * 1e6) and d[0, "y"]["variacion_pct"] is None and d[0, "x"]["es_origen_shock"] and not d[0, "y"]["es_origen_shock"]
    t = {r["escenario"]: r for r in leontief.shock_totals(leontief.shock(m, demand, vec), demand).collect()}
    assert t[0]["mult_produccion"] == pytest.approx(inv[:, 0].sum())
    assert [r["state"] for r in leontief.compare_states(m, vec, "x", 1e6).collect()] == ["N"] and leontief.compare_states(m, vec, "z", 1.0).count() == 0
    assert [r["sector"] for r in leontief.top_multipliers(m, vec, 1).collect()] == ["x" if inv[:, 0].sum() > inv[:, 1].sum() else "y"]
    link = {(r["state"], r["sector"]): r for r in leontief.linkages(m).collect()}
    assert link["N", "x"]["bl"] == pytest.approx(inv[:, 0].sum() / inv.sum() * 2)
    assert leontief.check_sector(vec, "S", "x") is False
    for bad in (("Z", "x"), ("N", "z")):
        with pytest.raises(errors.ScenarioConfigError):
            leontief.check_sector(vec, *bad)


def test_arrays(spark, tmp_path):
    (tmp_path / "N").mkdir()
    for k, v in {"L": np.eye(2), "X": np.ones(2), "v": np.ones(2), "e": np.zeros(2)}.items():
        np.save(tmp_path / "N" / f"{k}.npy", v)
    m, vec = leontief.read_arrays(spark, str(tmp_path), "N", ["a", "b"])
    assert m.count() == 4 and vec.count() == 2
    with pytest.raises(errors.ContractError):
        leontief.read_arrays(spark, str(tmp_path), "N", ["a"])


def test_communities(spark):
    adj = {}
    for g in (range(0, 5), range(5, 10)):
        for u in g:
            adj[u] = {v: 1.0 for v in g if v != u}
    adj[0][5] = adj[5][0] = 0.1
    part = clusters.louvain(adj)
    assert len(set(part.values())) == 2 and len({part[u] for u in range(5)}) == 1
    assert clusters.modularity(adj, part, 1.0) > 0.4 and clusters.louvain(adj) == part
    edges = spark.createDataFrame([(f"s{u}", f"s{v}", w) for u, near in adj.items() for v, w in near.items()] + [("z1", "z2", 1.0), ("z2", "z1", 1.0)], "i string, j string, w double")
    assert {r["componente"] for r in clusters.components(edges).collect()} == {"s0", "z1"}
    big = clusters.largest_component(edges)
    assert big.count() == edges.count() - 2
    links = spark.createDataFrame([(f"s{u}", 1.0, 2.0) for u in range(10)], "sector string, bl double, fl double")
    names = spark.createDataFrame([(f"s{u}", f"n{u}") for u in range(10)], "sector string, nombre string")
    c = clusters.communities(spark, big, links, names, resolution=1.0)
    assert {(r["n_sectores"], r["nombre"]) for r in c.collect()} == {(5, "n0"), (5, "n5")}
    l_matrix = spark.createDataFrame([("a", "a", 1.2), ("a", "b", .5), ("b", "a", .1), ("b", "b", 1.1), ("c", "c", 1.0)], "i string, j string, l double")
    sim = {(r["i"], r["j"]) for r in clusters.similarity(l_matrix).collect()}
    assert sim == {("a", "b"), ("b", "a")}


def test_sector_communities_of_all_states(spark, tmp_path):
    rows = [(1, "0100100010001", "A", 2, 5.0, 0), (2, "0100100010001", "B", 3, 5.0, 0), (3, "0200100010001", "B", 1, 5.0, 0), (4, "0200100010001", "C", 4, 5.0, 0)]
    spark.createDataFrame(rows, "fila_id long, cvegeo string, sector_serio string, n_establecimientos long, empleo_total double, n_empleo_faltante long").write.parquet(f"{tmp_path}/warehouse.parquet")
    spark.createDataFrame([(k, c, c.lower()) for k, c in enumerate("ABC")], "indice int, scian string, nombre string").write.parquet(f"{tmp_path}/sectores.parquet")
    got = reference.sector_communities(spark, str(tmp_path)).collect()
    assert sorted(r["sector"] for r in got) == ["A", "B", "C"]
    z = np.array([[4, 6, 0], [6, 10, 4], [0, 4, 16.0]])
    inv = np.linalg.inv(np.eye(3) - 0.5 * z / z.sum(axis=0))
    fl = inv.sum(axis=1) / inv.sum(axis=1).mean()
    assert sum(r["fl_media"] for r in got) == pytest.approx(fl.sum(), abs=1e-5)
    for r in got:
        assert r["fl_media"] == pytest.approx(np.mean([fl["ABC".index(x["sector"])] for x in got if x["cluster_id"] == r["cluster_id"]]), abs=1e-5)


def test_profiles_and_scores(spark):
    w = spark.createDataFrame(
        [("0900200010010", "S1", 3, 6.0, 0), ("0900200010010", "S2", 2, 4.0, 0), ("0900200010020", "S2", 5, 0.0, 5), ("0900300010010", "S3", 1, 1.0, 0), ("01", "S9", 1, 1.0, 0)],
        "cvegeo string, sector_serio string, n_establecimientos long, empleo_total double, n_empleo_faltante long",
    )
    c = spark.createDataFrame([("S1", 1, "uno"), ("S2", 2, "dos"), ("S3", 1, "uno"), (None, 9, "vacía")], "sector string, cluster_id int, nombre string")
    sw = profiles.sector_weights(w)
    g = profiles.community_weights(sw, c)
    u = profiles.universe(sw, c)
    got = {r["cvegeo"]: r for r in u.collect()}
    assert set(got) == {"0900200010010", "0900200010020", "0900300010010"} and [r["sector"] for r in profiles.unmapped_sectors(sw, c).collect()] == ["S9"]
    assert got["0900200010010"]["cluster_id"] == 1 and got["0900200010020"]["peso_total"] == 5.0 and sum(r["participacion_pct"] for r in got.values()) == pytest.approx(100)
    assert sorted((r["ranking"], z) for z, r in got.items()) == [(1, "0900200010010"), (2, "0900200010020"), (3, "0900300010010")]
    cp = {r["cluster_id"]: r for r in profiles.community_profiles(u, g, c).collect()}
    assert cp[9]["n_agebs"] == 0 and cp[9]["peso_total"] == 0 and cp[9]["agebs_principales"] == [] and cp[1]["peso_granular"] == 7.0 and cp[1]["peso_total"] == 11.0
    sim = spark.createDataFrame([("0900200010010", 1.0, 2.0, 1.0)], "cvegeo string, shock_directo double, impacto_propagado double, impacto_indirecto double")
    m = {r["municipio"]: r for r in profiles.municipality_profiles(u, simulation=sim).collect()}
    assert m["002"]["impacto_propagado"] == 2.0 and m["003"]["impacto_propagado"] is None and m["002"]["agebs_principales"] == ["0900200010010", "0900200010020"]
    h = {r["cvegeo"]: r["hhi"] for r in score.hhi(g, u).collect()}
    assert h["0900200010010"] == pytest.approx(.6**2 + .4**2)
    o = {r["cvegeo"]: r for r in score.opportunity(u, g, spark.createDataFrame([(1, .5)], "cluster_id int, centralidad_media double"), 4, sim).collect()}
    assert all(0 <= r["score"] <= 1 for r in o.values()) and o["0900200010010"]["impacto"] == 2.0 and o["0900300010010"]["impacto"] == 0.0
    assert score.concentration(u, "peso_total", "cvegeo") == 2 and score.search(u, "0900300010010").first()["tipo"] == "ageb" and score.search(u, "zzz").count() == 0
    edges = spark.createDataFrame([("0900200010010", "0900300010010")], "src string, dst string")
    n = {r["cvegeo"]: r for r in profiles.neighbour_context(u, edges).collect()}
    assert n["0900200010010"]["municipios_conectados"] == ["09003"] and n["0900200010020"]["agebs_relacionadas"] == []


def test_classes(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 71)] + [(None,)], "v double")
    sizes = sorted(r["count"] for r in score.classify(v, "v").filter("v is not null").groupBy("clase").count().collect())
    assert sizes == [10] * 7 and score.classify(v, "v").filter("v is null").first()["clase"] is None
    assert score.classify(v.filter("v = 3"), "v").first()["clase"] == 0
    assert score.histogram(v, "v").agg({"n": "sum"}).first()[0] == 70
    r = {x["v"]: x["lugar"] for x in score.competition_rank(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0)], "k int, v double"), "v", "k").collect()}
    assert r == {9.0: 1, 5.0: 2}


def test_projection(spark):
    from pyspark.sql import functions as F

    pts = spark.createDataFrame([(-102.0, 12.0), (-99.2, 19.4), (-117.0, 32.5), (-86.8, 21.1)], "lon double, lat double")
    p = G.project(F.col("lon"), F.col("lat"))
    d = pts.withColumn("p", p)
    back = d.select("lon", "lat", "p", G.unproject(F.col("p.x"), F.col("p.y")).alias("b")).collect()
    for r in back:
        assert r["b"]["x"] == pytest.approx(r["lon"], abs=1e-9) and r["b"]["y"] == pytest.approx(r["lat"], abs=1e-9)
    assert (back[0]["p"]["x"], back[0]["p"]["y"]) == pytest.approx((2_500_000, 0), abs=1e-6)
    # on a standard parallel the scale is 1: a short arc has its length on the ellipsoid
    q = spark.createDataFrame([(-102.0, 17.5), (-101.999, 17.5)], "lon double, lat double").select(p.alias("p")).collect()
    a, e2 = 6378137.0, 0.00669438002290
    arc = a * math.cos(math.radians(17.5)) / math.sqrt(1 - e2 * math.sin(math.radians(17.5)) ** 2) * math.radians(0.001)
    assert math.dist((q[0]["p"]["x"], q[0]["p"]["y"]), (q[1]["p"]["x"], q[1]["p"]["y"])) == pytest.approx(arc, rel=1e-7)


def test_geometry_measures(spark):
    from pyspark.sql import functions as F

    ring = lambda *ps: [{"x": float(a), "y": float(b)} for a, b in ps]
    g = [[ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2))], [ring((10, 0), (12, 0), (12, 2), (10, 2))]]
    r = spark.createDataFrame([("z", g)], GEO).select(G.area("geometry").alias("a"), G.perimeter("geometry").alias("p"), G.centroid("geometry").alias("c")).first()
    assert r["a"] == 19 and r["p"] == 28
    assert (r["c"]["x"], r["c"]["y"]) == pytest.approx(((16 * 2 - 1.5 + 4 * 11) / 19, (16 * 2 - 1.5 + 4 * 1) / 19))
    many = [[ring(*((math.cos(t / 50 * math.pi), math.sin(t / 50 * math.pi)) for t in range(101)))]]
    s = spark.createDataFrame([("c", many)], GEO).select(G.simplify("geometry", 0.05).alias("g"), F.lit(1)).first()["g"]
    assert 6 < len(s[0][0]) < 30


def test_dissolve(spark):
    z = spark.createDataFrame([(f"{i}{j}", "m" if i < 2 else "n", square(i, j)) for i in range(3) for j in range(3) if (i, j) != (1, 1)] + [("c", "n", square(1, 1))], "cvegeo string, mun string, geometry " + G.GEOMETRY)
    got = {r["mun"]: r["geometry"] for r in dissolve.dissolve(z, "mun").collect()}
    assert len(got["m"]) == 1 and len(got["n"]) == 1
    area = lambda g: sum(dissolve._ring_area([(p["x"], p["y"]) for p in r[:-1]]) for poly in g for r in poly)
    assert area(got["m"]) == pytest.approx(5e-4) and area(got["n"]) == pytest.approx(4e-4)
    ringed = z.withColumn("mun", z["cvegeo"] == "c").filter("not mun").withColumn("mun", z["geometry"].isNotNull().cast("string"))
    donut = dissolve.dissolve(ringed, "mun").first()["geometry"]
    assert len(donut) == 1 and len(donut[0]) == 2 and area(donut) == pytest.approx(8e-4)


def test_geojson(spark, grid, tmp_path, rows):
    z = grid.union(spark.createDataFrame([("M", square(5, 5) + [square(7, 7)[0] + [square(7, 7, .001)[0][0]]]), ("N", None)], GEO))
    path = str(tmp_path / "z.geojson")
    assert files.write_geojson(z, path, ["cvegeo"]) == 5 and [r[0] for r in files.without_geometry(z).collect()] == ["N"]
    back = files.read_geojson(spark, path)
    assert rows(back.select("cvegeo", G.area("geometry"))) == rows(z.filter("cvegeo <> 'N'").select("cvegeo", G.area("geometry")))
    files.write_geojson_lines(z, str(tmp_path / "lines"), ["cvegeo"])
    assert files.read_geojson(spark, str(tmp_path / "lines"), lines=True).count() == 5
    layer = files.dashboard_layer(z.selectExpr("*", "case when cvegeo = 'M' then double('nan') else 2.0 end as v"), "v")
    assert layer["values"]["M"] is None and layer["mean"] == 2.0 and len(layer["geojson"]["features"]) == 5
    with pytest.raises(FileNotFoundError):
        files.read_geojson(spark, str(tmp_path / "none"))


def test_csv(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,nom_estab\n1,Clínica\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("id,nom_estab\n1,Clínica\n".encode())
    for f in ("latin.csv", "utf.csv"):
        assert files.read_establishments(spark, str(tmp_path / f)).first()["nom_estab"] == "Clínica"
    (tmp_path / "m.csv").write_bytes("a,b\n1,\n".encode("utf-8-sig"))
    assert tuple(files.read_contract(spark, str(tmp_path / "m.csv"), ["a", "b"], fill=True).first()) == ("1", "")
    with pytest.raises(errors.ContractError):
        files.read_contract(spark, str(tmp_path / "m.csv"), ["c"])
    with pytest.raises(errors.ContractError):
        files.write_contract(spark.range(1), str(tmp_path / "o"), ["a"])
    (tmp_path / "c.json").write_text(json.dumps({"sector_to_cluster": {"S1": 0}, "clusters": {"0": {"nombre": "n", "sectores": ["S1"]}, "1": {"nombre": "v", "sectores": []}}}))
    members, meta = files.read_communities(spark, str(tmp_path / "c.json"))
    assert members.count() == 1 and meta.count() == 2 and files.read_communities(spark, str(tmp_path / "x.json")) is None


def test_scenario_and_service(spark, weighted, tmp_path):
    nodes, _, w = graph_of(spark, [("A00", "A01"), ("A00", "A10"), ("A01", "A11")], ["A00", "A01", "A10", "A11", "A99"])
    secs = ["SEC001", "SEC002", "SEC003"]
    m = spark.createDataFrame([("N", i, j, 1.2 if i == j else .1) for i in secs for j in secs], "state string, i string, j string, l double")
    vec = spark.createDataFrame([("N", s, 10.0, .4, 1.0) for s in secs], "state string, sector string, x double, v double, e double")
    model = scenario.Model(weighted, nodes, w, m, vec)
    r = scenario.Scenario("N", {"SEC001": 1e6}, 0.35).run(model)
    assert r.report.suma_S == pytest.approx(1.4e6) and r.report.multiplicador > 1 and r.report.sectores_sin_peso == []
    zero = scenario.Scenario("N", {"SEC001": 1e6}, 0.0).run(model)
    assert all(x["y"] == pytest.approx(x["s"]) for x in zero.zones.collect()) and scenario.compare(zero, r)["delta_impacto"] > 0
    d1, d2 = (scenario.dossier(r, {"x": str(tmp_path / "none")}) for _ in range(2))
    assert d1["report_id"] == d2["report_id"] and d1["report_id"].startswith("edu-") and len(d1["report_id"]) == 20
    s = Service(model, weighted, spark.createDataFrame([(1, "c")], "cluster_id int, nombre string"))
    assert s.handle("GET", "/health")[0] == 200 and s.handle("GET", "/catalog")[1]["estados"] == ["N"]
    ok = s.handle("POST", "/simulate", {"estado": "N", "sector": "SEC001", "monto": 1e6})
    assert ok[0] == 200 and ok[1]["suma_S"] == pytest.approx(1.4e6)
    for body in ({}, {"estado": "N", "sector": "SEC001", "monto": "x"}, {"estado": "Z", "sector": "SEC001", "monto": 1}, {"estado": "N", "sector": "SEC001", "monto": 1, "rho": 1.5}):
        assert s.handle("POST", "/simulate", body)[0] == 400
    assert s.handle("GET", "/decision-support/ageb/A00")[0] == 200 and s.handle("GET", "/decision-support/ageb/Z")[0] == 404 and s.handle("GET", "/decision-support/community/1")[1]["nombre"] == "c"
    assert Service(None).handle("GET", "/health")[0] == 503 and Service(None).handle("GET", "/decision-support/ageb/A")[0] == 503
    server = serve(s, port=0)
    server.server_close()


def test_streaming(spark, raw, grid, flat, weighted, tmp_path, rows):
    src = str(tmp_path / "in")
    for part in ("ID < 'A4'", "ID >= 'A4'"):
        raw.filter(part).write.mode("append").parquet(src)
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # a second run finds nothing new
        q = stream.start(source, grid, cw.lookup(flat), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    cols = ["cvegeo", "sector_serio", "n_establecimientos", "empleo_total", "omega_metodo"]
    assert rows(stream.current(spark, str(tmp_path / "out")), *cols) == rows(weighted, *cols)


def test_small_helpers(spark):
    from pyspark.sql import functions as F

    from zonaria.functions import formatting

    assert score.sweep_points(0, 0.95, 3) == [0.0, 0.475, 0.95]
    with pytest.raises(ValueError):
        score.sweep_points(0, 1, 3)
    s = score.sweep_summary(spark.createDataFrame([(0.1, 1.1), (0.2, 1.5), (0.3, math.nan)], "rho double, multiplicador double")).first()
    assert (s["minimo"], s["maximo"], s["rango"]) == pytest.approx((1.1, 1.5, 0.4))
    d = score.dominant_share(spark.createDataFrame([(4.0, 1.0), (0.0, 0.0)], "peso_total double, sector_peso double"))
    assert [r["concentracion"] for r in d.collect()] == [25.0, 0.0]
    t = spark.createDataFrame([(1234567.0,), (-2500.0,), (12.0,), (None,)], "v double").select(formatting.compact("v").alias("c"), formatting.percent("v").alias("p")).collect()
    assert [r["c"] for r in t] == ["1.2M", "-2.5K", "12.0", "—"] and t[2]["p"] == "12.0%"
    assert spark.range(1, 5).select(formatting.palette(F.col("id"), ["a", "b", "c"]).alias("k")).agg(F.concat_ws("", F.collect_list("k"))).first()[0] == "abca"
