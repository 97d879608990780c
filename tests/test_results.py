import json

import numpy as np
import pytest

from tests.test_reference import GEO, flat, grid, located, raw, square, weighted  # noqa: F401
from zonaria import errors
from zonaria.operators import build, graph, ingest, leontief, profiles, propagate, results, score
from zonaria.operators import crosswalk as cw
from zonaria.operators import warehouse as wh
from zonaria.report import Report
from zonaria.sources import files, io_model, paths


def test_one_geometry_is_always_the_same(spark):
    two = [("A", square(0, 0)), ("A", square(1, 1)), ("B", None), ("B", square(0, 1)), ("C", None), (None, square(3, 3))]
    one = {r["cvegeo"]: r["geometry"] for r in results.one_geometry(spark.createDataFrame(two, GEO)).collect()}
    again = {r["cvegeo"]: r["geometry"] for r in results.one_geometry(spark.createDataFrame(two[::-1], GEO)).collect()}
    assert one == again and set(one) == {"A", "B", "C"} and one["C"] is None and one["B"] is not None


def test_geometry_joins(spark, grid):
    d = spark.createDataFrame([("A00", 1.0, "x"), ("Z", 2.0, "x"), (None, 3.0, "x")], "cvegeo string, v double, geometry string")
    got = lambda how: sorted(((r["cvegeo"], r["v"], r["geometry"] is not None) for r in results.with_geometry(d, grid, how).collect()), key=str)
    assert got("inner") == [("A00", 1.0, True)]
    assert got("left") == sorted([("A00", 1.0, True), ("Z", 2.0, False), (None, 3.0, False)], key=str)
    assert {c for c, _, g in got("right") if g} == {"A00", "A01", "A10", "A11"} and len(got("right")) == 4
    assert results.with_geometry(d.limit(0), grid).count() == 0


SIM = [("A", 1.0, 0.5, 1.5), ("B", -2.0, 0.0, -2.0), ("C", 0.0, 0.0, 0.0), ("D", None, None, None)]


def sim(spark):
    return spark.createDataFrame(SIM, "cvegeo string, shock_directo double, impacto_indirecto double, impacto_propagado double")


def test_groups_layers_and_bars(spark):
    s = sim(spark)
    groups = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2), ("E", 2), ("D", None)], "cvegeo string, g int")
    assert sorted(map(tuple, results.shock_by(groups, s, "g").collect())) == [(1, -1.0, 0.5, -0.5), (2, 0.0, 0.0, 0.0)]
    layer = {r["cvegeo"]: (r["intensidad"], r["decaimiento"]) for r in results.propagation_layer(s).collect()}
    assert layer["B"] == (2.0, 0.0) and layer["A"][1] == pytest.approx(0.5) and layer["D"] == (None, None)
    assert results.impact_of(s, "A") == {"shock_directo": 1.0, "impacto_indirecto": 0.5, "impacto_propagado": 1.5} and results.impact_of(s, "no") is None
    assert [r["cvegeo"] for r in results.largest(s, "impacto_propagado", "cvegeo", 2, absolute=True).collect()] == ["B", "A"]
    assert [(r["cvegeo"], r["barra"]) for r in results.bars(s, "impacto_propagado", "cvegeo", 3).collect()] == [("A", 0.75), ("C", 0.0), ("B", -1.0)]
    assert results.bars(s.limit(0), "impacto_propagado", "cvegeo").count() == 0
    assert [tuple(r) for r in results.most_frequent(groups, ["g"], 2).collect()] == [(1, 2), (2, 2)]
    assert tuple(results.above_percentile(spark.range(11), "id").first()) == (9.0, 2) and results.above_percentile(spark.range(0), "id").count() == 0


def test_flat_profile_and_selection(spark):
    u = spark.createDataFrame([("0100100000001", "01", "001", 1, ["a"]), ("0100200000001", "01", "002", 2, None)], "cvegeo string, entidad string, municipio string, cluster_id int, l array<string>")
    assert results.select_zones(u, ["01001"]).count() == 1 and results.select_zones(u, [], [2]).count() == 1 and results.select_zones(u).count() == 2
    assert results.flat_profile(u, {"cvegeo": "zona"}).select("zona", "l").collect()[0]["l"] == '["a"]'


def test_map_centre(spark, grid):
    x, y = results.map_centre(grid).first()
    assert x == pytest.approx(-99.19) and y == pytest.approx(19.41)
    assert tuple(results.map_centre(grid.limit(0)).first()) == (None, None)


def test_warehouse_in_one_call(spark, raw, grid, flat, weighted, tmp_path):
    w = build.warehouse(ingest.normalise_establishments(raw), grid, cw.lookup(flat))
    assert sorted(map(str, w.table.collect())) == sorted(map(str, weighted.select(w.table.columns).collect()))
    assert w.join_report.n_total == 8 and w.integrity_report.values["zonas_sin_geometria"] == 0
    assert w.with_zones(grid).select("cvegeo").distinct().count() == 4
    assert w.audit(3).values["estado"] in ("OK", "WARNING")
    meta = w.write(str(tmp_path))
    join, integrity = wh.resolve_reports(spark, meta)
    assert join["n_total"] == 8 and integrity["n_filas"] == w.table.count()
    paths.write_document(spark, f"{tmp_path}/otro.json", {"n_total": 9})
    assert wh.resolve_reports(spark, meta, join=f"{tmp_path}/otro.json")[0] == {"n_total": 9}
    paths.write_document(spark, f"{tmp_path}/vacio.json", {})
    with pytest.raises(errors.ContractError):
        wh.resolve_reports(spark, f"{tmp_path}/vacio.json")
    with pytest.raises(FileNotFoundError):
        wh.resolve_reports(spark, meta, integrity=f"{tmp_path}/nada.json")


def test_decision_support_in_one_call(spark, weighted, grid, tmp_path):
    comm = spark.createDataFrame([("SEC001", 0, "uno"), ("SEC002", 1, "dos"), (None, 9, "vacía")], "sector string, cluster_id int, nombre string")
    edges = graph.contiguity(grid)
    r = build.decision_support(weighted, comm, grid.selectExpr("cvegeo as id"), edges)
    n = {x["parte"]: x["n"] for x in r.counts().collect()}
    assert n["communities"] == 3 and n["unmapped"] == 1 and n["universe"] == n["neighbours"] and n["relations"] == 3 * n["universe"] + edges.count()
    assert "nombre_cluster" in r.municipalities.columns
    r.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/universe.parquet").count() == n["universe"]
    alone = build.decision_support(weighted, comm)
    assert alone.relations is None and alone.neighbours is None and "neighbours" not in {x["parte"] for x in alone.counts().collect()}


def test_weights_that_disagree_are_refused(spark):
    schema = "cvegeo string, sector_serio string, omega double, omega_metodo string"
    same = spark.createDataFrame([("A", "S", 0.5, "empleo"), ("A", "S", 0.5, "empleo"), ("B", "S", None, "sin_datos"), ("B", "S", None, "sin_datos")], schema)
    assert sorted(map(str, wh.omega_table(same).collect())) == sorted(map(str, same.distinct().withColumnRenamed("sector_serio", "sector").collect()))
    for other in (("A", "S", 0.4, "empleo"), ("A", "S", None, "empleo"), ("A", "S", 0.5, "establecimientos")):
        with pytest.raises(Exception, match="several weights of A S"):
            wh.omega_table(same.union(spark.createDataFrame([other], schema))).collect()
    o = wh.omega_table(same)
    assert [tuple(r) for r in wh.omega_views(o).collect()] == [("S", 1, 1, 0.5)] and [tuple(r) for r in wh.omega_of(o, "S").collect()] == [("A", 0.5)]


def test_vectors_must_name_every_node(spark):
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    good = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 9.0)], "id string, s double")
    assert sorted(map(tuple, propagate.align_all(nodes, good).collect())) == [("A", 1.0), ("B", 2.0)]
    for bad in ([("A", 1.0)], [("A", 1.0), ("B", None)]):
        with pytest.raises(errors.AlignmentError):
            propagate.align_all(nodes, spark.createDataFrame(bad, "id string, s double"))


def test_matrix_accessors_and_graph_files(spark, grid, tmp_path):
    nodes = grid.selectExpr("cvegeo as id").union(spark.createDataFrame([("Z",)], "id string"))
    edges = graph.contiguity(grid)
    m = graph.Matrix(nodes, graph.row_standardise(edges))
    assert m.neighbours("A00") == ["A01", "A10", "A11"] and m.is_island("Z") and m.index_of("A10") == 2
    assert {r["id"]: round(r["w"], 6) for r in m.row("A00").collect()} == {"A00": 0.0, "A01": 0.333333, "A10": 0.333333, "A11": 0.333333, "Z": 0.0}
    f = m.frame()
    assert f.loc["A00", "A11"] == pytest.approx(1 / 3) and f.loc["Z"].sum() == 0
    for ask in (m.neighbours, m.is_island, m.row, m.index_of):
        with pytest.raises(KeyError):
            ask("nadie")
    gal, meta = f"{tmp_path}/g.gal", f"{tmp_path}/g.json"
    graph.write_graph(nodes, edges, gal, meta, "queen")
    assert graph.read_graph_metadata(spark, meta)["report"]["islas"] == 1
    assert graph.load_matrix(spark, gal).neighbours("A11") == ["A00", "A01", "A10"] and graph.load_matrix(spark, f"{tmp_path}/no.gal") is None
    paths.write_text(spark, gal, "roto")
    assert graph.load_matrix(spark, gal) is None


def test_io_model(spark, tmp_path):
    codes, n = ["111", "112"], 2
    (tmp_path / "meta.json").write_text(json.dumps({"sectores": codes, "sector_names": {"111": "uno", "112": "dos"}}))
    (tmp_path / "sectores.csv").write_text("indice,scian,nombre\n0,111,uno\n1, 112,dos\n")
    (tmp_path / "resumen.json").write_text(json.dumps([{"estado": "NUEVO_LEON", "mult_promedio": 1.5}]))
    a = np.array([[0.1, 0.2], [0.3, 0.1]])
    np.save(tmp_path / "A_nacional.npy", a)
    np.save(tmp_path / "X_nacional.npy", np.ones(n))
    for s in ("NUEVO_LEON", "CDMX"):
        (tmp_path / s).mkdir()
        for k in io_model.VECTORS:
            np.save(tmp_path / s / f"{k}.npy", np.arange(1.0, n + 1))
        for k in io_model.MATRICES:
            np.save(tmp_path / s / f"{k}.npy", np.linalg.inv(np.eye(n) - a))
    (tmp_path / "SIN_INVERSA").mkdir()
    m = io_model.read_model(spark, str(tmp_path))
    assert m.states == ["CDMX", "NUEVO_LEON"] and m.by_name() == {"Ciudad de México": "CDMX", "Nuevo Leon": "NUEVO_LEON"}
    assert m.facts("NUEVO_LEON") == {"suma_X": 3.0, "suma_VA": 3.0, "suma_PO": 3, "activos": 2, "mult_promedio": 1.5} and m.facts("CDMX")["mult_promedio"] is None
    matrices, vectors = m.all_states()
    assert matrices.count() == 8 and vectors.columns == ["state", "sector", "x", "y", "v", "e", "va_r", "po_r"]
    named = spark.createDataFrame([("CDMX",), ("NUEVO_LEON",)], "e string").select(io_model.state_name_column("e").alias("n"))
    assert [r["n"] for r in named.collect()] == [io_model.state_name(s) for s in m.states]
    demand = spark.createDataFrame([(0, "CDMX", "111", -1e6)], "escenario int, state string, sector string, monto double")
    d = leontief.by_size(leontief.shock(matrices.select("state", "i", "j", "l"), demand, vectors), m.sectors).orderBy("lugar").collect()
    assert [r["nombre"] for r in d] == ["uno", "dos"] and d[0]["delta_X"] < d[1]["delta_X"] < 0
    with pytest.raises(errors.ScenarioConfigError):
        m.state("NADA")
    np.save(tmp_path / "CDMX" / "v.npy", np.ones(3))
    with pytest.raises(errors.ContractError):
        io_model.read_model(spark, str(tmp_path)).state("CDMX")
    cat, by_name = io_model.read_sector_catalogue(spark, str(tmp_path / "sectores.csv"))
    assert cat.count() == 2 and {r["nombre"]: r["sector"] for r in by_name.collect()} == {"uno": "111", "dos": "112"}


AUTH = "code string, level string, title string, sector string, status string, evidence string, mapping string, justification string, priority string, notes string"


def test_crosswalk_reports(spark, tmp_path):
    rows = [
        ("111111", "CLASE", "t", "S1", "VERIFIED", "OFFICIAL", "EXACT", "j", "HIGH", ""), ("222222", "CLASE", "t", "", "REVIEW_REQUIRED", "", "AMBIGUOUS", "", "HIGH", "ver"),
        ("33", "SECTOR", "t", "S2", "VERIFIED", "OFFICIAL", "EXACT", "j", "LOW", ""), ("444444", "CLASE", "t", "", "PENDING", "", "", "", "LOW", None),
    ]
    a = spark.createDataFrame(rows, AUTH)
    rules, observed = cw.check_rules(a), spark.createDataFrame([("111111",), ("333333",), ("99",), ("555555",)], "scian string")
    cat = spark.createDataFrame([("111111",), ("333333",)], "scian string")
    first, second = cw.second_round(a, cat, observed, rules)
    v = first.values
    want = {"HIGH": (2, 50.0), "MEDIUM": (0, 0.0), "LOW": (1, 0.0)}
    assert {r["priority"]: (r["n"], r["verified_pct"]) for r in v["priority_breakdown"]} == want
    assert v["by_sector"] == [{"sector": "S1", "n": 1}] and v["review_queue"] == [{"code": "222222", "title": "t", "priority": "HIGH", "notes": "ver"}] and v["unmapped"] == ["555555", "99"]
    assert v["verified_pct"] == 33.33 and v["ambiguous_pct"] == 33.33
    assert second.values["clases"] == v["clases"] + 2 and "MEDIUM" in str(second.values["priority_breakdown"])
    assert cw.status_shares(a.limit(0)).first()["pending_pct"] == 0.0 and cw.by_priority(a.limit(0)).count() == 3
    t = cw.authoring_template(spark.createDataFrame([("1", " "), ("2", "v9"), (None, "nan")], "scian_codigo string, scian_version string"), {"scian_version": "v1", "notes": "no"})
    assert t.columns == list(cw.AUTHORING_SCHEMA) and [(r["scian_codigo"], r["scian_version"], r["notes"]) for r in t.collect()] == [("1", "v1", ""), ("2", "v9", ""), ("", "v1", "")]
    cw.write_flat_template(spark.createDataFrame([("S1",)], "sector string"), str(tmp_path))
    assert files.read_contract(spark, f"{tmp_path}/crosswalk", cw.FLAT_SCHEMA).count() == 0 and spark.read.option("header", True).csv(f"{tmp_path}/sectores").first()["sector_serio"] == "S1"


def test_written_artefacts(spark, grid, tmp_path):
    schema = "cluster_id int, sector string, centralidad double, nombre string, n_sectores bigint, centralidad_media double, bl_media double, fl_media double"
    c = spark.createDataFrame([(0, "S1", 0.5, "uno", 2, 0.4, 1.0, 1.0), (0, "S2", 0.3, "uno", 2, 0.4, 1.0, 1.0), (1, "S3", 0.2, "tres", 1, 0.2, 1.0, 1.0)], schema)
    files.write_communities(c, f"{tmp_path}/c.json", 0.7842941234, {"seed": 42})
    pairs, meta = files.read_communities(spark, f"{tmp_path}/c.json")
    assert sorted(map(tuple, pairs.collect())) == [("S1", 0), ("S2", 0), ("S3", 1)] and meta.filter("cluster_id = 0").first()["sectores"] == ["S1", "S2"]
    shock = spark.createDataFrame([("A00", "S1", 2.0), ("A00", "S2", 3.0), ("Z", "S1", 1.0)], "cvegeo string, sector string, shock_ageb double")
    files.write_shock(shock, grid, f"{tmp_path}/s.parquet")
    assert sorted(map(tuple, files.read_shock(spark, f"{tmp_path}/s.parquet").collect())) == [("A00", 5.0), ("Z", 1.0)]
    files.write_zones(grid, grid.select("cvegeo"), Report("zonas", {"n": 4}), str(tmp_path))
    assert paths.read_document(spark, f"{tmp_path}/reporte_zonas.json")["n"] == 4 and spark.read.parquet(f"{tmp_path}/zonas_validadas.parquet").count() == 4


def test_observed_weight_and_levels(spark):
    w = spark.createDataFrame([("A", 0.5), ("A", None), ("B", None)], "cvegeo string, omega double")
    assert sorted(map(tuple, profiles.observed_weight(w).collect())) == [("A", 0.5), ("B", 0.0)]
    assert score.HIGH > score.MEDIUM
