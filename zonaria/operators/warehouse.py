"""From located establishments to weights per zone and sector; integrity and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonaria.errors import ContractError, require
from zonaria.functions.codes import norm_code
from zonaria.operators.spatial_join import build_tree, points_in_zones
from zonaria.report import Report
from zonaria.sources.paths import read_document, write_document
from zonaria.sources.tables import deliveries

TOLERANCE = 1e-6


def locate(points: DataFrame, zones: DataFrame) -> DataFrame:
    """``points`` (id, x, y, …) with ``cvegeo`` and ``_join_status``: matched, orphan or ambiguous (cvegeo null).

    Borders belong to the zone, so a point on a common border is ambiguous.
    Points without coordinates are orphans.  Zone ids must be unique.
    """
    require(points, "id", "x", "y")
    require(zones, "cvegeo", "geometry")
    twice = zones.groupBy("cvegeo").count().filter("count > 1").limit(10).collect()
    if twice:
        raise ContractError("repeated zones: " + ", ".join(str(r["cvegeo"]) for r in twice))
    usable = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    places = usable.select(F.concat_ws(",", "x", "y").alias("id"), "x", "y").distinct()
    held = points_in_zones(build_tree(places), zones.select(F.col("cvegeo").alias("zona"), "geometry"))
    one = held.groupBy(F.col("clave_1").alias("_p")).agg(F.count("*").alias("_n"), F.min("clave_2").alias("_z"))
    d = points.join(one, F.concat_ws(",", "x", "y") == F.col("_p"), "left")
    status = F.when(F.col("_n") == 1, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("orphan")
    return d.withColumn("cvegeo", F.when(F.col("_n") == 1, F.col("_z"))).withColumn("_join_status", status).drop("_p", "_n", "_z")


def join_report(located: DataFrame) -> DataFrame:
    """One row: n_total, n_matched, n_orphan, n_ambiguous."""
    return located.agg(F.count("*").alias("n_total"), *(F.count_if(F.col("_join_status") == s).alias(f"n_{s}") for s in ("matched", "orphan", "ambiguous")))


def aggregate(located: DataFrame) -> DataFrame:
    """(cvegeo, sector_serio, n_establecimientos, empleo_total, n_empleo_faltante) of the matched rows with a sector.

    Employment that is unknown throughout sums to 0; its rows are counted apart.
    """
    d = located.filter((F.col("_join_status") == "matched") & F.col("sector").isNotNull())
    emp = F.col("empleo_estimado") if "empleo_estimado" in located.columns else F.lit(None).cast("double")
    return d.groupBy("cvegeo", F.col("sector").alias("sector_serio")).agg(
        F.count("*").alias("n_establecimientos"),
        F.coalesce(F.sum(F.nanvl(emp, F.lit(None))), F.lit(0.0)).alias("empleo_total"),
        F.count_if(emp.isNull() | F.isnan(emp)).alias("n_empleo_faltante"),
    )


def condense(warehouse: DataFrame) -> DataFrame:
    """The loads of a warehouse as one row per (cvegeo, sector_serio): repeated deliveries once, codes normalised.

    Employment that is null, negative or not finite adds nothing; missing
    counts outside 0..n add nothing.  Rows without zone or sector are left out.
    """
    d = deliveries(warehouse, "fila_id", "cvegeo", "sector_serio", "n_establecimientos", "empleo_total", "n_empleo_faltante")
    e, m, n = F.col("empleo_total"), F.col("n_empleo_faltante"), F.col("n_establecimientos")
    good = e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")) & (e >= 0)
    return (
        d.withColumn("sector_serio", norm_code("sector_serio"))
        .filter(F.col("cvegeo").isNotNull() & F.col("sector_serio").isNotNull())
        .groupBy("cvegeo", "sector_serio")
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("n_establecimientos"),
            F.coalesce(F.sum(F.when(good, e)), F.lit(0.0)).alias("empleo_total"),
            F.coalesce(F.sum(F.when((m >= 0) & (m <= n), m)), F.lit(0)).alias("n_empleo_faltante"),
        )
    )


def weights(agg: DataFrame) -> DataFrame:
    """``agg`` with omega and omega_metodo, decided per sector.

    By employment where the sector has any, else by establishments, else null
    (``sin_datos``).  Sector totals are aggregated first and joined back: they
    are one row per sector, while a window would bring a sector's zones into
    one task.
    """
    totals = agg.groupBy("sector_serio").agg(F.sum("empleo_total").alias("_e"), F.sum("n_establecimientos").alias("_n"))
    omega = F.when(F.col("_e") > 0, F.col("empleo_total") / F.col("_e")).when(F.col("_n") > 0, F.col("n_establecimientos") / F.col("_n"))
    method = F.when(F.col("_e") > 0, "empleo").when(F.col("_n") > 0, "establecimientos").otherwise("sin_datos")
    return agg.join(totals, "sector_serio").withColumns({"omega": omega, "omega_metodo": method}).drop("_e", "_n")


def integrity(w: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """One row of integrity figures of a weighted table; zeros for an empty one.

    Repeated pairs, null weights, sectors whose weights don't sum to one
    (+-1e-6, sectors with a weight only), rows with n <= 0 or negative
    employment, and the coverage of establishments and employment.
    """
    per = w.groupBy("sector_serio").agg(F.sum("omega").alias("s"))
    sums = per.agg(F.count_if(F.abs(F.col("s") - 1) > TOLERANCE).alias("sectores_sin_suma_uno"), F.count("*").alias("n_sectores"))
    pairs = w.groupBy("cvegeo", "sector_serio").count().agg(F.count_if(F.col("count") > 1).alias("pares_repetidos"))
    rows = w.agg(
        F.count("*").alias("n_filas"),
        F.count_if(F.col("omega").isNull()).alias("omega_nula"),
        F.count_if((F.col("n_establecimientos") <= 0) | (F.col("empleo_total") < 0)).alias("n_invalidas"),
        F.coalesce(F.sum("n_establecimientos"), F.lit(0)).alias("establecimientos"),
        F.coalesce(F.sum("n_empleo_faltante"), F.lit(0)).alias("faltantes"),
    )
    one = lambda d: d.withColumn("_k", F.lit(1))
    d = one(rows).join(one(sums), "_k").join(one(pairs), "_k")
    if located is not None:
        d = d.join(one(join_report(located).select("n_total")), "_k")
        d = d.withColumn("cobertura_establecimientos", F.when(F.col("n_total") > 0, F.col("establecimientos") / F.col("n_total")).otherwise(0.0)).drop("n_total")
    return d.withColumn("cobertura_empleo", F.when(F.col("establecimientos") > 0, 1 - F.col("faltantes") / F.col("establecimientos")).otherwise(0.0)).drop("_k")


def audit(w: DataFrame, join: Report, universe: int = 78, orphan_limit: float = 0.10, n_filas: int | None = None) -> Report:
    """Flags in a fixed order and a status: CRITICAL, WARNING or OK."""
    v = integrity(w).first().asDict()
    methods = {r["omega_metodo"]: r["count"] for r in w.groupBy("omega_metodo").count().collect()}
    matched, total = join.values["n_matched"], join.values["n_total"]
    gap = matched - v["establecimientos"]
    drift = n_filas is not None and n_filas != v["n_filas"]
    flags = [
        (v["n_sectores"] < universe, "cobertura sectorial incompleta"),
        (gap < 0, "más establecimientos en la tabla que localizados"),
        (gap > 0, "correspondencia incompleta"),
        (total > 0 and join.values["n_orphan"] / total > orphan_limit, "demasiados huérfanos"),
        (join.values["n_ambiguous"] > 0, "puntos ambiguos"),
        (drift, "número de filas distinto del informe"),
        (v["n_invalidas"] > 0, "filas inválidas"),
        (v["sectores_sin_suma_uno"] > 0, "pesos que no suman uno"),
        (methods.get("sin_datos", 0) > 0, "pares sin datos"),
    ]
    raised = [text for on, text in flags if on]
    status = "CRITICAL" if v["n_invalidas"] > 0 or drift or gap < 0 else "WARNING" if raised else "OK"
    known = {m: methods.get(m, 0) for m in ("empleo", "establecimientos", "sin_datos")}
    return Report("audit", v | {"metodos": known, "banderas": raised, "estado": status})


def sector_totals(w: DataFrame, top: int = 10) -> DataFrame:
    """(sector_serio, n_establecimientos, empleo_total, sin_empleo): the ``top`` sectors by employment, then name."""
    return (
        w.groupBy("sector_serio")
        .agg(
            F.sum("n_establecimientos").alias("n_establecimientos"),
            F.sum("empleo_total").alias("empleo_total"),
            F.bool_and(F.col("omega_metodo").isin("establecimientos", "sin_datos")).alias("sin_empleo"),
        )
        .orderBy(F.desc("empleo_total"), "sector_serio")
        .limit(top)
    )


def without_geometry(w: DataFrame, zones: DataFrame) -> DataFrame:
    """(cvegeo): zones of the table that have no geometry."""
    known = zones.filter(F.col("geometry").isNotNull()).select("cvegeo").distinct()
    return w.select("cvegeo").distinct().join(known, "cvegeo", "left_anti")


def write(w: DataFrame, folder: str, epsg: int = 6372, **reports: Report) -> str:
    """warehouse.parquet and metadata.json in ``folder``, which may lie on any file system; the path of the metadata."""
    w.write.mode("overwrite").parquet(f"{folder}/warehouse.parquet")
    facts = w.agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("sector_serio")).alias("sectors")).first()
    meta = {"n_rows": facts["n_rows"], "epsg": epsg, "id_col": "cvegeo", "sectors": facts["sectors"]} | {k: r.to_dict() for k, r in reports.items()}
    write_document(w.sparkSession, path := f"{folder}/metadata.json", meta)
    return path


def resolve_reports(spark: SparkSession, metadata: str, join: str | None = None, integrity: str | None = None) -> tuple[dict, dict]:
    """(join report, integrity report): from files of their own where given, else from the metadata; a missing one raises."""
    meta = read_document(spark, metadata)
    found = [read_document(spark, path) if path else meta.get(name) for path, name in ((join, "join_report"), (integrity, "integrity_report"))]
    for name, r in zip(("join_report", "integrity_report"), found, strict=True):
        if r is None:
            raise ContractError(f"no {name}, neither as a file nor in the metadata")
    return found[0], found[1]


def omega_table(w: DataFrame) -> DataFrame:
    """(cvegeo, sector, omega, omega_metodo), one row per pair.

    A pair that comes again counts once when its rows agree; rows that disagree
    are refused, as no weight of them is right.
    """
    require(w, "cvegeo", "sector_serio", "omega", "omega_metodo")
    some = F.min("omega").alias("omega"), F.min("omega_metodo").alias("omega_metodo")
    same = F.max("omega").eqNullSafe(F.min("omega")) & F.max("omega_metodo").eqNullSafe(F.min("omega_metodo")) & F.count("omega").isin(F.lit(0), F.count("*"))
    d = w.groupBy("cvegeo", F.col("sector_serio").alias("sector")).agg(*some, same.alias("_igual"))
    refused = F.raise_error(F.concat(F.lit("several weights of "), "cvegeo", F.lit(" "), "sector")).cast("boolean")
    return d.filter(F.when(F.col("_igual"), True).otherwise(refused)).drop("_igual")


def omega_views(omega: DataFrame) -> DataFrame:
    """(sector, zonas, sin_omega, suma_omega): zones with and without a weight; a sector without any has zonas = 0."""
    return omega.groupBy("sector").agg(F.count("omega").alias("zonas"), F.count_if(F.col("omega").isNull()).alias("sin_omega"), F.coalesce(F.sum("omega"), F.lit(0.0)).alias("suma_omega"))


def omega_of(omega: DataFrame, sector: str) -> DataFrame:
    """(cvegeo, omega): the known weights of a sector."""
    return omega.filter((F.col("sector") == sector) & F.col("omega").isNotNull()).select("cvegeo", "omega")


def territory(zone: str | Column) -> dict[str, Column]:
    """entidad (2 digits) and municipio (3 digits, as within the entity) of a zone id; a dash when it is too short."""
    z = F.col(zone) if isinstance(zone, str) else zone
    return {
        "entidad": F.when(F.length(z) >= 2, F.substring(z, 1, 2)).otherwise("—"),
        "municipio": F.when(F.length(z) >= 5, F.substring(z, 3, 3)).otherwise("—"),
    }
