"""Zones and establishments: contracts, tags that never drop a row, normalisation, shocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.errors import ContractError, require
from zonaria.functions import geometry as G
from zonaria.functions.codes import midpoint, norm_code
from zonaria.report import Report

# Column names under which a register may bring each field, in order of preference, and its box.
DENUE_ALIASES = {
    "id": ("id", "clee", "id_denue", "folio"),
    "nombre": ("nom_estab", "nombre", "nombre_establecimiento"),
    "scian": ("codigo_act", "scian", "clase_actividad", "cod_scian", "codigo_scian"),
    "lat": ("latitud", "lat", "y"),
    "lon": ("longitud", "lon", "lng", "x"),
    "per_ocu": ("per_ocu", "personal_ocupado", "estrato_personal"),
}
LAT_RANGE, LON_RANGE = (14.0, 33.0), (-119.0, -86.0)


def resolve_aliases(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """For each field the first alias among the columns, compared in lower case without white space."""
    have = {c.strip().lower(): c for c in reversed(columns)}
    return {f: next((have[a] for a in names if a in have), None) for f, names in aliases.items()}


def homologate(df: DataFrame) -> DataFrame:
    """Column names in lower case without white space."""
    return df.toDF(*(c.strip().lower() for c in df.columns))


def with_unique(df: DataFrame, key: Column, name: str, null_unique: bool | None = None) -> DataFrame:
    """``df`` with the boolean ``name``: the row's key occurs once.

    Nulls are each other's repeats, unless ``null_unique`` says otherwise.  The
    repeated keys are counted by an aggregate and joined back: a window would
    bring all rows of a hot key, or all nulls, into one task.
    """
    if null_unique is None:
        null_unique = df.filter(key.isNull()).limit(2).count() == 1
    again = df.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(F.count("*").alias("_times")).filter("_times > 1").select("_key")
    unique = F.when(key.isNull(), F.lit(null_unique)).otherwise(F.col("_key").isNull())
    return df.join(again, key == F.col("_key"), "left").withColumn(name, unique).drop("_key")


def _all_of(checks: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & F.col(c)
    return out


def tag_zones(zones: DataFrame, id_col: str = "cvegeo") -> DataFrame:
    """Adds six chk_ columns and ``_valid_geometry``; drops nothing.

    A geometry is valid when its rings are closed, have four points and don't
    cross themselves.  Area is only asked of a valid one.  Without the id
    column no id is unique.
    """
    d = zones.withColumn("chk_not_null", F.col("geometry").isNotNull())
    d = d.withColumn("chk_not_empty", ~G.is_empty("geometry"))
    d = d.withColumn("chk_is_valid", F.coalesce(F.col("chk_not_empty") & G.rings_closed("geometry") & G.is_simple("geometry"), F.lit(False)))
    d = d.withColumn("chk_type_ok", F.coalesce(F.exists("geometry", lambda poly: F.size(poly) > 0), F.lit(False)))
    d = d.withColumn("chk_area_positive", F.col("chk_is_valid") & F.coalesce(G.area("geometry") > 0, F.lit(False)))
    d = with_unique(d, F.col(id_col), "chk_id_unique") if id_col in zones.columns else d.withColumn("chk_id_unique", F.lit(False))
    return d.withColumn("_valid_geometry", _all_of([c for c in d.columns if c.startswith("chk_")]))


def normalise_zones(zones: DataFrame, projected: bool = False) -> DataFrame:
    """Zones on the metric grid with area_m2, perimeter_m and the centroid in degrees."""
    d = homologate(zones)
    d = d if projected else d.withColumn("geometry", G.reproject("geometry"))
    d = d.withColumns({"area_m2": G.area("geometry"), "perimeter_m": G.perimeter("geometry"), "_c": G.centroid("geometry")})
    d = d.withColumn("_c", G.unproject(F.col("_c.x"), F.col("_c.y")))
    return d.withColumns({"centroid_lon": F.col("_c.x"), "centroid_lat": F.col("_c.y")}).drop("_c")


def tag_establishments(raw: DataFrame) -> DataFrame:
    """Adds chk_ columns and ``_valid``: coordinates present and in the box, activity code present, id unique."""
    at = resolve_aliases(raw.columns, DENUE_ALIASES)
    for f in ("lat", "lon", "scian"):
        if at[f] is None:
            raise ContractError(f"no column for {f}")
    number = lambda c: F.col(c).try_cast("double")
    lat, lon, code = number(at["lat"]), number(at["lon"]), F.trim(F.col(at["scian"]).cast("string"))
    within = lambda v, r: F.coalesce(v.between(*r), F.lit(False))
    d = raw.withColumns(
        {
            "chk_lat_present": lat.isNotNull() & ~F.isnan(lat),
            "chk_lon_present": lon.isNotNull() & ~F.isnan(lon),
            "chk_lat_range": within(lat, LAT_RANGE),
            "chk_lon_range": within(lon, LON_RANGE),
            "chk_scian_present": F.coalesce(code != "", F.lit(False)),
        }
    )
    d = with_unique(d, F.col(at["id"]), "chk_id_unique") if at["id"] else d.withColumn("chk_id_unique", F.lit(False))
    return d.withColumn("_valid", _all_of([c for c in d.columns if c.startswith("chk_")]))


def filter_valid(tagged: DataFrame, flag: str) -> DataFrame:
    """The rows whose tag holds; the tag must be there."""
    require(tagged, flag)
    return tagged.filter(flag)


def normalise_establishments(raw: DataFrame) -> DataFrame:
    """(id, nombre, scian, per_ocu, empleo_estimado, x, y): logical fields whatever their names; unknown size bands give null."""
    at = resolve_aliases(raw.columns, DENUE_ALIASES)
    pick = lambda f: F.col(at[f]) if at[f] else F.lit(None).cast("string")
    return raw.select(
        pick("id").alias("id"),
        pick("nombre").alias("nombre"),
        norm_code(pick("scian").cast("string")).alias("scian"),
        pick("per_ocu").alias("per_ocu"),
        midpoint(F.trim(pick("per_ocu"))).alias("empleo_estimado"),
        pick("lon").try_cast("double").alias("x"),
        pick("lat").try_cast("double").alias("y"),
    )


def tag_report(tagged: DataFrame, flag: str, stage: str) -> Report:
    """Rows, valid rows and failures of every check, by one aggregate."""
    checks = [c for c in tagged.columns if c.startswith("chk_")]
    return Report.of(stage, tagged.agg(F.count("*").alias("n_total"), F.count_if(flag).alias("n_valid"), *(F.count_if(~F.col(c)).alias(f"n_fail_{c[4:]}") for c in checks)))


def shock_table(spark: SparkSession, shock) -> DataFrame:
    """(sector, delta_x) from a mapping, a pandas Series or a DataFrame with (sector|sector_serio, delta_x); sectors must be unique."""
    if isinstance(shock, DataFrame):
        name = next((c for c in ("sector", "sector_serio") if c in shock.columns), None)
        if name is None or "delta_x" not in shock.columns:
            raise ContractError("a shock table has the columns sector and delta_x")
        out = shock.select(F.col(name).cast("string").alias("sector"), F.col("delta_x").cast("double").alias("delta_x"))
    elif hasattr(shock, "items"):
        rows = [(str(k), float(v)) for k, v in shock.items()]
        out = spark.createDataFrame(rows, "sector string, delta_x double")
    else:
        raise ContractError(f"no shock: {type(shock).__name__}")
    twice = out.groupBy("sector").count().filter("count > 1").limit(10).collect()
    if twice:
        raise ContractError("repeated sectors: " + ", ".join(str(r["sector"]) for r in twice))
    return out


def positional_shock(sectors: Sequence[str], values: Sequence[float]) -> dict[str, float]:
    if len(sectors) != len(values):
        raise ContractError(f"{len(sectors)} sectors and {len(values)} values")
    return dict(zip(sectors, map(float, values), strict=True))


def shock_from_detail(detail: DataFrame) -> DataFrame:
    """(sector, delta_x) from an input-output result (scian, delta_X_pesos)."""
    require(detail, "scian", "delta_X_pesos")
    return shock_table(detail.sparkSession, detail.select(F.col("scian").alias("sector"), F.col("delta_X_pesos").alias("delta_x")))
