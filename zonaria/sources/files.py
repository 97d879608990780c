"""Readers and writers of the file formats around the tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.errors import ContractError, require
from zonaria.functions import geometry as G
from zonaria.report import Report
from zonaria.sources.paths import write_document

_POLYGON = "struct<coordinates:array<array<array<double>>>>"
_MULTI = "struct<coordinates:array<array<array<array<double>>>>>"


def _existing(path: str) -> str:
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return path


def _rings(polygon: Column) -> Column:
    return F.transform(polygon, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def geometry_of(text: str | Column) -> Column:
    """The geometry of a GeoJSON Polygon or MultiPolygon text; null for anything else."""
    t = F.col(text) if isinstance(text, str) else text
    kind = F.get_json_object(t, "$.type")
    one = F.array(_rings(F.from_json(t, _POLYGON)["coordinates"]))
    many = F.transform(F.from_json(t, _MULTI)["coordinates"], _rings)
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def read_geojson(spark: SparkSession, path: str, id_col: str = "cvegeo", lines: bool = False) -> DataFrame:
    """(id_col, properties, geometry) of a FeatureCollection, or of one feature per line (which splits across tasks).

    The id is the property of that name in any letter case, null where absent.
    """
    feature = "struct<properties:map<string,string>,geometry:string>"
    if lines:
        f = spark.read.text(_existing(path)).select(F.from_json("value", feature).alias("f")).select("f.*")
    else:
        f = spark.read.schema(f"features array<{feature}>").json(_existing(path), multiLine=True).select(F.inline("features"))
    named = F.get(F.map_values(F.map_filter("properties", lambda k, v: F.lower(F.trim(k)) == id_col)), F.lit(0))
    return f.select(named.alias(id_col), "properties", geometry_of("geometry").alias("geometry"))


def as_geojson(geometry: str | Column) -> Column:
    """GeoJSON text of a geometry: a Polygon, or a MultiPolygon of several."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    coords = F.transform(g, lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(coords, F.lit(0)).alias("coordinates")))
    return F.when(F.size(g) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))))


def features(df: DataFrame, columns: Sequence[str], simplify: float | None = None, to_degrees: bool = False) -> DataFrame:
    """(value): one GeoJSON feature per row with a geometry.  Rows without one are left out; ``without_geometry`` lists them."""
    require(df, "geometry", *columns)
    g = F.col("geometry") if simplify is None else G.simplify("geometry", simplify)
    g = G.reproject(g, inverse=True) if to_degrees else g
    props = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), as_geojson("geometry"), F.lit("}"))
    return df.filter(~G.is_empty("geometry")).withColumn("geometry", g).select(text.alias("value"))


def without_geometry(df: DataFrame, id_col: str = "cvegeo") -> DataFrame:
    return df.filter(F.col("geometry").isNull() | G.is_empty("geometry")).select(id_col)


def write_geojson_lines(df: DataFrame, path: str, columns: Sequence[str], **options) -> None:
    """One feature per line, a file per task."""
    features(df, columns, **options).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, columns: Sequence[str], **options) -> int:
    """One FeatureCollection file, streamed a partition at a time; the number of features."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for r in features(df, columns, **options).toLocalIterator():
            f.write(("," if n else "") + "\n" + r["value"])
            n += 1
        f.write("\n]}\n")
    return n


def dashboard_layer(df: DataFrame, value: str, id_col: str = "cvegeo", limit: int = 100_000) -> dict:
    """A map layer for a screen: FeatureCollection, {id: value} (NaN as null), min, max and mean; at most ``limit`` zones."""
    require(df, id_col, value, "geometry")
    clean = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None)))
    rows = clean.select(id_col, value).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ContractError(f"more than {limit} zones in a layer")
    s = clean.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")).first().asDict()
    feats = [json.loads(r["value"]) for r in features(clean, [id_col]).collect()]
    return {"geojson": {"type": "FeatureCollection", "features": feats}, "values": {r[id_col]: r[value] for r in rows}, **s}


def read_establishments(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """The register's CSV, every column a string.  Without an encoding: UTF-8, or Latin-1 where that leaves broken characters."""
    read = lambda enc: spark.read.option("header", True).option("encoding", enc).option("multiLine", False).csv(_existing(path))
    if encoding:
        return read(encoding)
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return read("ISO-8859-1" if broken else "UTF-8")


def read_contract(spark: SparkSession, path: str, columns: Sequence[str], fill: bool = False) -> DataFrame:
    """A CSV of strings that must have ``columns``; a byte order mark before the first is dropped, nulls may be made blank."""
    d = spark.read.option("header", True).csv(_existing(path))
    d = d.toDF(*(c.lstrip("\ufeff").strip() for c in d.columns))
    require(d, *columns)
    d = d.select(*columns)
    return d.na.fill("") if fill else d


def write_contract(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A CSV with exactly ``columns`` in this order; other tables are refused."""
    if list(df.columns) != list(columns):
        raise ContractError(f"columns {df.columns}, expected {list(columns)}")
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(path: str) -> dict | None:
    """A small JSON document, None where there is none."""
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else None


def read_communities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """((sector, cluster_id), (cluster_id, nombre, sectores, …)) of a community artefact, None where there is none."""
    doc = read_json(path)
    if doc is None:
        return None
    pairs = [(s, int(c)) for s, c in doc.get("sector_to_cluster", {}).items()]
    meta = [
        (int(k), v.get("nombre"), list(v.get("sectores", [])), int(v.get("n_sectores", len(v.get("sectores", [])))), *(v.get(c) for c in ("centralidad_media", "bl_media", "fl_media")))
        for k, v in doc.get("clusters", {}).items()
    ]
    return (
        spark.createDataFrame(pairs, "sector string, cluster_id int"),
        spark.createDataFrame(meta, "cluster_id int, nombre string, sectores array<string>, n_sectores int, centralidad_media double, bl_media double, fl_media double"),
    )


def write_communities(communities: DataFrame, path: str, modularity: float, params: dict) -> None:
    """The community artefact of a partition (see ``operators.clusters.communities``); it is bounded by the sectors."""
    rows = communities.collect()
    clusters: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["cluster_id"], -r["centralidad"], r["sector"])):
        c = clusters.setdefault(str(r["cluster_id"]), {k: r[k] for k in ("nombre", "n_sectores", "centralidad_media", "bl_media", "fl_media")} | {"sectores": []})
        c["sectores"].append(r["sector"])
    doc = {"generated_at": datetime.now(UTC).isoformat(), "params": params, "n_clusters": len(clusters), "modularity": round(modularity, 6), "clusters": clusters}
    doc |= {"sector_to_cluster": {r["sector"]: r["cluster_id"] for r in rows}, "sector_centrality": {r["sector"]: r["centralidad"] for r in rows}}
    write_document(communities.sparkSession, path, doc)


def write_shock(allocated: DataFrame, zones: DataFrame, path: str) -> None:
    """An allocated shock with the geometry of its zones, for later stages that read it."""
    from zonaria.operators.results import with_geometry

    with_geometry(allocated, zones).write.mode("overwrite").parquet(path)


def read_shock(spark: SparkSession, path: str) -> DataFrame:
    """(id, s): the shock of each zone of a written table, summed over sectors."""
    d = spark.read.parquet(_existing(path))
    require(d, "cvegeo", "shock_ageb")
    return d.groupBy(F.col("cvegeo").alias("id")).agg(F.sum("shock_ageb").alias("s"))


def write_zones(validated: DataFrame, normalised: DataFrame, report: Report, folder: str) -> None:
    """Validated and normalised zones as Parquet with the report of their checks."""
    validated.write.mode("overwrite").parquet(f"{folder}/zonas_validadas.parquet")
    normalised.write.mode("overwrite").parquet(f"{folder}/zonas_normalizadas.parquet")
    write_document(validated.sparkSession, f"{folder}/reporte_zonas.json", report.to_dict())
