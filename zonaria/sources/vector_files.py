"""Zones from shapefiles and GeoPackages, parsed where the files lie: one task per file."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.errors import ContractError
from zonaria.sources.files import read_geojson
from zonaria.sources.paths import exists

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
ROWS = f"archivo string, properties map<string,string>, geometry {GEOMETRY}"


def _points(xy: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def _turn(ring: np.ndarray) -> float:
    """Twice the signed area: below 0 for a clockwise ring."""
    d = ring - ring[0]
    return float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum())


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = *ring[:-1].T, *ring[1:].T
    at = (y1 > y) != (y2 > y)
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return bool((at & ((cross > 0) == (y2 > y1))).sum() % 2)


def polygons_of(rings: list[np.ndarray]) -> list[list[list[dict]]]:
    """Polygons from the rings of a shape: clockwise ones are outer, each other one is a hole of the outer ring that holds it."""
    rings = [r for r in rings if len(r)]
    outer = [r for r in rings if _turn(r) <= 0] or rings[:1]
    found = [[_points(r)] for r in outer]
    for hole in (r for r in rings if not any(r is o for o in outer)):
        at = next((k for k, o in enumerate(outer) if _holds(o, *hole[0])), len(outer) - 1)
        found[at].append(_points(hole))
    return found


def shapes(raw: bytes) -> Iterator[list | None]:
    """The geometry of every record of a .shp file; None for a null shape.  Only polygons are read."""
    at = 100
    while at + 12 <= len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        (kind,) = struct.unpack_from("<i", raw, at + 8)
        if kind == 0:
            yield None
        elif kind in (5, 15, 25):  # Polygon, PolygonZ, PolygonM: x and y come first
            parts, points = struct.unpack_from("<2i", raw, at + 44)
            first = [*struct.unpack_from(f"<{parts}i", raw, at + 52), points]
            xy = np.frombuffer(raw, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            yield polygons_of([xy[i:j] for i, j in zip(first, first[1:], strict=False)])
        else:
            raise ContractError(f"shapes of type {kind} are no polygons")
        at += 8 + 2 * words


def attributes(raw: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """The records of a .dbf file as texts, blanks as null; bytes that don't decode are read as Latin-1."""
    n, header, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), raw[at + 16]))
        at += 32
    out = []
    for k in range(n):
        p, row = header + k * width + 1, {}
        for name, size in fields:
            cell = raw[p : p + size]
            try:
                text = cell.decode(encoding).strip()
            except UnicodeDecodeError:
                text = cell.decode("latin-1").strip()
            row[name], p = text or None, p + size
        out.append(row)
    return out


def wkb_polygons(raw: bytes) -> list | None:
    """Polygons of a well-known binary Polygon or MultiPolygon, with or without z and m."""

    def one(at: int) -> tuple[list, int]:
        end = "<" if raw[at] else ">"
        (kind,) = struct.unpack_from(f"{end}I", raw, at + 1)
        flags, base = kind >> 28, kind & 0x0FFFFFFF
        extra = (flags >> 3 & 1) + (flags >> 2 & 1) or {0: 0, 1: 1, 2: 1, 3: 2}[base // 1000]
        base, at = base % 1000, at + 5 + (4 if flags >> 1 & 1 else 0)
        (n,) = struct.unpack_from(f"{end}I", raw, at)
        at += 4
        found = []
        if base == 6:
            for _ in range(n):
                part, at = one(at)
                found += part
            return found, at
        if base != 3:
            raise ContractError(f"geometries of type {base} are no polygons")
        for _ in range(n):
            (m,) = struct.unpack_from(f"{end}I", raw, at)
            xy = np.frombuffer(raw, f"{end}f8", m * (2 + extra), at + 4).reshape(m, 2 + extra)[:, :2]
            found.append(_points(xy))
            at += 4 + 8 * m * (2 + extra)
        return [found] if found else [], at

    return one(0)[0]


def package_rows(raw: bytes) -> Iterator[tuple[dict, list | None]]:
    """(attributes, geometry) of every row of the feature tables of a GeoPackage."""
    con = sqlite3.connect(":memory:")
    con.deserialize(raw)
    for table, column in con.execute("select table_name, column_name from gpkg_geometry_columns order by 1").fetchall():
        rows = con.execute(f'select * from "{table}"')
        names = [d[0] for d in rows.description]
        for r in rows:
            blob = r[names.index(column)]
            props = {k: None if v is None else str(v) for k, v in zip(names, r, strict=True) if k != column}
            if blob is None or blob[3] >> 4 & 1:  # null or flagged as empty
                yield props, None
            else:
                yield props, wkb_polygons(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])
    con.close()


def _parse(batches: Iterator[pd.DataFrame], package: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            if package:
                pairs = package_rows(r.content)
            else:
                if r.tabla is None:
                    raise ContractError(f"no .dbf beside {r.path}")
                pairs = zip(attributes(r.tabla), shapes(r.content), strict=True)
            rows = [(os.path.basename(r.path), props, geometry) for props, geometry in pairs]
            yield pd.DataFrame(rows, columns=["archivo", "properties", "geometry"])


def read_zones(spark: SparkSession, path: str, id_col: str = "cvegeo") -> DataFrame:
    """(id_col, properties, geometry) of a .geojson, .shp or .gpkg file, by its ending.

    A folder name with ``*.shp`` or ``*.gpkg`` reads all of its files, one task
    each; a file is held whole by its task and may have 2 GB.  The id is the
    attribute of that name in any letter case.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".shp", ".gpkg"):
        return read_geojson(spark, path, id_col)
    if "*" not in path and not exists(spark, path):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if kind == ".shp":
        beside = spark.read.format("binaryFile").load(path[: -len(kind)] + ".dbf").select(F.regexp_replace("path", r"\.[^.]+$", "").alias("_s"), F.col("content").alias("tabla"))
        files = files.join(beside, F.regexp_replace("path", r"\.[^.]+$", "") == F.col("_s"), "left").drop("_s")
    rows = files.mapInPandas(lambda it: _parse(it, kind == ".gpkg"), ROWS)
    named = F.get(F.map_values(F.map_filter("properties", lambda k, v: F.lower(F.trim(k)) == id_col)), F.lit(0))
    return rows.select(named.alias(id_col), "properties", "geometry")
