"""Geometry as column algebra: a geometry is an array of polygons, a polygon an array of rings (the first outer,
others holes), a ring an array of struct(x, y).  A ring needs no closing point; either direction will do."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _over_edges(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the ring's edges, the closing one included (a closed ring's has no length)."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, f), F.lit(0.0), lambda a, v: a + v)


def _cross(o: Column) -> Callable[[Column, Column], Column]:
    return lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])


def ring_area(ring: Column) -> Column:
    """Signed area, positive when counter-clockwise; taken from the first vertex to keep digits."""
    return _over_edges(ring, _cross(F.get(ring, F.lit(0)))) / 2


def _sum_polygons(geometry: Column, of_ring: Callable[[Column], Column]) -> Column:
    """Outer rings count +, holes -."""
    signed = lambda ring, k: of_ring(ring) * F.when(k == 0, 1.0).otherwise(-1.0)
    return F.aggregate(F.transform(geometry, lambda poly: F.aggregate(F.transform(poly, signed), F.lit(0.0), lambda a, v: a + v)), F.lit(0.0), lambda a, v: a + v)


def area(geometry: str | Column) -> Column:
    return _sum_polygons(_col(geometry), lambda r: F.abs(ring_area(r)))


def perimeter(geometry: str | Column) -> Column:
    length = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    return F.aggregate(F.transform(F.flatten(_col(geometry)), lambda r: _over_edges(r, length)), F.lit(0.0), lambda a, v: a + v)


def centroid(geometry: str | Column) -> Column:
    """struct(x, y): area-weighted, null without area."""
    g = _col(geometry)

    def moment(axis: str) -> Callable[[Column], Column]:
        def of_ring(r: Column) -> Column:
            o = F.get(r, F.lit(0))
            m = _over_edges(r, lambda p, q: (p[axis] - o[axis] + q[axis] - o[axis]) * _cross(o)(p, q)) / 6
            a = ring_area(r)
            return (m + o[axis] * a) * F.signum(a)

        return of_ring

    a = area(g)
    part = lambda axis: F.when(a > 0, _sum_polygons(g, moment(axis)) / a)
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def box(geometry: str | Column) -> list[Column]:
    corners = F.flatten(F.flatten(_col(geometry)))
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return [F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax")]


def is_empty(geometry: str | Column) -> Column:
    return F.coalesce(F.size(F.flatten(F.flatten(_col(geometry)))), F.lit(0)) <= 0


def rings_closed(geometry: str | Column) -> Column:
    """Every ring ends at its first point and has four points or more."""
    ok = lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1))
    return F.forall(F.flatten(_col(geometry)), ok)


def _crosses_itself(ring: np.ndarray, cells: int = 1_000_000) -> bool:
    """Whether two edges of a ring properly cross.

    Edges are sorted by where they begin in x; each is compared with those that
    begin before it ends, in arrays of bounded size, so a long ring of short
    edges takes little more than its sort.
    """
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    e = np.hstack([ring, np.roll(ring, -1, axis=0)])
    low = np.minimum(e[:, 0], e[:, 2])
    e = e[np.argsort(low, kind="stable")]
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    bottom, top = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    follow = np.searchsorted(low, high, "right") - np.arange(len(e)) - 1  # edges that begin in x within this one
    side = lambda f, x, y: np.sign((f[:, 2] - f[:, 0]) * (y - f[:, 1]) - (f[:, 3] - f[:, 1]) * (x - f[:, 0]))
    upto, at = np.cumsum(follow), 0
    while at < len(e):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + cells, "right")))
        n = follow[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = (bottom[i] <= top[j]) & (bottom[j] <= top[i])
        f, g = e[i[near]], e[j[near]]
        if ((side(f, g[:, 0], g[:, 1]) * side(f, g[:, 2], g[:, 3]) < 0) & (side(g, f[:, 0], f[:, 1]) * side(g, f[:, 2], f[:, 3]) < 0)).any():
            return True
        at = end
    return False


def is_simple(geometry: str | Column) -> Column:
    """No ring properly crosses itself; a null geometry is simple."""

    def ring(r) -> np.ndarray:
        return np.array([(p["x"], p["y"]) for p in r], dtype=float)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([g is None or not any(_crosses_itself(ring(r)) for poly in g for r in poly if len(r) > 3) for g in a.to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean")(_col(geometry))


def _peucker(xy: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, p = xy[j] - xy[i], xy[i + 1 : j] - xy[i]
        n = math.hypot(*d)
        dist = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / n if n else np.hypot(p[:, 0], p[:, 1])
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return xy[keep]


def simplify(geometry: str | Column, tolerance: float) -> Column:
    """Douglas-Peucker per ring; a ring that would keep fewer than four points stays as it is.

    Rings are simplified one by one, so neighbours may part along a common edge.
    """

    def one(ring: list) -> list:
        xy = np.array([(p["x"], p["y"]) for p in ring], dtype=float)
        if len(xy) < 4:
            return ring
        if not (xy[0] == xy[-1]).all():
            xy = np.vstack([xy, xy[:1]])
        new = _peucker(xy, tolerance)
        return [{"x": float(x), "y": float(y)} for x, y in (new if len(new) >= 4 else xy)]

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.list_(pa.list_(pa.list_(point)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if g is None else [[one(r) for r in poly] for poly in g] for g in a.to_pylist()], kind)

    return F.arrow_udf(run, GEOMETRY)(_col(geometry))


# The Lambert conformal conic of the Mexican grid (EPSG:6372) on the GRS 80 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
LAT_1, LAT_2, LAT_0, LON_0 = 17.5, 29.5, 12.0, -102.0
FALSE_EAST, FALSE_NORTH = 2_500_000.0, 0.0

_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_r1, _r2, _r0 = (math.radians(v) for v in (LAT_1, LAT_2, LAT_0))
_N = math.log(_m(_r1) / _m(_r2)) / math.log(_t(_r1) / _t(_r2))
_F = _m(_r1) / (_N * _t(_r1) ** _N)
_RHO0 = SEMI_MAJOR * _F * _t(_r0) ** _N


def project(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres on the Mexican grid from degrees."""
    phi = F.radians(lat)
    s = F.sin(phi) * _E
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    rho = F.pow(t, F.lit(_N)) * (SEMI_MAJOR * _F)
    theta = (F.radians(lon) - math.radians(LON_0)) * _N
    return F.struct((FALSE_EAST + rho * F.sin(theta)).alias("x"), (FALSE_NORTH + _RHO0 - rho * F.cos(theta)).alias("y"))


def unproject(x: Column, y: Column) -> Column:
    """struct(x=lon, y=lat) in degrees; the latitude by the series of the conformal latitude (below 1e-9 degrees)."""
    dx, dy = x - FALSE_EAST, F.lit(_RHO0) - (y - FALSE_NORTH)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (SEMI_MAJOR * _F), F.lit(1 / _N))
    chi = math.pi / 2 - F.atan(t) * 2
    e2, e4, e6, e8 = (_E**k for k in (2, 4, 6, 8))
    phi = chi
    for k, c in enumerate((e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280), 1):
        phi = phi + F.sin(chi * (2 * k)) * c
    return F.struct((F.degrees(F.atan2(dx, dy) / _N) + LON_0).alias("x"), F.degrees(phi).alias("y"))


def reproject(geometry: str | Column, inverse: bool = False) -> Column:
    f = unproject if inverse else project
    return F.transform(_col(geometry), lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: f(p["x"], p["y"]))))
