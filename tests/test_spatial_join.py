import math

import numpy as np
import pytest

from zonaria.operators import spatial_join as J

DENUE = "fila_id long, id string, latitud double, longitud double, hoja int, z int"
RING = "cvegeo string, geometry array<array<array<struct<x:double,y:double>>>>, parte int"


def metres(a, b):
    (y1, x1), (y2, x2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def points(spark, pts):
    return spark.createDataFrame([(k, i, y, x, 1, 2) for k, (i, y, x) in enumerate(pts)], DENUE)


def zones(spark, zs):
    return spark.createDataFrame([(c, None if g is None else [[[{"x": x, "y": y} for x, y in r] for r in p] for p in g], 7) for c, g in zs], RING)


def near(spark, pts, r=30.0):
    return sorted(tuple(x) for x in J.near_pairs(J.build_tree(J.establishments(points(spark, pts))), r).collect())


def brute(pts, r=30.0):
    ok = {p for p in pts if p[0] is not None and p[1] is not None and p[2] is not None and 14 <= p[1] <= 33 and -119 <= p[2] <= -86}
    return sorted({(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and metres(a[1:], b[1:]) <= r})


@pytest.mark.parametrize("leaf, node, small", [(10, 1 << 16, 32), (3, 16, 2), (2, 8, 4)])
def test_near_pairs(spark, monkeypatch, leaf, node, small):
    monkeypatch.setattr(J, "LEAF_BITS", leaf)
    monkeypatch.setattr(J, "NODE_POINTS", node)
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "FAN_BITS", 1)
    rng = np.random.default_rng(leaf)
    pts = [(f"{k:04d}", round(20 + float(y), 6), round(-100 + float(x), 6)) for k, (y, x) in enumerate(rng.uniform(0, 0.004, (120, 2)))]
    pts += [(f"c{k:03d}", 20.1, -100.1) for k in range(40)]  # one crowded place
    pts += [("0001", 20.1, -100.1), ("0001", 20.1, -100.1), ("dup", 25.0, -90.0), ("dup", 25.0, -90.0)]
    pts += [(None, 20.1, -100.1), ("nulo", None, -100.1), ("fuera", 0.0, 0.0), ("nan", math.nan, -100.1), ("borde", 14.0, -119.0), ("borde2", 14.0, -119.0)]
    got = near(spark, pts)
    assert got == brute(pts) and len(got) > 700


def test_distance_is_inclusive_and_empty(spark):
    step = math.degrees(30 / 6_371_000)
    pts = [("a", 20.0, -100.0), ("b", 20.0 + step * 0.9999999, -100.0), ("c", 20.0 - step * 1.0001, -100.0)]
    assert near(spark, pts) == [("a", "b")]
    assert near(spark, []) == [] and near(spark, [("a", 20.0, -100.0)]) == []


SQUARE = [(-100.0, 20.0), (-99.0, 20.0), (-99.0, 21.0), (-100.0, 21.0), (-100.0, 20.0)]
HOLE = [(-99.6, 20.4), (-99.4, 20.4), (-99.4, 20.6), (-99.6, 20.6)]


@pytest.mark.parametrize("leaf", [10, 1])
def test_zones(spark, monkeypatch, leaf):
    monkeypatch.setattr(J, "LEAF_BITS", leaf)
    monkeypatch.setattr(J, "NODE_POINTS", 4)
    monkeypatch.setattr(J, "ZONES", 2)
    pts = [("in", 20.2, -99.7), ("hole", 20.5, -99.5), ("holeborder", 20.4, -99.5), ("holecorner", 20.6, -99.4), ("corner", 20.0, -100.0), ("edge", 20.3, -100.0), ("slant", 20.3, -98.7), ("out", 22.0, -99.0), ("between", 20.5, -99.0)]
    zs = [("A", [[SQUARE[:-1], HOLE]]), ("A", [[SQUARE[:-1], HOLE]]), ("B", [[list(reversed(SQUARE))]]), ("N", None), ("E", []), ("E2", [[[]]]), ("T", [[[(-99.0, 20.0), (-98.0, 21.0), (-99.0, 21.0)]]]), ("M", [[[(-90.0, 15.0), (-89.0, 15.0), (-89.0, 16.0)]], [HOLE]])]
    tree = J.build_tree(J.establishments(points(spark, pts)))
    got = {tuple(r) for r in J.points_in_zones(tree, zones(spark, zs).selectExpr("cvegeo as zona", "geometry")).collect()}
    a = {"in", "holeborder", "holecorner", "corner", "edge", "between"}
    want = {(p, "A") for p in a} | {(p, "B") for p in a | {"hole"}} | {("slant", "T"), ("between", "T"), ("hole", "M"), ("holeborder", "M"), ("holecorner", "M")}
    assert got == want


def test_covers_decides_borders_exactly():
    edges = np.array([[0.1, 0.1, 0.7, 0.3], [0.7, 0.3, 0.1, 0.9], [0.1, 0.9, 0.1, 0.1]])
    on = [(0.1 + 0.6 * k, 0.1 + 0.2 * k) for k in (0.25, 0.5, 0.75)]
    x, y = (np.array([float(f"{v:.3f}") for v in c]) for c in zip(*on, strict=True))
    assert J.covers(edges, x, y).all()
    assert not J.covers(edges, x, y - 1e-9).any()


def test_neighbours_with_clashing_columns(spark):
    pts = [("b", 20.2, -99.7), ("a", 20.2, -99.7)]
    got = {tuple(r) for r in J.neighbours(points(spark, pts), zones(spark, [("A", [[SQUARE]])])).collect()}
    assert got == {("zona", "a", "A"), ("zona", "b", "A"), ("cerca", "a", "b")}
    assert J.neighbours(points(spark, []), zones(spark, [])).count() == 0


def test_hilbert_curve_visits_neighbours():
    g = np.arange(16)
    cx, cy = (c.ravel() for c in np.meshgrid(g, g))
    place = J.hilbert(cx / 15 * 360 - 180 + 1e-9, cy / 15 * 180 - 90 + 1e-9, 4)
    order = np.argsort(place)
    assert sorted(place) == list(range(256))
    assert (np.abs(np.diff(cx[order])) + np.abs(np.diff(cy[order])) == 1).all()
