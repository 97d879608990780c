"""Regions merged by a group: common borders cancel, what is left is stitched into rings."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaria.functions import geometry as G

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _ring_area(r: list[tuple]) -> float:
    x0, y0 = r[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2


def _inside(p: tuple, ring: list[tuple]) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def stitch(edges: list[tuple]) -> list[list[list[tuple]]]:
    """Polygons (outer ring, holes…) of directed edges with the interior on their left."""
    out = defaultdict(list)
    for x1, y1, x2, y2 in sorted(edges, reverse=True):
        out[x1, y1].append((x2, y2))
    rings = []
    while out:
        start = min(out)
        ring, at = [], start
        while True:
            ring.append(at)
            nxt = out[at].pop()
            if not out[at]:
                del out[at]
            if nxt in ring:  # a point met again closes a ring of its own
                k = ring.index(nxt)
                rings.append(ring[k:])
                ring = ring[:k]
                if nxt not in out:
                    break
            at = nxt
            if at not in out:
                break
    outer = [[r] for r in rings if len(r) > 2 and _ring_area(r) > 0]
    for hole in (r for r in rings if len(r) > 2 and _ring_area(r) < 0):
        mid = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        owners = [p for p in outer if _inside(mid, p[0])]
        if owners:
            min(owners, key=lambda p: _ring_area(p[0])).append(hole)
    return outer


def dissolve(zones: DataFrame, group: str) -> DataFrame:
    """(group, geometry): the union of each group's zones.

    Directed edges that occur once in each direction cancel by an aggregate;
    a task stitches only a group's outline.  Neighbours must share their
    vertices: a border with a vertex on one side only stays.
    """
    kind = dict(zones.dtypes)[group]

    def of_ring(r, k):
        r = F.filter(r, lambda p: p.isNotNull())
        flip = (G.ring_area(r) < 0) == (k == 0)
        r = F.when(flip, F.reverse(r)).otherwise(r)
        after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.zip_with(r, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    edges = zones.filter("geometry is not null").select(group, F.explode(F.flatten(F.flatten(F.transform("geometry", lambda poly: F.transform(poly, of_ring))))).alias("e")).select(group, "e.*")
    edges = edges.filter("x1 <> x2 or y1 <> y2")
    forward = F.struct("x1", "y1") < F.struct("x2", "y2")
    low, high = F.least(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))), F.greatest(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")))
    net = edges.select(group, low.alias("a"), high.alias("b"), F.when(forward, 1).otherwise(-1).alias("d")).groupBy(group, "a", "b").agg(F.sum("d").alias("d")).filter("d <> 0")
    side = net.select(group, F.when(F.col("d") > 0, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(F.col("d") > 0, F.col("b")).otherwise(F.col("a")).alias("q"))
    side = side.select(group, F.col("p.x1").alias("x1"), F.col("p.y1").alias("y1"), F.col("q.x1").alias("x2"), F.col("q.y1").alias("y2"))
    geom = pa.list_(pa.list_(pa.list_(_POINT)))

    def run(t: pa.Table) -> pa.Table:
        polys = stitch(list(zip(*(t[c].to_pylist() for c in ("x1", "y1", "x2", "y2")), strict=True)))
        rings = [[[{"x": x, "y": y} for x, y in [*r, r[0]]] for r in p] for p in polys]
        return pa.table({group: t[group].slice(0, 1), "geometry": pa.array([rings], geom)})

    return side.groupBy(group).applyInArrow(run, f"`{group}` {kind}, geometry {G.GEOMETRY}")
