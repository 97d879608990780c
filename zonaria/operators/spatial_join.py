"""Points near other points or inside regions, by a dual-tree join.

The points are sorted along a Hilbert curve and cut into leaves of equal size;
leaves form nodes, nodes form nodes of nodes.  Each node knows its bounding box
(all of it DataFrames: a level has one row per node).  The join descends both
trees level by level with equi-joins on the parents: pairs of nodes too far
apart are dropped, pairs of leaves certainly near are taken wholesale, and only
the uncertain leaf pairs reach a task that looks at their points, which again
descends two small trees in arrays.  A leaf holds LEAF points however crowded a
place is, so no task sees more than a bounded number of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaria.session import materialise

RADIUS_M = 6_371_000.0
LEAF_BITS = 10  #: points per leaf: 2 ** LEAF_BITS
ROW_BITS = 33  #: bits of the row number in monotonically_increasing_id
FAN_BITS = 5  #: nodes per parent above the partitions: 2 ** FAN_BITS
NODE_POINTS = 1 << 16  #: points per partition of the sort
PARTNERS = 8  #: leaves compared with a leaf in one task
ZONES = 64  #: regions compared with a leaf in one task
MANY_EDGES = 256  #: edges from which a polygon is compared with nodes of a leaf first
CELLS = 1_000_000  #: cells of an array at once
SMALL = 16  #: points per leaf of a task's own trees
BOX = ("xmin", "xmax", "ymin", "ymax")


@dataclass(frozen=True)
class Tree:
    """``leaves``: (nodo, padre, ids, xs, ys, box), a row per leaf with its points along the curve.

    ``levels``: (nodo, padre, box), the root's children first, the leaves last.
    """

    leaves: DataFrame
    levels: list[DataFrame]


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 24) -> np.ndarray:
    """Place of longitudes and latitudes on a Hilbert curve; neighbours on it are neighbours on the ground."""
    side = (1 << bits) - 1
    a = np.clip((x + 180) / 360 * side, 0, side).astype(np.int64)
    b = np.clip((y + 90) / 180 * side, 0, side).astype(np.int64)
    place = np.zeros(len(a), dtype=np.int64)
    for k in range(bits - 1, -1, -1):
        right, upper = a >> k & 1, b >> k & 1
        place = place << 2 | (3 * right ^ upper)
        turn = (upper == 0) & (right == 1)
        a, b = np.where(turn, side - a, a), np.where(turn, side - b, b)
        a, b = np.where(upper == 1, a, b), np.where(upper == 1, b, a)
    return place


def curve(x: str, y: str) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series(hilbert(a.to_numpy(), b.to_numpy())), "bigint")(F.col(x), F.col(y))


def _pack(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Leaves of 2 ** bits points, in the order they come; the last of a partition may be smaller."""
    part, held, made = TaskContext.get().partitionId(), [], 0

    def leaves(t: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal made
        for at in range(0, len(t), 64 << bits):  # some leaves to a batch, so that it stays small
            some = t.slice(at, 64 << bits).combine_chunks()
            ends = np.append(np.arange(0, len(some), 1 << bits), len(some)).astype(np.int32)
            ids, x, y = (some.column(c).chunk(0) for c in ("id", "x", "y"))
            lists = [pa.ListArray.from_arrays(ends, v) for v in (ids, x, y)]
            box = [pa.array(f.reduceat(v.to_numpy(), ends[:-1])) for v in (x, y) for f in (np.minimum, np.maximum)]
            nodes = (part << (ROW_BITS - bits)) + made + np.arange(len(ends) - 1)
            made += len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(nodes), part)), *lists, *box], names=["nodo", "padre", "ids", "xs", "ys", *BOX])

    for b in batches:
        held.append(b)
        n = sum(h.num_rows for h in held)
        full = n >> bits << bits
        if full:
            t = pa.Table.from_batches(held)
            yield from leaves(t.slice(0, full))
            held = t.slice(full).to_batches()
    if sum(h.num_rows for h in held):
        yield from leaves(pa.Table.from_batches(held))


def build_tree(points: DataFrame) -> Tree:
    """The tree over (id, x, y); a row that comes more than once counts once.

    Equal places are ordered by id, so that they too are cut into leaves, and
    equal rows meet in one range of the sort, where they are removed without a
    shuffle of their own.
    """
    n = points.count()
    parts = max(1, -(-n // NODE_POINTS))
    if n > NODE_POINTS:
        parts = max(parts, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pts = points.select("id", "x", "y", curve("x", "y").alias("z")).repartitionByRange(parts, "z", "id").distinct().sortWithinPartitions("z", "id")
    kind, bits = dict(points.dtypes)["id"], LEAF_BITS
    schema = f"nodo bigint, padre bigint, ids array<{kind}>, xs array<double>, ys array<double>, {', '.join(f'{c} double' for c in BOX)}"
    leaves = materialise(pts.select("id", "x", "y").mapInArrow(lambda it: _pack(it, bits), schema))
    up = (F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    levels, top, bits = [leaves.select("nodo", "padre", *BOX)], parts, FAN_BITS
    while top > 1:
        below = levels[0].groupBy("padre").agg(*up)
        levels.insert(0, below.select(F.col("padre").alias("nodo"), F.shiftright("padre", bits).alias("padre"), *BOX))
        top = -(-top // (1 << bits))
    return Tree(leaves, levels)


def _cos_span(a: str, b: str, least: bool) -> Column:
    """Smallest or largest cosine of a latitude in either box."""
    far = F.greatest(*(F.abs(F.col(f"{s}.{c}")) for s in (a, b) for c in ("ymin", "ymax")))
    if least:
        return F.cos(F.radians(far))
    spans = F.least(*(F.when((F.col(f"{s}.ymin") <= 0) & (F.col(f"{s}.ymax") >= 0), 0.0).otherwise(F.least(F.abs(F.col(f"{s}.ymin")), F.abs(F.col(f"{s}.ymax")))) for s in (a, b)))
    return F.cos(F.radians(spans))


def _hav(dx: Column, dy: Column, cos: Column) -> Column:
    s = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    return s(dy) + cos * cos * s(dx)


def _gap(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{a}.{low}") - F.col(f"{b}.{high}"), F.col(f"{b}.{low}") - F.col(f"{a}.{high}"))


def _reach(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.col(f"{a}.{high}") - F.col(f"{b}.{low}"), F.col(f"{b}.{high}") - F.col(f"{a}.{low}"))


def _nearest(a: str, b: str) -> Column:
    """Lower bound of the haversine between points of two boxes."""
    return _hav(_gap(a, b, "xmin", "xmax"), _gap(a, b, "ymin", "ymax"), _cos_span(a, b, True))


def _farthest(a: str, b: str) -> Column:
    return _hav(_reach(a, b, "xmin", "xmax"), _reach(a, b, "ymin", "ymax"), _cos_span(a, b, False))


def _limit(metres: float) -> float:
    return math.sin(metres / (2 * RADIUS_M)) ** 2


def leaf_pairs(tree: Tree, metres: float) -> DataFrame:
    """(a, b, seguro, box of a): leaves a <= b that may hold points within ``metres``; seguro when all do."""
    first = tree.levels[0].select("padre").distinct()
    pairs = first.select(F.col("padre").alias("a"), F.col("padre").alias("b"))
    loose, tight = _limit(metres) * (1 + 1e-9), _limit(metres) * (1 - 1e-9)
    for k, level in enumerate(tree.levels):
        last = k == len(tree.levels) - 1
        joined = (
            pairs.alias("p")
            .join(level.alias("l"), F.col("l.padre") == F.col("p.a"))
            .join(level.alias("r"), F.col("r.padre") == F.col("p.b"))
            .filter((F.col("l.nodo") <= F.col("r.nodo")) & (_nearest("l", "r") <= loose))
        )
        more = [(_farthest("l", "r") <= tight).alias("seguro"), *(F.col(f"l.{c}").alias(c) for c in BOX)] if last else []
        pairs = joined.select(F.col("l.nodo").alias("a"), F.col("r.nodo").alias("b"), *more)
    return materialise(pairs)


class _Boxes:
    """A task's own tree: points in curve order padded to SMALL * 2 ** depth, with boxes per level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int):
        size = SMALL << depth
        self.n = len(x)
        pad = np.minimum(np.arange(size), self.n - 1)
        self.x, self.y = x[pad], y[pad]
        lon, lat = np.radians(self.x), np.radians(self.y)
        self.unit = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        self.levels = []
        for d in range(depth + 1):
            gx, gy = self.x.reshape(1 << d, -1), self.y.reshape(1 << d, -1)
            self.levels.append((gx.min(1), gx.max(1), gy.min(1), gy.max(1)))


def _depth(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / SMALL)))


def _bounds(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ax0, ax1, ay0, ay1 = (v[i] for v in a)
    bx0, bx1, by0, by1 = (v[j] for v in b)
    far = np.maximum.reduce([abs(ay0), abs(ay1), abs(by0), abs(by1)])
    low = lambda y0, y1: np.where((y0 <= 0) & (y1 >= 0), 0.0, np.minimum(abs(y0), abs(y1)))
    near = np.minimum(low(ay0, ay1), low(by0, by1))
    gap = lambda a0, a1, b0, b1: np.maximum(0, np.maximum(a0 - b1, b0 - a1))
    reach = lambda a0, a1, b0, b1: np.maximum(a1 - b0, b1 - a0)
    hav = lambda dx, dy, lat: np.sin(np.radians(dy) / 2) ** 2 + np.cos(np.radians(lat)) ** 2 * np.sin(np.radians(dx) / 2) ** 2
    return hav(gap(ax0, ax1, bx0, bx1), gap(ay0, ay1, by0, by1), far), hav(reach(ax0, ax1, bx0, bx1), reach(ay0, ay1, by0, by1), near)


def _near(left: _Boxes, right: _Boxes, metres: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``metres`` of two trees of equal depth (or of one with itself, i < j)."""
    loose, tight = _limit(metres) * (1 + 1e-9), _limit(metres) * (1 - 1e-9)
    i = j = np.zeros(1, dtype=np.int64)
    depth = len(left.levels) - 1

    def keep(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (p < left.n) & (q < right.n)
        if same:
            ok &= p < q
        return p[ok], q[ok]

    for d in range(depth + 1):
        low, high = _bounds(left.levels[d], right.levels[d], i, j)
        sure = high <= tight
        size = len(left.x) >> d
        span = np.arange(size)
        for p, q in zip(i[sure], j[sure], strict=True):  # certainly near: all of both nodes
            yield keep(np.repeat(p * size + span, size), np.tile(q * size + span, size))
        open_ = (low <= loose) & ~sure
        i, j = i[open_], j[open_]
        if d < depth:
            i, j = np.repeat(2 * i, 4) + np.tile([0, 0, 1, 1], len(i)), np.repeat(2 * j, 4) + np.tile([0, 1, 0, 1], len(j))
            if same:
                i, j = i[i <= j], j[i <= j]
    span = np.arange(SMALL)
    chord = 4 * _limit(metres) * (1 + 1e-6) + 1e-15  # squared, with room for rounding; the sphere decides below
    for at in range(0, len(i), 256):
        p, q = i[at : at + 256, None] * SMALL + span, j[at : at + 256, None] * SMALL + span
        square = sum((u[p][:, :, None] - v[q][:, None, :]) ** 2 for u, v in zip(left.unit, right.unit, strict=True))
        k, m, n = np.nonzero(square <= chord)
        p, q = keep(p[k, m], q[k, n])
        y1, y2 = np.radians(left.y[p]), np.radians(right.y[q])
        h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin(np.radians(right.x[q] - left.x[p]) / 2) ** 2
        near = 2 * RADIUS_M * np.arcsin(np.sqrt(h)) <= metres
        yield p[near], q[near]


PAIRS = pa.schema([("clave_1", pa.string()), ("clave_2", pa.string())])


def _flat(t: pa.Table, column: str) -> pa.Array:
    """The elements of a list column."""
    return t.column(column).combine_chunks().flatten()


def _ordered(ids_a: pa.Array, ids_b: pa.Array) -> pa.Table:
    """Pairs of different ids, the smaller first."""
    less = pc.less(ids_a, ids_b)
    t = pa.Table.from_arrays([pc.if_else(less, ids_a, ids_b), pc.if_else(less, ids_b, ids_a)], schema=PAIRS)
    return t.filter(pc.not_equal(ids_a, ids_b))


def _refine(homes: pa.Table, halos: pa.Table, metres: float) -> pa.Table:
    """Near pairs of a leaf with itself, where it is asked for, and with the points of other leaves around it."""
    if not len(homes):
        return PAIRS.empty_table()
    home, hx, hy = _flat(homes, "ids"), _flat(homes, "xs").to_numpy(), _flat(homes, "ys").to_numpy()
    parts = []
    if homes.column("consigo")[0].as_py():
        t = _Boxes(hx, hy, _depth(len(home)))
        parts += [_ordered(home.take(pa.array(p)), home.take(pa.array(q))) for p, q in _near(t, t, metres, True) if len(p)]
    if len(halos):
        points = _flat(halos.sort_by("b"), "puntos")
        halo, ox, oy = points.field("ids"), points.field("xs").to_numpy(), points.field("ys").to_numpy()
        if len(halo):
            d = _depth(max(len(home), len(halo)))
            a, b = _Boxes(hx, hy, d), _Boxes(ox, oy, d)
            parts += [_ordered(home.take(pa.array(p)), halo.take(pa.array(q))) for p, q in _near(a, b, metres, False) if len(p)]
    return pa.concat_tables(parts).combine_chunks() if parts else PAIRS.empty_table()


def near_pairs(tree: Tree, metres: float) -> DataFrame:
    """(clave_1, clave_2): each pair of different ids with points at most ``metres`` apart, the smaller id first, once."""
    pairs = leaf_pairs(tree, metres)
    leaves = tree.leaves
    numbered = pairs.filter(~F.col("seguro")).withColumn("parte", F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / PARTNERS))
    numbered = materialise(numbered)
    reach = 1.001 * math.degrees(metres / RADIUS_M)
    around = numbered.filter("a <> b").withColumn("_s", reach / F.cos(F.radians(F.greatest(F.abs("ymin"), F.abs("ymax")) + reach)))
    around = around.select("a", "b", "parte", (F.col("xmin") - F.col("_s")).alias("_x0"), (F.col("xmax") + F.col("_s")).alias("_x1"), (F.col("ymin") - reach).alias("_y0"), (F.col("ymax") + reach).alias("_y1"))
    close = lambda p: p["ys"].between(F.col("_y0"), F.col("_y1")) & p["xs"].between(F.col("_x0"), F.col("_x1"))
    halo = around.join(leaves.select(F.col("nodo").alias("b"), "ids", "xs", "ys"), "b").select(F.col("a").alias("h_a"), F.col("parte").alias("h_parte"), "b", F.filter(F.arrays_zip("ids", "xs", "ys"), close).alias("puntos"))
    halo = halo.filter(F.size("puntos") > 0)
    heads = numbered.groupBy("a", "parte").agg(F.bool_or(F.col("a") == F.col("b")).alias("consigo"))
    home = leaves.select(F.col("nodo").alias("a"), "ids", "xs", "ys").join(heads, "a")
    refined = home.groupBy("a", "parte").cogroup(halo.groupBy("h_a", "h_parte")).applyInArrow(lambda h, o: _refine(h, o, metres), "clave_1 string, clave_2 string")
    sure = pairs.filter("seguro").select("a", "b")
    left, right = leaves.select(F.col("nodo").alias("a"), F.explode("ids").alias("ia")), leaves.select(F.col("nodo").alias("b"), "ids")
    whole = sure.join(right, "b").join(left, "a").select("a", "b", "ia", F.explode("ids").alias("ib")).filter(((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib"))) & (F.col("ia") != F.col("ib")))
    whole = whole.select(F.least("ia", "ib").alias("clave_1"), F.greatest("ia", "ib").alias("clave_2"))
    return refined.unionByName(whole).distinct()


def zone_leaves(tree: Tree, boxes: DataFrame) -> DataFrame:
    """(zona, hoja, box of the leaf): regions and leaves whose boxes meet, by descending the tree with each region's box."""
    pairs = boxes.select("zona", *BOX, F.lit(0).cast("bigint").alias("nodo"))
    for k, level in enumerate(tree.levels):
        if k == 0:
            level = F.broadcast(level) if len(tree.levels) > 1 else level  # at most 2 ** FAN_BITS rows
        meet = (F.col("n.xmin") <= F.col("z.xmax")) & (F.col("n.xmax") >= F.col("z.xmin")) & (F.col("n.ymin") <= F.col("z.ymax")) & (F.col("n.ymax") >= F.col("z.ymin"))
        z, n = pairs.alias("z"), level.alias("n")
        side = "n" if k == len(tree.levels) - 1 else "z"
        pairs = z.join(n, (F.col("n.padre") == F.col("z.nodo")) & meet).select("z.zona", *(f"{side}.{c}" for c in BOX), "n.nodo")
    return pairs.select("zona", F.col("nodo").alias("hoja"), *BOX)


def _exact_sign(values: tuple[float, ...]) -> int:
    """Sign of the cross product over the decimal numbers that the doubles stand for."""
    x1, y1, x2, y2, px, py = (Fraction(repr(float(v))) for v in values)
    cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    return (cross > 0) - (cross < 0)


def _crossings(edges: tuple[np.ndarray, ...], px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(crossed, on): whether the ray from the point to the right crosses the edge, and whether the point lies on it.

    Edges and points are arrays that broadcast; no tolerance, doubtful signs are taken exactly.
    """
    x1, y1, x2, y2 = edges
    dx, dy, fx, fy = x2 - x1, y2 - y1, px - x1, py - y1
    straddles = (y1 > py) != (y2 > py)
    boxed = (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    cross = dx * fy - dy * fx
    sign = np.sign(cross)
    size = abs(x1) + abs(x2) + abs(y1) + abs(y2)
    doubt = (straddles | boxed) & (abs(cross) <= 1e-14 * size * (abs(dx) + abs(dy) + abs(fx) + abs(fy)))
    if doubt.any():
        at = np.nonzero(doubt)
        sign[at] = [_exact_sign(v) for v in zip(*(np.broadcast_to(c, doubt.shape)[at] for c in (x1, y1, x2, y2, px, py)), strict=True)]
    return straddles & ((sign > 0) == (y2 > y1)), (sign == 0) & boxed


def covers(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside (an odd number of rings) or on an edge."""
    out = np.zeros(len(x), dtype=bool)
    step = max(1, CELLS // len(edges))
    for at in range(0, len(x), step):
        crossed, on = _crossings(tuple(edges.T[:, :, None]), x[at : at + step], y[at : at + step])
        out[at : at + step] = (crossed.sum(0) % 2 == 1) | on.any(0)
    return out


def _covers_each(edges: np.ndarray, start: np.ndarray, count: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``covers`` for points that each have edges of their own, ``count`` of them from ``start`` on."""
    out = np.zeros(len(x), dtype=bool)
    upto = np.cumsum(count)
    at = 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
        n = count[at:end]
        first = np.cumsum(n) - n
        which = np.repeat(start[at:end] - first, n) + np.arange(int(n.sum()))
        crossed, on = _crossings(tuple(edges[which].T), np.repeat(x[at:end], n), np.repeat(y[at:end], n))
        out[at:end] = (np.add.reduceat(crossed.astype(np.int64), first) % 2 == 1) | np.logical_or.reduceat(on, first)
        at = end
    return out


def _covered_by_one(edges: np.ndarray, left: float, boxes: _Boxes) -> np.ndarray:
    """As ``covers`` for the points of a leaf and a polygon of many edges: nodes that no edge meets are decided as a whole.

    ``edges`` may lack those that no ray to the right of these points meets; ``left`` is where the polygon begins.
    """
    n, (x0, x1, y0, y1) = boxes.n, boxes.levels[-1]
    group = np.arange(n) // SMALL
    ex0, ex1 = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    ey0, ey1 = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    alive = (x1 >= left) & (x0 <= ex1.max()) & (y1 >= ey0.min()) & (y0 <= ey1.max())
    touched = np.zeros(len(x0), dtype=bool)
    for part in np.array_split(np.flatnonzero(alive), 1 + len(edges) * int(alive.sum()) // CELLS):
        a, b, c, d = (v[part, None] for v in (x0, x1, y0, y1))
        touched[part] = ((ex0 <= b) & (ex1 >= a) & (ey0 <= d) & (ey1 >= c)).any(1)
    hit = np.zeros(n, dtype=bool)
    whole = np.flatnonzero(alive & ~touched)  # no edge meets the node: all of it is in or out
    if len(whole):
        took = np.zeros(len(x0), dtype=bool)
        took[whole] = covers(edges, boxes.x[whole * SMALL], boxes.y[whole * SMALL])
        hit |= took[group]
    at = np.flatnonzero((alive & touched)[group])
    if len(at):
        hit[at] |= covers(edges, boxes.x[at], boxes.y[at])
    return hit


def _contained(points: pa.Table, zones: pa.Table) -> pa.Table:
    if not len(points) or not len(zones):
        return PAIRS.empty_table()
    ids, x, y = _flat(points, "ids"), _flat(points, "xs").to_numpy(), _flat(points, "ys").to_numpy()
    lists = zones.column("bordes").combine_chunks()
    e = lists.flatten()
    edges = np.stack([e.field(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
    zone = np.repeat(np.arange(len(zones)), np.diff(lists.offsets.to_numpy()))
    if not len(edges):
        return PAIRS.empty_table()
    # A polygon is a run of edges of one zone and one number.
    name = np.stack([zone, e.field("k").to_numpy()], axis=1)
    start = np.append(0, np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1)
    count = np.diff(np.append(start, len(edges)))
    left = zones.column("xmin").to_numpy()[zone[start]]
    high_x = np.maximum.reduceat(np.maximum(edges[:, 0], edges[:, 2]), start)
    low_y, high_y = np.minimum.reduceat(np.minimum(edges[:, 1], edges[:, 3]), start), np.maximum.reduceat(np.maximum(edges[:, 1], edges[:, 3]), start)
    few = count <= MANY_EDGES
    boxed = few[:, None] & (left[:, None] <= x) & (x <= high_x[:, None]) & (low_y[:, None] <= y) & (y <= high_y[:, None])
    p, q = np.nonzero(boxed)
    inside = _covers_each(edges, start[p], count[p], x[q], y[q])
    p, q = [p[inside]], [q[inside]]
    boxes = None
    for k in np.flatnonzero(~few):
        boxes = boxes or _Boxes(x, y, _depth(len(x)))
        hit = np.flatnonzero(_covered_by_one(edges[start[k] : start[k] + count[k]], left[k], boxes))
        p.append(np.full(len(hit), k))
        q.append(hit)
    both = np.unique(np.stack([zone[start[np.concatenate(p)]], np.concatenate(q)], axis=1), axis=0)
    names = zones.column("zona").combine_chunks()
    return pa.Table.from_arrays([ids.take(pa.array(both[:, 1])), names.take(pa.array(both[:, 0]))], schema=PAIRS)


def outline(geometry: str) -> Column:
    """array<struct<k, x1, y1, x2, y2>>: the edges of all rings, each closed by its first point, with their polygon's number.

    Null polygons, rings and points are left out.
    """
    known = lambda a: F.filter(a, lambda v: v.isNotNull())
    usable = lambda ring: F.filter(ring, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())

    def closed(ring: Column, k: Column) -> Column:
        follower = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
        return F.transform(ring, lambda p, i: F.struct(k.alias("k"), p["x"].alias("x1"), p["y"].alias("y1"), follower(i)["x"].alias("x2"), follower(i)["y"].alias("y2")))

    return F.flatten(F.transform(known(F.col(geometry)), lambda polygon, k: F.flatten(F.transform(F.transform(known(polygon), usable), lambda ring: closed(ring, k)))))


def points_in_zones(tree: Tree, zones: DataFrame) -> DataFrame:
    """(clave_1, clave_2): point ids and the regions that hold the point, border included, each once.

    ``zones`` is (zona, geometry).  Null and empty geometries hold nothing.  A
    leaf gets of a region only the edges that a ray from its box to the right
    may meet, so a region over many leaves isn't copied whole to each.
    """
    shapes = zones.filter(F.col("zona").isNotNull() & F.col("geometry").isNotNull()).withColumn("forma", F.xxhash64("geometry"))
    shapes = shapes.dropDuplicates(["zona", "forma"]).select("zona", "forma", outline("geometry").alias("bordes"))
    of = lambda f, c: f(F.transform("bordes", lambda e: e[f"{c}1"]))  # every point begins an edge
    shapes = shapes.select("*", *(of(f, c).alias(c + n) for c in "xy" for f, n in ((F.array_min, "min"), (F.array_max, "max"))))
    shapes = materialise(shapes.filter(F.col("xmin").isNotNull()))
    met = zone_leaves(tree, shapes.select(F.struct("zona", "forma").alias("zona"), *BOX))
    parted = met.withColumn("parte", F.floor((F.row_number().over(Window.partitionBy("hoja").orderBy("zona")) - 1) / ZONES))
    parted = materialise(parted.select("hoja", "parte", F.col("zona.zona").alias("zona"), F.col("zona.forma").alias("forma"), *(F.col(c).alias(f"h_{c}") for c in BOX)))
    meets = lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("h_ymin")) & (F.least(e["y1"], e["y2"]) <= F.col("h_ymax")) & (F.greatest(e["x1"], e["x2"]) >= F.col("h_xmin"))
    sides = parted.join(shapes.select("zona", "forma", "bordes", "xmin"), ["zona", "forma"])
    sides = sides.select(F.col("hoja").alias("z_hoja"), F.col("parte").alias("z_parte"), "zona", "xmin", F.filter("bordes", meets).alias("bordes"))
    pts = tree.leaves.select(F.col("nodo").alias("hoja"), "ids", "xs", "ys").join(parted.select("hoja", "parte").distinct(), "hoja")
    return (
        pts.groupBy("hoja", "parte")
        .cogroup(sides.groupBy("z_hoja", "z_parte"))
        .applyInArrow(_contained, "clave_1 string, clave_2 string")
        .distinct()
    )


def establishments(denue: DataFrame) -> DataFrame:
    """(id, x, y): usable points of the register; repeated deliveries are equal rows, which ``build_tree`` counts once."""
    ok = F.col("id").isNotNull() & F.col("latitud").between(14, 33) & F.col("longitud").between(-119, -86)
    return denue.filter(ok).select("id", F.col("longitud").alias("x"), F.col("latitud").alias("y"))


def neighbours(denue: DataFrame, ageb: DataFrame, metres: float = 30.0) -> DataFrame:
    """(relacion, clave_1, clave_2): ``zona`` rows (id, cvegeo) and ``cerca`` rows (id, id)."""
    tree = build_tree(establishments(denue))
    zona = points_in_zones(tree, ageb.select(F.col("cvegeo").alias("zona"), "geometry"))
    cerca = near_pairs(tree, metres)
    return zona.select(F.lit("zona").alias("relacion"), "clave_1", "clave_2").unionByName(cerca.select(F.lit("cerca").alias("relacion"), "clave_1", "clave_2"))
