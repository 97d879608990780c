"""Contiguity of zones, the weight matrix as edges, and the GAL format."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.errors import ContractError, GalFormatError, require
from zonaria.functions import geometry as G
from zonaria.sources.paths import read_document, read_text, write_document, write_text

CELLS = 1_000_000  #: cells of an array at once
LEAST_CLASS = -20  #: power of two of the smallest grid cells, for zones without extent


def _exact(edges: list[tuple]) -> list[tuple]:
    """Edges as integers: the decimals the doubles stand for, all on one power of ten, doubled so that midpoints are whole.

    A double of at most 15 digits stands for the only such decimal next to it,
    so edges on the grid of micro-degrees need no decimals.
    """
    v = np.array(edges, dtype=float)
    grid = np.rint(v * 1e6)
    if (grid / 1e6 == v).all() and (abs(grid) < 1e15).all():
        return [tuple(e) for e in (grid.astype(np.int64) * 2).tolist()]
    dec = [tuple(Decimal(repr(float(v))) for v in e) for e in edges]
    places = max((-v.as_tuple().exponent for e in dec for v in e), default=0)
    scale = Decimal(10) ** max(0, places) * 2
    return [tuple(int(v * scale) for v in e) for e in dec]


def _oriented(geometry: list) -> list[tuple]:
    """The edges with the interior on their left: outer rings counter-clockwise, holes clockwise."""
    out = []
    for poly in geometry:
        for k, ring in enumerate(poly):
            pts = [(p["x"], p["y"]) for p in ring]
            if len(pts) > 1 and pts[0] == pts[-1]:
                pts = pts[:-1]
            twice = sum((x1 - pts[0][0]) * (y2 - pts[0][1]) - (x2 - pts[0][0]) * (y1 - pts[0][1]) for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True))
            if (twice < 0) == (k == 0):
                pts.reverse()
            out += [(*p, *q) for p, q in zip(pts, pts[1:] + pts[:1], strict=True) if p != q]
    return out


def _side(e: tuple, x: int, y: int) -> int:
    v = (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
    return (v > 0) - (v < 0)


def _on(e: tuple, x: int, y: int) -> bool:
    return min(e[0], e[2]) <= x <= max(e[0], e[2]) and min(e[1], e[3]) <= y <= max(e[1], e[3]) and _side(e, x, y) == 0


def _array(edges: list[tuple]) -> np.ndarray:
    """(n, 4) whole numbers: 64 bits where products of differences fit, else Python's, which are slower and as exact."""
    small = all(abs(v) < 1 << 30 for e in edges for v in e)
    return np.array(edges, dtype=np.int64 if small else object).reshape(-1, 4)


def _sides(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    v = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0])
    return (v > 0).astype(np.int8) - (v < 0).astype(np.int8)


def _boxes(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges' boxes as doubles; rounding keeps the order, so boxes that meet still meet."""
    f = e.astype(float)
    return np.minimum(f[:, 0], f[:, 2]), np.maximum(f[:, 0], f[:, 2]), np.minimum(f[:, 1], f[:, 3]), np.maximum(f[:, 1], f[:, 3])


def _within(boxes: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which edges reach the box around all the others."""
    return np.flatnonzero((boxes[0] <= others[1].max()) & (boxes[1] >= others[0].min()) & (boxes[2] <= others[3].max()) & (boxes[3] >= others[2].min()))


def _meeting(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of edges whose boxes meet, some edges of the first at a time."""
    mine, theirs = _within(p, q), _within(q, p)
    step = max(1, CELLS // max(1, len(theirs)))
    for at in range(0, len(mine), step):
        i = mine[at : at + step]
        a, b = (tuple(v[k] for v in box) for box, k in ((p, i), (q, theirs)))
        r, c = np.nonzero((a[0][:, None] <= b[1]) & (a[1][:, None] >= b[0]) & (a[2][:, None] <= b[3]) & (a[3][:, None] >= b[2]))
        yield i[r], theirs[c]


def _any_strictly_inside(edges: np.ndarray, boxes: tuple[np.ndarray, ...], points: np.ndarray) -> bool:
    """Whether one of the points (n, 2) lies inside the region and not on its border."""
    f = points.astype(float)
    points = points[(f[:, 0] >= boxes[0].min()) & (f[:, 0] <= boxes[1].max()) & (f[:, 1] >= boxes[2].min()) & (f[:, 1] <= boxes[3].max())]
    step = max(1, CELLS // len(edges))
    for at in range(0, len(points), step):
        some = points[at : at + step]
        y = some[:, 1].astype(float)
        r, c = np.nonzero((boxes[2] <= y[:, None]) & (y[:, None] <= boxes[3]))  # edges at the height of the point
        e, px, py = edges[c], some[r, 0], some[r, 1]
        side = _sides(e, px, py)
        low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
        on = (side == 0) & (low <= px) & (px <= high) & (np.minimum(e[:, 1], e[:, 3]) <= py) & (py <= np.maximum(e[:, 1], e[:, 3]))
        crossed = ((e[:, 1] > py) != (e[:, 3] > py)) & ((side > 0) == (e[:, 3] > e[:, 1]))
        odd = np.bincount(r, weights=crossed.astype(float), minlength=len(some)) % 2 == 1
        border = np.bincount(r, weights=on.astype(float), minlength=len(some)) > 0
        if (odd & ~border).any():
            return True
    return False


def relate(a: list[tuple], b: list[tuple]) -> tuple[bool, float]:
    """(touches, length in common, in units of the edges) of two regions given by oriented integer edges.

    They touch when their borders meet and their interiors don't: no edges
    cross, no common stretch runs in the same direction, and no stretch of one
    border lies inside the other region.  Edges are compared where their boxes
    meet, in arrays; only the pairs that touch are looked at one by one.
    """
    if not a or not b:
        return False, 0.0
    p, q = _array(a), _array(b)
    boxes = _boxes(p), _boxes(q)
    meets, common = False, 0.0
    cuts: tuple[dict, dict] = ({}, {})
    for i, j in _meeting(*boxes):
        e, f = p[i], q[j]
        s1, s2, s3, s4 = _sides(e, f[:, 0], f[:, 1]), _sides(e, f[:, 2], f[:, 3]), _sides(f, e[:, 0], e[:, 1]), _sides(f, e[:, 2], e[:, 3])
        if ((s1 * s2 < 0) & (s3 * s4 < 0)).any():
            return False, 0.0
        flat = (s1 == 0) & (s2 == 0) & (s3 == 0) & (s4 == 0)
        for k in np.flatnonzero((s1 == 0) | (s2 == 0) | (s3 == 0) | (s4 == 0)):
            own, other = a[i[k]], b[j[k]]
            here = [v for v in (other[:2], other[2:]) if _on(own, *v)]
            there = [v for v in (own[:2], own[2:]) if _on(other, *v)]
            if here or there:
                meets = True
                cuts[0].setdefault(int(i[k]), []).extend(here)
                cuts[1].setdefault(int(j[k]), []).extend(there)
            if flat[k]:
                ends = sorted({*here, *there})
                if len(ends) > 1:
                    (x1, y1), (x2, y2) = ends[0], ends[-1]
                    if (own[2] - own[0]) * (other[2] - other[0]) + (own[3] - own[1]) * (other[3] - other[1]) > 0:
                        return False, 0.0
                    common += ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
    if not meets:
        return False, 0.0
    for own, other, k in ((a, q, 0), (b, p, 1)):
        middles = []
        for i in _within(boxes[k], boxes[1 - k]):
            e = own[i]
            pts = sorted({e[:2], e[2:], *cuts[k].get(int(i), ())})
            middles += [((x1 + x2) // 2, (y1 + y2) // 2) for (x1, y1), (x2, y2) in zip(pts, pts[1:], strict=False)]
        if middles and _any_strictly_inside(other, boxes[1 - k], np.array(middles, dtype=other.dtype).reshape(-1, 2)):
            return False, 0.0
    return True, common


def _check_zones(zones: DataFrame, id_col: str) -> None:
    require(zones, id_col, "geometry")
    f = zones.agg(F.count_if(F.col("geometry").isNull()).alias("nulas"), F.count(id_col).alias("n"), F.countDistinct(id_col).alias("d")).first()
    if f["nulas"]:
        raise ContractError(f"{f['nulas']} zones without geometry")
    if f["n"] != f["d"]:
        raise ContractError("repeated zones")


def candidates(boxes: DataFrame) -> DataFrame:
    """(a, b), a < b: zones whose boxes meet.  ``boxes`` is (id, xmin, xmax, ymin, ymax).

    Every zone belongs to a size class, the power of two above its larger side,
    whose grid has cells of that width: it covers at most four of them.  Zones
    meet those of their own and of every larger class in the larger one's cells,
    each pair once, in the cell where the boxes begin to overlap.  So a huge
    zone doesn't widen the cells in which small ones are compared.
    """
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(2.0**LEAST_CLASS))
    d = boxes.withColumn("c", F.ceil(F.log2(side)).cast("int"))
    classes = sorted(r["c"] for r in d.select("c").distinct().collect())
    if not classes:
        return d.select(F.col("id").alias("a"), F.col("id").alias("b"))
    larger = F.filter(F.array(*map(F.lit, classes)), lambda c: c >= F.col("c"))
    size = F.pow(F.lit(2.0), F.col("g"))

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    at = d.withColumn("g", F.explode(larger)).withColumn("cx", cells("xmin", "xmax")).withColumn("cy", cells("ymin", "ymax"))
    s, t = at.alias("s"), at.filter("c = g").alias("t")
    met = lambda c: F.floor(F.greatest(f"s.{c}min", f"t.{c}min") / F.pow(F.lit(2.0), F.col("t.g"))) == F.col(f"t.c{c}")
    overlap = (F.col("s.xmin") <= F.col("t.xmax")) & (F.col("t.xmin") <= F.col("s.xmax")) & (F.col("s.ymin") <= F.col("t.ymax")) & (F.col("t.ymin") <= F.col("s.ymax"))
    order = (F.col("s.c") < F.col("t.c")) | ((F.col("s.c") == F.col("t.c")) & (F.col("s.id") < F.col("t.id")))
    same_cell = (F.col("s.g") == F.col("t.g")) & (F.col("s.cx") == F.col("t.cx")) & (F.col("s.cy") == F.col("t.cy"))
    pairs = s.join(t, same_cell & overlap & met("x") & met("y") & order)
    return pairs.select(F.least("s.id", "t.id").alias("a"), F.greatest("s.id", "t.id").alias("b"))


def contiguity(zones: DataFrame, criterion: str = "queen", id_col: str = "cvegeo") -> DataFrame:
    """(src, dst): both directions of each pair of touching zones.

    queen: borders meet, interiors don't; rook: a stretch of border in common
    besides.  Zones whose boxes meet are found by ``candidates``.
    """
    if criterion not in ("queen", "rook"):
        raise ContractError(f"unknown criterion {criterion}")
    _check_zones(zones, id_col)
    z = zones.select(F.col(id_col).alias("id"), "geometry", *G.box("geometry")).filter(F.col("xmin").isNotNull())
    pairs = candidates(z.drop("geometry"))
    ga, gb = z.select(F.col("id").alias("a"), F.col("geometry").alias("ga")), z.select(F.col("id").alias("b"), F.col("geometry").alias("gb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column("ga").to_pylist(), b.column("gb").to_pylist(), strict=True):
                e, f = _oriented(p), _oriented(q)
                both = _exact(e + f)
                touches, length = relate(both[: len(e)], both[len(e) :])
                keep.append(touches and (criterion == "queen" or length > 0))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(z.dtypes)["id"]
    touching = pairs.join(ga, "a").join(gb, "b").select("a", "b", "ga", "gb").mapInArrow(compare, f"a {kind}, b {kind}")
    return touching.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))


def vertex_edges(zones: DataFrame, id_col: str = "cvegeo") -> DataFrame:
    """(src, dst): zones with a vertex in common, both directions: a plain equi-join on the vertices."""
    v = zones.select(F.col(id_col).alias("id"), F.explode(F.flatten(F.flatten("geometry"))).alias("p")).select("id", "p.x", "p.y").distinct()
    a, b = v.withColumnRenamed("id", "src"), v.withColumnRenamed("id", "dst")
    return a.join(b, ["x", "y"]).filter("src <> dst").select("src", "dst").distinct()


def row_standardise(edges: DataFrame) -> DataFrame:
    """(src, dst, w): w = 1 / number of listed neighbours.  An island has no edge, so its row is zero.

    A neighbour listed twice counts twice below the fraction and once as an
    edge, which ``row_sums`` then shows.  Degrees are aggregated and joined
    back, so a hub's edges need not meet in one task.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("_d"))
    return edges.distinct().join(degree, "src").select("src", "dst", (1.0 / F.col("_d")).alias("w"))


def row_sums(w: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(src, suma): rows that don't sum to one."""
    return w.groupBy("src").agg(F.sum("w").alias("suma")).filter(F.abs(F.col("suma") - 1) > tolerance)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, grado): islands with 0."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("grado"))
    return nodes.select("id").join(d, "id", "left").na.fill(0, ["grado"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges, islands and degree figures (islands included)."""
    return degrees(nodes, edges).agg(
        F.count("*").alias("nodos"),
        F.coalesce((F.sum("grado") / 2).cast("bigint"), F.lit(0)).alias("aristas"),
        F.count_if(F.col("grado") == 0).alias("islas"),
        F.avg("grado").alias("grado_medio"),
        F.min("grado").alias("grado_min"),
        F.max("grado").alias("grado_max"),
    )


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def neighbours_of(edges: DataFrame, zone: str) -> DataFrame:
    return edges.filter(F.col("src") == zone).select("dst").distinct().orderBy("dst")


@dataclass(frozen=True)
class Matrix:
    """Row access to a weight matrix: ``nodes`` (id), ``w`` (src, dst, w).  Unknown ids raise."""

    nodes: DataFrame
    w: DataFrame

    def _known(self, zone: str) -> None:
        if not self.nodes.filter(F.col("id") == zone).limit(1).count():
            raise KeyError(f"{zone} is no node")

    def index_of(self, zone: str) -> int:
        """Place of a node among all by id, from 0."""
        self._known(zone)
        return self.nodes.filter(F.col("id") < zone).count()

    def row(self, zone: str) -> DataFrame:
        """(id, w): the whole row, 0 where there is no edge."""
        self._known(zone)
        mine = self.w.filter(F.col("src") == zone).groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("w"))
        return self.nodes.select("id").join(mine, "id", "left").na.fill(0.0, ["w"])

    def neighbours(self, zone: str) -> list[str]:
        self._known(zone)
        return [r["dst"] for r in neighbours_of(self.w, zone).collect()]

    def is_island(self, zone: str) -> bool:
        return not self.neighbours(zone)

    def frame(self, limit: int = 2_000) -> pd.DataFrame:
        """W with labelled rows and columns, for a look at a small graph."""
        ids = [r["id"] for r in self.nodes.select("id").orderBy("id").limit(limit + 1).collect()]
        if len(ids) > limit:
            raise ContractError(f"more than {limit} nodes")
        out = pd.DataFrame(0.0, index=ids, columns=ids)
        for r in self.w.collect():
            out.loc[r["src"], r["dst"]] += r["w"]
        return out


def read_gal(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """(id column, nodes (id, pos), edges (src, dst)) of a GAL file, in file order; malformed files raise.

    A file holds one adjacency on two lines per node and is read on the driver;
    its ids are split on white space.
    """
    try:
        lines = read_text(spark, path).removesuffix("\n").split("\n")
    except FileNotFoundError:
        raise GalFormatError(f"no file {path}") from None
    while lines and not lines[-1].strip() and len(lines) % 2 == 0:
        lines.pop()
    if not lines or not "".join(lines).strip():
        raise GalFormatError("empty file")
    head = lines[0].split()
    if len(head) < 4:
        raise GalFormatError("header with fewer than four parts")
    try:
        n = int(head[1])
    except ValueError:
        raise GalFormatError(f"number of nodes {head[1]!r}") from None
    ids: list[str] = []
    edges: list[tuple[str, str]] = []
    at = 1
    while at < len(lines):
        parts = lines[at].split()
        if not parts and at == len(lines) - 1:
            break
        if len(parts) != 2:
            raise GalFormatError(f"line {at + 1}: a node line has an id and a degree")
        try:
            degree = int(parts[1])
        except ValueError:
            raise GalFormatError(f"line {at + 1}: degree {parts[1]!r}") from None
        if at + 1 >= len(lines):
            raise GalFormatError(f"line {at + 1}: no neighbour line follows")
        near = lines[at + 1].split()
        if len(near) != degree:
            raise GalFormatError(f"line {at + 2}: {len(near)} neighbours, degree {degree}")
        ids.append(parts[0])
        edges += [(parts[0], x) for x in near]
        at += 2
    if len(set(ids)) != len(ids):
        raise GalFormatError("repeated node")
    if len(ids) != n:
        raise GalFormatError(f"{len(ids)} nodes, {n} declared")
    unknown = sorted({d for _, d in edges} - set(ids))
    if unknown:
        raise GalFormatError(f"unknown neighbours: {', '.join(unknown[:10])}")
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, pos bigint")
    return head[3], nodes, spark.createDataFrame(edges, "src string, dst string")


def write_gal(nodes: DataFrame, edges: DataFrame, path: str, id_col: str = "cvegeo") -> None:
    """The GAL file of a graph, on any file system: nodes by id, neighbours sorted.  The file is made on the driver, as it is one document."""
    if nodes.filter(F.col("id").rlike(r"\s")).limit(1).count():
        raise GalFormatError("ids with white space")
    near = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("v"))
    rows = nodes.select("id").join(near, "id", "left").select("id", F.coalesce("v", F.array().cast("array<string>")).alias("v")).orderBy("id")
    lines = [f"0 {nodes.count()} spatial_graph {id_col}", *(f"{r['id']} {len(r['v'])}\n{' '.join(r['v'])}" for r in rows.toLocalIterator())]
    write_text(nodes.sparkSession, path, "\n".join(lines) + "\n")


def write_graph(nodes: DataFrame, edges: DataFrame, gal: str, metadata: str, criterion: str, id_col: str = "cvegeo") -> None:
    """The GAL file and its metadata: id column, criterion and figures."""
    write_gal(nodes, edges, gal, id_col)
    write_document(nodes.sparkSession, metadata, {"id_col": id_col, "criterio": criterion, "report": graph_stats(nodes, edges).first().asDict()})


def read_graph_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata of a graph; FileNotFoundError where there are none."""
    return read_document(spark, path)


def load_matrix(spark: SparkSession, gal: str) -> Matrix | None:
    """The row-standardised matrix of a GAL file; None when there is no usable file, as a report does without neighbours."""
    try:
        _, nodes, edges = read_gal(spark, gal)
    except (ContractError, OSError):
        return None
    return Matrix(nodes, row_standardise(edges))
