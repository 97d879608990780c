"""Spatial propagation Y = (I - rho W)^-1 S, Moran's I, sweeps and calibration of rho."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaria.errors import AlignmentError, InvalidRhoError, SingularOperatorError
from zonaria.operators.graph import row_sums
from zonaria.session import materialise

DENSE_NODES = 1_000  #: nodes up to which the system is solved densely in one task per (scenario, rho), with its condition number
SERIES_ROWS = 300_000  #: nodes, and edges, up to which the series runs in one task; beyond them by joins
CONDITION = 1e12
UNROLL = 5  #: iterations between cuts of the lineage
NOTE = "rho is calibrated on the observed pattern, not causally estimated"


def align(nodes: DataFrame, vector: DataFrame, strict: bool = True) -> DataFrame:
    """(id, s) for every node, 0 where the vector has none; ids that are no node raise or are left out."""
    per = vector.groupBy("id").agg(F.sum("s").alias("s"))
    if strict:
        strange = per.join(nodes.select("id"), "id", "left_anti").limit(10).collect()
        if strange:
            raise AlignmentError("ids that are no node: " + ", ".join(str(r["id"]) for r in strange))
    return nodes.select("id").join(per, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))


def align_all(nodes: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, s) in the graph's ids for a vector that must name every node; missing or null ones raise, others are left out."""
    per = vector.filter(F.col("s").isNotNull()).groupBy("id").agg(F.sum("s").alias("s"))
    missing = nodes.select("id").join(per, "id", "left_anti").limit(10).collect()
    if missing:
        raise AlignmentError("nodes without a value: " + ", ".join(str(r["id"]) for r in missing))
    return nodes.select("id").join(per, "id")


def check_rho(rho, radius: float | None = None) -> float:
    """A finite number with |rho| < 1 and, where the radius is known and positive, below 1 / radius."""
    if isinstance(rho, bool) or not isinstance(rho, int | float | np.floating | np.integer):
        raise InvalidRhoError(f"rho is no number: {rho!r}")
    if not math.isfinite(rho) or abs(rho) >= 1:
        raise InvalidRhoError(f"rho outside (-1, 1): {rho}")
    if radius and radius > 0 and abs(rho) >= 1 / radius:
        raise InvalidRhoError(f"rho {rho} reaches 1 / spectral radius {1 / radius}")
    return float(rho)


def _matrix(ids: Sequence, edges: pd.DataFrame) -> np.ndarray:
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    np.add.at(w, (edges["src"].map(at).to_numpy(dtype=int), edges["dst"].map(at).to_numpy(dtype=int)), edges["w"].to_numpy(dtype=float))
    return w


def spectral_radius(nodes: DataFrame, w: DataFrame, steps: int = 100) -> float:
    """Largest absolute eigenvalue of W.

    1 for a symmetric graph with row sums of one: a node's neighbours lead
    back to it, so every component with an edge is a row-stochastic block.
    Otherwise exact up to DENSE_NODES, else by the growth of a power iteration
    of joins.
    """
    n = nodes.count()
    if n == 0 or not w.limit(1).count():
        return 0.0
    if not w.filter("w < 0").limit(1).count() and not row_sums(w).limit(1).count():
        back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if not w.join(back, ["src", "dst"], "left_anti").limit(1).count():
            return 1.0
    if n <= DENSE_NODES:
        ids = [r["id"] for r in nodes.select("id").collect()]
        e = w.toPandas()
        return float(abs(np.linalg.eigvals(_matrix(ids, e))).max()) if len(e) else 0.0
    v = nodes.select("id", (1.0 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    growth = 0.0
    for _ in range(0, steps, UNROLL):
        before = v.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n")).first()["n"]
        for _ in range(UNROLL):
            v = _times(nodes, w, v)
        v = materialise(v)
        after = v.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n")).first()["n"]
        if not after:
            return 0.0
        was, growth = growth, (after / before) ** (1 / UNROLL)
        v = v.withColumn("v", F.col("v") / after)
        if abs(growth - was) < 1e-10:
            break
    return growth


def _times(nodes: DataFrame, w: DataFrame, v: DataFrame) -> DataFrame:
    """(id, v): W v.  Two equi-joins and a sum; nodes without edges get 0."""
    p = w.join(v, w["dst"] == v["id"]).groupBy("src").agg(F.sum(F.col("w") * F.col("v")).alias("v")).withColumnRenamed("src", "id")
    return nodes.select("id").join(p, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))


def neumann(nodes: DataFrame, w: DataFrame, s: DataFrame, rho: float, terms: int = 200, tolerance: float = 1e-10, fixed: bool = False) -> tuple[DataFrame, int, bool]:
    """((id, y), terms added, converged): the sum of rho^k W^k S.

    Stops when the largest term is below ``tolerance`` times the largest |S|
    (relative, as amounts have any unit); with ``fixed`` it adds ``terms``
    terms.  The lineage is cut every UNROLL steps.
    """
    base = s.agg(F.max(F.abs("s")).alias("m")).first()["m"] or 0.0
    state = s.select("id", F.col("s").alias("v"), F.col("s").alias("y"))
    edges = w.select("src", "dst", (F.col("w") * float(rho)).alias("w"))
    k = 0
    while k < terms:
        step = min(UNROLL, terms - k)
        for _ in range(step):
            p = edges.join(state.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("_n"))
            state = state.join(p, "id", "left").select("id", F.coalesce("_n", F.lit(0.0)).alias("v"), (F.col("y") + F.coalesce("_n", F.lit(0.0))).alias("y"))
        k += step
        state = materialise(state)
        if not fixed:
            term = state.agg(F.max(F.abs("v")).alias("m")).first()["m"] or 0.0
            if term <= tolerance * base:
                return state.select("id", "y"), k, True
    return state.select("id", "y"), k, fixed


def _tail(w: DataFrame, largest: float) -> float:
    """A bound below 1 on how much a term of the series shrinks per step, by the row sums of |W|; inf where they give none."""
    rows = w.groupBy("src").agg(F.sum(F.abs("w")).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0.0
    # Row sums of one carry rounding errors.
    q = largest * (1.0 if abs(rows - 1) < 1e-9 else rows)
    return q if q < 1 else math.inf


def _done(term: float, before: float, base: float, q: float, steps: int, tolerance: float) -> bool:
    """Whether the terms after one of size ``term`` sum to less than ``tolerance`` of ``base``; ``before`` is ``steps`` earlier."""
    shrink = q if q < 1 else (term / before) ** (1 / steps)
    return not term or (shrink < 1 and term * shrink / (1 - shrink) <= tolerance * base)


def neumann_grid(w: DataFrame, s: DataFrame, rhos: Sequence[float], tolerance: float = 1e-14) -> DataFrame:
    """(rho, id, y) of every rho in one series, see ``neumann_arrays``."""
    rhos = [float(r) for r in dict.fromkeys(rhos)]
    each = F.array(*(F.struct(F.lit(r).alias("rho"), F.col("y")[i].alias("y")) for i, r in enumerate(rhos)))
    return neumann_arrays(w, s, rhos, tolerance).select("id", F.explode(each).alias("_g")).select("_g.rho", "id", "_g.y")


def neumann_arrays(w: DataFrame, s: DataFrame, rhos: Sequence[float], tolerance: float = 1e-14) -> DataFrame:
    """(id, y), an array with the result of every rho: each W^k S is made once and added to every rho's sum.

    It ends when all that is still missing is below ``tolerance`` times the
    largest |S|, however many terms that takes; terms that don't shrink raise.
    Graphs of at most SERIES_ROWS nodes and edges fit in one task, larger ones
    take joins.
    """
    largest = max(map(abs, rhos), default=0.0)
    base = s.agg(F.max(F.abs("s")).alias("m")).first()["m"] or 0.0
    q = _tail(w, largest)
    small = max(d.limit(SERIES_ROWS + 1).count() for d in (w, s)) <= SERIES_ROWS
    if not largest or not base:
        return s.select("id", F.array(*(F.col("s") for _ in rhos)).alias("y"))
    return (_series_task if small else _series_joins)(w, s, rhos, largest, base, q, tolerance)


def _series_task(w: DataFrame, s: DataFrame, rhos: list[float], largest: float, base: float, q: float, tolerance: float) -> DataFrame:
    """(id, y): an array with the sum of each rho."""
    edges = w.sparkSession.sparkContext.broadcast(w.select("src", "dst", "w").toPandas())
    condition = CONDITION

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, e = pd.Index(pdf["id"]), edges.value
        src, dst, weight = at.get_indexer(e["src"]), at.get_indexer(e["dst"]), e["w"].to_numpy(dtype=float) * largest
        known = (src >= 0) & (dst >= 0)
        src, dst, weight = src[known], dst[known], weight[known]
        v = pdf["s"].to_numpy(dtype=float)
        y, ratio = np.tile(v, (len(rhos), 1)), np.array(rhos) / largest
        c, term, low, stalled = np.ones(len(rhos)), base, base, 0
        while True:
            v = np.bincount(src, weight * v[dst], minlength=len(v))
            c = c * ratio
            y += c[:, None] * v
            before, term = term, float(np.abs(v).max())
            if _done(term, before, base, q, 1, tolerance):
                break
            stalled, low = (0, term) if term < low else (stalled + 1, low)
            if not term <= condition * base or (q >= 1 and stalled >= 40 * UNROLL):
                y[:] = np.nan
                break
        return pd.DataFrame({"id": pdf["id"], "y": list(y.T)})

    y = materialise(s.select(F.lit(0).alias("_g"), "id", "s").groupBy("_g").applyInPandas(run, f"id {dict(s.dtypes)['id']}, y array<double>"))
    if y.filter(F.exists("y", lambda a: F.isnan(F.coalesce(a, F.lit(math.nan))))).limit(1).count():  # Arrow makes NaN null
        raise SingularOperatorError("the series has not converged")
    return y


def _series_joins(w: DataFrame, s: DataFrame, rhos: list[float], largest: float, base: float, q: float, tolerance: float) -> DataFrame:
    """(id, y) as in _series_task; ``c`` holds the powers of each rho, so that every block of steps is the same code."""
    ratio = F.array(*(F.lit(r / largest) for r in rhos))
    state = s.select("id", F.col("s").alias("v"), F.array(*(F.lit(1.0) for _ in rhos)).alias("c"), F.array(*(F.col("s") for _ in rhos)).alias("y"))
    edges = w.select("src", "dst", (F.col("w") * largest).alias("w"))
    k, term, low, stalled = 0, base, base, 0
    while True:
        for _ in range(UNROLL):
            p = edges.join(state.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("_n"))
            state = state.join(p, "id", "left").select("id", F.coalesce("_n", F.lit(0.0)).alias("v"), F.zip_with("c", ratio, lambda a, b: a * b).alias("c"), "y")
            state = state.select("id", "v", "c", F.zip_with("y", "c", lambda a, b: a + b * F.col("v")).alias("y"))
        k += UNROLL
        state = materialise(state)
        before, term = term, state.agg(F.max(F.abs("v")).alias("m")).first()["m"] or 0.0
        if _done(term, before, base, q, UNROLL, tolerance):
            return state.select("id", "y")
        stalled, low = (0, term) if term < low else (stalled + 1, low)
        if not term <= CONDITION * base or (q >= 1 and stalled >= 40):
            raise SingularOperatorError(f"the series has not converged after {k} terms")


def solve_dense(nodes: DataFrame, w: DataFrame, s: DataFrame, rhos: DataFrame, condition: bool = True) -> DataFrame:
    """(escenario, rho, id, y, condicion): one dense solve per row of (escenario, rho); ``s`` is (escenario, id, s).

    The condition number costs far more than the solve; without it, it is null.

    For graphs of at most DENSE_NODES nodes: a scenario's vector and the edges
    meet in one task per (scenario, rho), so a sweep runs in parallel.
    """
    if nodes.limit(DENSE_NODES + 1).count() > DENSE_NODES:
        raise SingularOperatorError(f"more than {DENSE_NODES} nodes: use neumann")
    edges = w.sparkSession.sparkContext.broadcast(w.select("src", "dst", "w").toPandas())
    kinds = dict(s.dtypes)
    keyed = s.join(rhos, "escenario").select("escenario", "rho", "id", "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        a = np.eye(len(pdf)) - float(pdf["rho"].iloc[0]) * _matrix(pdf["id"].tolist(), edges.value)
        cond = float(np.linalg.cond(a)) if condition else None
        y = np.linalg.solve(a, pdf["s"].to_numpy()) if cond is None or cond <= CONDITION else np.full(len(pdf), np.nan)
        return pd.DataFrame({"escenario": pdf["escenario"], "rho": pdf["rho"], "id": pdf["id"], "y": y, "condicion": cond})

    return keyed.groupBy("escenario", "rho").applyInPandas(run, f"escenario {kinds['escenario']}, rho double, id {kinds['id']}, y double, condicion double")


def propagate(nodes: DataFrame, w: DataFrame, s: DataFrame, rho: float) -> DataFrame:
    """(id, s, y, indirecto, isla): exact for small graphs, by the Neumann series for large ones.

    The series takes as many terms as rho needs, and raises where it doesn't converge.
    An island keeps y = s.  ``s`` is (id, s) aligned to the nodes.
    """
    check_rho(rho)
    spark = nodes.sparkSession
    if nodes.limit(DENSE_NODES + 1).count() <= DENSE_NODES:
        one = spark.createDataFrame([(0, float(rho))], "escenario int, rho double")
        y = materialise(solve_dense(nodes, w, s.select(F.lit(0).alias("escenario"), "id", "s"), one))
        worst = y.agg(F.max("condicion").alias("c")).first()["c"]
        if worst is not None and worst > CONDITION:
            raise SingularOperatorError(f"condition number {worst:.3g}")
        y = y.select("id", "y")
    else:
        y = neumann_grid(w, s, [rho]).select("id", "y")
    has = w.select(F.col("src").alias("id")).distinct().withColumn("_e", F.lit(True))
    d = s.join(y, "id").join(has, "id", "left")
    return d.select("id", "s", "y", (F.col("y") - F.col("s")).alias("indirecto"), F.col("_e").isNull().alias("isla"))


def propagation_report(result: DataFrame, rho: float) -> DataFrame:
    """One row: n, rho, sums of S and Y, their ratio (null when S sums to nothing) and zones with a shock."""
    sums = result.agg(F.count("*").alias("n"), F.sum("s").alias("suma_S"), F.sum("y").alias("suma_Y"), F.count_if(F.col("s") != 0).alias("zonas_con_shock"))
    return sums.select(F.lit(float(rho)).alias("rho"), "*", F.when(F.abs("suma_S") > 1e-12, F.col("suma_Y") / F.col("suma_S")).alias("multiplicador"))


def morans_i(nodes: DataFrame, w: DataFrame, values: DataFrame) -> DataFrame:
    """One row (i): (n / S0) * sum w_ij d_i d_j / sum d_i^2; 0 without nodes, variance or weights.  ``values`` is (id, v)."""
    v = nodes.select("id").join(values, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))
    f = v.agg(F.count("*").alias("n"), F.avg("v").alias("m")).first()
    d = v.select("id", (F.col("v") - (f["m"] or 0.0)).alias("d"))
    left = d.select(F.col("id").alias("src"), F.col("d").alias("di"))
    right = d.select(F.col("id").alias("dst"), F.col("d").alias("dj"))
    num = w.join(left, "src").join(right, "dst").agg(F.coalesce(F.sum(F.col("w") * F.col("di") * F.col("dj")), F.lit(0.0)).alias("num"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("s0"))
    den = d.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("den"))
    k = lambda x: x.withColumn("_k", F.lit(1))
    i = F.when((F.col("s0") > 1e-12) & (F.col("den") > 1e-12), f["n"] / F.col("s0") * F.col("num") / F.col("den")).otherwise(0.0)
    return k(num).join(k(den), "_k").select(i.alias("i"))


def _solutions(nodes: DataFrame, w: DataFrame, s: DataFrame, rhos: Sequence[float], condition: bool) -> DataFrame:
    """(rho, id, y, condicion): dense solves up to DENSE_NODES nodes, beyond them the series, which has no condition number."""
    if not rhos:
        return s.select(F.lit(0.0).alias("rho"), "id", F.col("s").alias("y"), F.lit(None).cast("double").alias("condicion")).limit(0)
    if nodes.limit(DENSE_NODES + 1).count() > DENSE_NODES:
        return neumann_grid(w, s, rhos).withColumn("condicion", F.lit(None).cast("double"))
    grid = nodes.sparkSession.createDataFrame([(0, float(r)) for r in rhos], "escenario int, rho double")
    return solve_dense(nodes, w, s.select(F.lit(0).alias("escenario"), "id", "s"), grid, condition).select("rho", "id", "y", "condicion")


def sweep(nodes: DataFrame, w: DataFrame, s: DataFrame, rhos: Sequence[float]) -> tuple[DataFrame, dict[float, str]]:
    """((rho, suma_S, suma_Y, multiplicador, condicion) by rho, {rho: error}); S and W are read once.

    condicion is null above DENSE_NODES nodes.
    """
    radius = spectral_radius(nodes, w)
    good, bad = [], {}
    for r in rhos:
        try:
            good.append(check_rho(r, radius))
        except InvalidRhoError as e:
            bad[r] = str(e)
    y = _solutions(nodes, w, s, good, condition=True)
    total = s.agg(F.sum("s").alias("t")).first()["t"] or 0.0
    out = y.groupBy("rho").agg(F.lit(total).alias("suma_S"), F.sum("y").alias("suma_Y"), F.max("condicion").alias("condicion"))
    ratio = F.when(F.abs("suma_S") > 1e-12, F.col("suma_Y") / F.col("suma_S")).otherwise(F.lit(float("nan")))
    return out.select("rho", "suma_S", "suma_Y", ratio.alias("multiplicador"), "condicion").orderBy("rho"), bad


def _distances(nodes: DataFrame, w: DataFrame, s: DataFrame, rhos: Sequence[float], target: float) -> list[tuple[float, float, float]]:
    """(rho, Moran's I of the propagated pattern, its distance from ``target``) of every rho; edges are joined once for all."""
    rhos = sorted(set(map(float, rhos)))
    if not rhos:
        return []
    if nodes.limit(DENSE_NODES + 1).count() > DENSE_NODES:
        wide = neumann_arrays(w, s, rhos)
    else:
        long = _solutions(nodes, w, s, rhos, condition=False)
        wide = long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rho", "y"))), lambda x: x["y"]).alias("y"))
    y, each = materialise(wide), range(len(rhos))
    mean = y.agg(F.count("*").alias("n"), *(F.avg(F.col("y")[k]).alias(f"m{k}") for k in each)).first()
    d = y.select("id", F.array(*(F.col("y")[k] - F.lit(mean[f"m{k}"]) for k in each)).alias("d"))
    den = d.agg(*(F.sum(F.col("d")[k] * F.col("d")[k]).alias(f"q{k}") for k in each)).first()
    met = w.join(d.select(F.col("id").alias("src"), F.col("d").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("b")), "dst")
    num = met.agg(F.sum("w").alias("s0"), *(F.sum(F.col("w") * F.col("a")[k] * F.col("b")[k]).alias(f"q{k}") for k in each)).first()
    out = []
    for k, rho in enumerate(rhos):
        flat = not num["s0"] or not den[f"q{k}"] or num["s0"] <= 1e-12 or den[f"q{k}"] <= 1e-12
        i = 0.0 if flat else mean["n"] / num["s0"] * num[f"q{k}"] / den[f"q{k}"]
        out.append((rho, i, abs(i - target)))
    return out


def calibrate(nodes: DataFrame, w: DataFrame, s: DataFrame, observed: DataFrame, low: float = -0.95, high: float = 0.95, coarse: int = 15, fine: int = 11) -> dict:
    """The rho whose propagated pattern has the observed Moran's I: a coarse grid, then a fine one around its best.

    Every grid is one job with a task per rho, or one series above DENSE_NODES nodes.  Ties go to the coarse grid,
    then the smaller rho; values that aren't valid are passed over.
    """
    radius = spectral_radius(nodes, w)
    target = morans_i(nodes, w, observed).first()["i"]
    step = (high - low) / (coarse - 1)

    def valid(rhos) -> list[float]:
        out = []
        for r in rhos:
            try:
                out.append(check_rho(float(r), radius))
            except InvalidRhoError:
                pass
        return out

    first = valid(np.linspace(low, high, coarse))
    if not first:
        return {"rho": math.nan, "convergio": False, "i_observado": target, "n_rho_evaluados": 0, "nota": NOTE}
    tried = [(d, 0, r, i) for r, i, d in _distances(nodes, w, s, first, target) if math.isfinite(d)]
    best = min(tried)
    second = valid(np.linspace(max(low, best[2] - step), min(high, best[2] + step), fine))
    tried += [(d, 1, r, i) for r, i, d in _distances(nodes, w, s, second, target) if math.isfinite(d)]
    best = min(tried)
    return {"rho": best[2], "convergio": True, "i_observado": target, "i_modelo": best[3], "diferencia": best[0], "n_rho_evaluados": len(first) + len(second), "nota": NOTE}
