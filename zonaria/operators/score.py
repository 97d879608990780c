"""Composite scores, concentration, classes and comparisons."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaria.operators.profiles import rank_all

# Weights of the composite score and its bands.
SCORE_WEIGHTS = {"impacto": 0.30, "participacion": 0.15, "centralidad": 0.20, "diversidad": 0.15, "especializacion": 0.10, "cobertura": 0.10}
HIGH, MEDIUM = 0.66, 0.33


def minmax(d: DataFrame, *columns: str) -> DataFrame:
    """``d`` with n_<column> in [0, 1]; a constant column gives 0.5.  The extremes are one aggregate, not a window."""
    f = d.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns)).first()
    out = {}
    for c in columns:
        lo, hi = f[f"lo_{c}"], f[f"hi_{c}"]
        out[f"n_{c}"] = F.lit(0.5) if lo is None or hi is None or hi - lo < 1e-12 else (F.col(c) - lo) / (hi - lo)
    return d.withColumns(out)


def hhi(granular: DataFrame, totals: DataFrame) -> DataFrame:
    """(cvegeo, hhi): sum of squared community shares of the zone's whole weight (sectors without community count below the fraction)."""
    d = granular.join(totals.select("cvegeo", "peso_total"), "cvegeo")
    return d.groupBy("cvegeo").agg(F.sum(F.pow(F.when(F.col("peso_total") > 0, F.col("peso") / F.col("peso_total")).otherwise(0.0), 2)).alias("hhi"))


def opportunity(u: DataFrame, granular: DataFrame, centrality: DataFrame, n_sectors: int, simulation: DataFrame | None = None, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``u`` with six components, ``score`` and ``nivel``.

    impacto is |impacto_propagado| with a simulation (0 where missing), else
    the zone's weight; a missing index counts as 1; weights are made to sum to
    one.  ``centrality`` is (cluster_id, centralidad_media).
    """
    w = dict(weights or SCORE_WEIGHTS)
    total = sum(w.values())
    d = u.join(hhi(granular, u), "cvegeo", "left").join(centrality.select("cluster_id", "centralidad_media").distinct(), "cluster_id", "left")
    if simulation is not None:
        d = d.join(simulation.select("cvegeo", "impacto_propagado"), "cvegeo", "left")
    index = F.coalesce("hhi", F.lit(1.0))
    d = d.withColumns(
        {
            "impacto": F.col("peso_total") if simulation is None else F.abs(F.coalesce("impacto_propagado", F.lit(0.0))),
            "participacion": F.col("participacion_pct"),
            "centralidad": F.coalesce("centralidad_media", F.lit(0.0)),
            "diversidad": 1 - index,
            "especializacion": index,
            "cobertura": F.col("n_sectores") / F.lit(max(1, n_sectors)),
        }
    )
    d = minmax(d, *SCORE_WEIGHTS)
    score: Column = F.lit(0.0)
    for c, x in w.items():
        score = score + F.col(f"n_{c}") * (x / total)
    d = d.withColumn("score", score)
    return d.withColumn("nivel", F.when(F.col("score") >= HIGH, "High").when(F.col("score") >= MEDIUM, "Medium").otherwise("Low"))


def quantiles(d: DataFrame, column: str, points: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation; none without values.

    The values are numbered over range partitions (see ``rank_all``) and only
    the rows at the wanted places are collected, so no task holds the column.
    """
    v = d.select(F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ranked = rank_all(v, "_v", "_v", "_n")
    n = ranked.count()
    if not n:
        return []
    at = [p * (n - 1) for p in points]
    wanted = sorted({n - int(k) for x in at for k in (math.floor(x), math.ceil(x))})
    value = {n - r["_n"]: r["_v"] for r in ranked.filter(F.col("_n").isin(wanted)).collect()}
    low, high = ([value[int(f(x))] for x in at] for f in (math.floor, math.ceil))
    return [a if a == b else a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at, strict=True)]


def percentiles(d: DataFrame, column: str, points: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)) -> DataFrame:
    """(p, valor): exact percentiles with linear interpolation; no rows without values."""
    got = quantiles(d, column, points)
    return d.sparkSession.createDataFrame(list(zip(map(float, points), got, strict=False)), "p double, valor double")


def histogram(d: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """(cubo 1..bins, desde, hasta, n): equal bins between the extremes, the last closed; empty bins have 0."""
    f = d.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = f["lo"], f["hi"]
    spark = d.sparkSession
    if lo is None:
        return spark.createDataFrame([], "cubo int, desde double, hasta double, n bigint")
    width = (hi - lo) / bins or 1.0
    at = F.least(F.lit(bins), F.floor((F.col(column) - lo) / width).cast("int") + 1)
    n = d.filter(F.col(column).isNotNull()).groupBy(at.alias("cubo")).agg(F.count("*").alias("n"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("cubo"))
    return every.join(n, "cubo", "left").select("cubo", (F.lit(float(lo)) + (F.col("cubo") - 1) * width).alias("desde"), (F.lit(float(lo)) + F.col("cubo") * width).alias("hasta"), F.coalesce("n", F.lit(0)).alias("n"))


def classify(d: DataFrame, column: str, method: str = "quantiles", k: int = 7) -> DataFrame:
    """``d`` with ``clase`` 0..k-1, null for a null value.

    quantiles: right-closed classes at the k-quantiles, repeated breaks
    dropped; equal_interval: k equal widths; linear: the value between 0 and 1.
    Fewer than two breaks fall back to equal intervals.
    """
    f = d.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = f["lo"], f["hi"]
    v = F.col(column)
    if lo is None or hi == lo:
        return d.withColumn("clase", F.when(v.isNotNull(), F.lit(0.0 if method == "linear" else 0)))
    if method == "linear":
        return d.withColumn("clase", (v - lo) / (hi - lo))
    breaks = sorted(set(quantiles(d, column, [i / k for i in range(k + 1)]))) if method == "quantiles" else []
    if len(breaks) < 3:
        breaks = [lo + (hi - lo) * i / k for i in range(k + 1)]
    c: Column = F.lit(0)
    for b in breaks[1:-1]:
        c = c + (v > b).cast("int")
    return d.withColumn("clase", F.when(v.isNotNull(), c))


def concentration(d: DataFrame, value: str, key: str, share: float = 0.8) -> int:
    """How many of the largest rows reach ``share`` of the total; 0 where there is none.

    The rows are numbered over range partitions; running sums add the totals
    of the partitions before, so nothing is brought into one task.
    """
    total = d.agg(F.sum(value).alias("t")).first()["t"] or 0.0
    if total <= 0:
        return 0
    from pyspark.sql import Window

    r = rank_all(d.select(value, key), value, key, "_n")
    block = F.floor((F.col("_n") - 1) / 65536)
    r = r.withColumn("_b", block)
    sums = r.groupBy("_b").agg(F.sum(value).alias("s")).orderBy("_b").collect()
    before = 0.0
    for b in sums:
        if before + b["s"] >= share * total * (1 - 1e-12):
            run = F.sum(value).over(Window.partitionBy("_b").orderBy("_n"))
            return r.filter(F.col("_b") == b["_b"]).withColumn("_s", run + before).filter(F.col("_s") >= share * total * (1 - 1e-12)).agg(F.min("_n").alias("n")).first()["n"]
        before += b["s"]
    return r.count()


def impact_figures(result: DataFrame, column: str = "y", top: int = 10) -> DataFrame:
    """One row: zones touched (|y| > 0), mean, largest |y|, and the share of the top zones in the sum of |y|."""
    size = F.abs(F.col(column))
    best = result.select(size.alias("v")).orderBy(F.desc("v")).limit(top).agg(F.sum("v").alias("_t"))
    f = result.agg(F.count_if(size > 0).alias("afectadas"), F.avg(column).alias("media"), F.max(size).alias("maximo"), F.sum(size).alias("_s"))
    k = lambda x: x.withColumn("_k", F.lit(1))
    return k(f).join(k(best), "_k").select("afectadas", "media", "maximo", F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).otherwise(0.0).alias("parte_principal"))


def compare_results(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """(id, ya, yb, diferencia): the n zones whose impact differs most, ties by id; zones in both results."""
    d = a.select("id", F.col("y").alias("ya")).join(b.select("id", F.col("y").alias("yb")), "id").withColumn("diferencia", F.col("yb") - F.col("ya"))
    return d.orderBy(F.desc(F.abs("diferencia")), "id").limit(n)


def search(u: DataFrame, text: str) -> DataFrame:
    """(tipo, cvegeo): the heaviest zone of what the text names: one zone id containing it, else a municipality, else a community, else a dominant sector."""
    t = text.strip().lower()
    tried = (
        ("ageb", F.lower("cvegeo").contains(t), True),
        ("municipio", F.concat("entidad", "municipio") == t, False),
        ("municipio", F.col("municipio") == t, False),
        ("comunidad", F.col("cluster_id").cast("string") == t, False),
        ("sector", F.lower("sector_dominante").contains(t), False),
    )
    for kind, hit, single in tried:
        found = u.filter(hit)
        n = found.limit(2).count()
        if n == 1 or (n and not single):
            return found.orderBy(F.desc("peso_total"), "cvegeo").limit(1).select(F.lit(kind).alias("tipo"), "cvegeo")
    return u.limit(0).select(F.lit("").alias("tipo"), "cvegeo")


def top_bucket(d: DataFrame, column: str, n: int = 12, rest: str = "Otros") -> DataFrame:
    """``d`` with ``grupo``: the value itself when among the n most frequent (ties by value), else ``rest``."""
    top = d.groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("_v"))
    return d.join(F.broadcast(top), F.col(column) == F.col("_v"), "left").withColumn("grupo", F.coalesce("_v", F.lit(rest))).drop("_v")


def competition_rank(d: DataFrame, value: str, key: str, name: str = "lugar") -> DataFrame:
    """``d`` with 1 + the number of rows with a larger value; equal values share their place."""
    r = rank_all(d, value, key, "_n")
    first = r.groupBy(F.col(value).alias("_v")).agg(F.min("_n").alias(name))
    return r.join(first, F.col(value).eqNullSafe(F.col("_v"))).drop("_n", "_v")


def sweep_points(low: float, high: float, n: int) -> list[float]:
    """3 to 15 even values of rho inside [0, 0.95], to four decimals."""
    if not 0 <= low < high <= 0.95 or not 3 <= n <= 15:
        raise ValueError("rho between 0 and 0.95, 3 to 15 points")
    return [round(low + (high - low) * k / (n - 1), 4) for k in range(n)]


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """One row: smallest and largest multiplier and their distance; NaN doesn't count."""
    m = F.nanvl("multiplicador", F.lit(None))
    return sweep.agg(F.min(m).alias("minimo"), F.max(m).alias("maximo")).withColumn("rango", F.col("maximo") - F.col("minimo"))


def dominant_share(u: DataFrame) -> DataFrame:
    """``u`` with ``concentracion``: the dominant sector's part of the zone's weight in percent, 0 without weight."""
    return u.withColumn("concentracion", F.when(F.col("peso_total") > 0, F.col("sector_peso") / F.col("peso_total") * 100).otherwise(0.0))
