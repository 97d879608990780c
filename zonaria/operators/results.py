"""Results as they are shown: joined to geometry, to groups and to each other, cut to their largest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaria.functions import geometry as G

IMPACTS = ("shock_directo", "impacto_indirecto", "impacto_propagado")


def one_geometry(zones: DataFrame, key: str = "cvegeo") -> DataFrame:
    """(key, geometry): one geometry per zone, of several always the same one: the first by a hash of its points; null where it has none."""
    g = zones.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("geometry", F.when(F.col("geometry").isNotNull(), F.xxhash64("geometry"))).alias("geometry"))
    return g


def with_geometry(d: DataFrame, zones: DataFrame, how: str = "left", key: str = "cvegeo") -> DataFrame:
    """``d`` with the geometry of its zones.

    left keeps every row of ``d``, right every zone (with nulls where ``d`` has
    nothing for it), inner only zones that have both.  A geometry column of
    ``d`` gives way.
    """
    return d.drop("geometry").join(one_geometry(zones, key), key, how)


def assembled(result: DataFrame, zones: DataFrame) -> DataFrame:
    """A propagated result (id, s, y, indirecto, isla) as (cvegeo, shock_directo, impacto_indirecto, impacto_propagado, isla, geometry)."""
    named = result.select(F.col("id").alias("cvegeo"), F.col("s").alias("shock_directo"), F.col("indirecto").alias("impacto_indirecto"), F.col("y").alias("impacto_propagado"), "isla")
    return with_geometry(named, zones)


def propagation_layer(simulation: DataFrame) -> DataFrame:
    """``simulation`` with intensidad = |direct| and decaimiento = |indirect| / (|direct| + 1e-9)."""
    direct, indirect = F.abs("shock_directo"), F.abs("impacto_indirecto")
    return simulation.withColumns({"intensidad": direct, "decaimiento": indirect / (direct + 1e-9)})


def shock_by(groups: DataFrame, simulation: DataFrame, group: str, key: str = "cvegeo") -> DataFrame:
    """(group, IMPACTS): the impacts of the zones of each group, summed; zones without impact or group are left out."""
    d = groups.select(key, group).join(simulation.select(key, *IMPACTS), key)
    return d.filter(F.col(group).isNotNull()).groupBy(group).agg(*(F.sum(c).alias(c) for c in IMPACTS))


def impact_of(simulation: DataFrame, zone: str, key: str = "cvegeo") -> dict[str, float] | None:
    """The three impacts of a zone, None where it has none."""
    r = simulation.filter(F.col(key) == zone).select(*IMPACTS).first()
    return r.asDict() if r else None


def largest(d: DataFrame, column: str | Column, key: str, n: int = 15, absolute: bool = False) -> DataFrame:
    """The ``n`` rows with the largest values, or absolute values, ties by key; nulls rank last."""
    v = F.col(column) if isinstance(column, str) else column
    return d.orderBy(F.desc_nulls_last(F.abs(v) if absolute else v), key).limit(n)


def bars(d: DataFrame, column: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` largest rows with ``barra``: the value over the largest absolute value among them (over 1 where that is 0)."""
    best = largest(d, column, key, n)
    top = best.agg(F.max(F.abs(column)).alias("m")).first()["m"] or 1.0
    return best.withColumn("barra", F.col(column) / F.lit(float(top)))


def most_frequent(d: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(columns, n_zonas): the ``n`` values with the most rows, ties by value."""
    return d.groupBy(*columns).agg(F.count("*").alias("n_zonas")).orderBy(F.desc("n_zonas"), *columns).limit(n)


def above_percentile(d: DataFrame, column: str, p: float = 0.90) -> DataFrame:
    """One row (umbral, n): the percentile and how many rows reach it; no rows without values."""
    from zonaria.operators.score import percentiles

    at = percentiles(d, column, (p,)).first()
    if at is None or at["valor"] is None:
        return d.sparkSession.createDataFrame([], "umbral double, n bigint")
    return d.filter(F.col(column) >= at["valor"]).agg(F.lit(float(at["valor"])).alias("umbral"), F.count("*").alias("n"))


def select_zones(u: DataFrame, municipalities: Sequence[str] = (), communities: Sequence[int] = ()) -> DataFrame:
    """Zones of the municipalities (entity and municipality, five digits) and communities asked for; none asked for means all."""
    d = u.filter(F.concat("entidad", "municipio").isin(list(municipalities))) if municipalities else u
    return d.filter(F.col("cluster_id").isin(list(communities))) if communities else d


def with_dominant(municipalities: DataFrame, dominant: DataFrame, communities: DataFrame) -> DataFrame:
    """Municipality profiles with cluster_dominante, its weight and name; null where a municipality has none."""
    names = communities.groupBy("cluster_id").agg(F.min("nombre").alias("nombre_cluster"))
    best = dominant.join(names, "cluster_id", "left").select("entidad", "municipio", F.col("cluster_id").alias("cluster_dominante"), F.col("peso").alias("peso_dominante"), "nombre_cluster")
    return municipalities.join(best, ["entidad", "municipio"], "left")


def map_table(simulation: DataFrame, column: str = "impacto_propagado", key: str = "cvegeo") -> DataFrame:
    """``simulation`` with its share of the column's total in percent (0 where that is 0) and the territory of the zone."""
    from zonaria.operators.warehouse import territory

    total = simulation.agg(F.sum(column).alias("t")).first()["t"] or 0.0
    share = F.coalesce(F.col(column) * 100 / F.lit(float(total)), F.lit(0.0)) if total else F.lit(0.0)
    return simulation.withColumn("participacion_pct", share).withColumns(territory(key))


def map_centre(d: DataFrame) -> DataFrame:
    """One row (x, y): the mean of the zones' centroids weighted by area; nulls where there is no area."""
    a, c = G.area("geometry"), G.centroid("geometry")
    parts = d.select(a.alias("a"), c.alias("c")).filter(F.col("a") > 0).select("a", (F.col("a") * F.col("c.x")).alias("mx"), (F.col("a") * F.col("c.y")).alias("my"))
    return parts.agg((F.sum("mx") / F.sum("a")).alias("x"), (F.sum("my") / F.sum("a")).alias("y"))


def flat_profile(d: DataFrame, names: dict[str, str]) -> DataFrame:
    """A profile with its columns renamed; lists become JSON texts, for formats that have none."""
    lists = {c: F.to_json(c) for c, t in d.dtypes if t.startswith("array")}
    return d.withColumns(lists).withColumnsRenamed(names)
