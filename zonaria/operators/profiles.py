"""Zone, municipality and community profiles over a weighted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonaria.operators.warehouse import territory


def _by_weight(group: str, item: str):
    return Window.partitionBy(group).orderBy(F.desc("peso"), item)


def sector_weights(w: DataFrame) -> DataFrame:
    """(cvegeo, sector, peso): employment in zones that have any, establishments in the others."""
    total = w.groupBy("cvegeo").agg(F.sum("empleo_total").alias("_e"))
    peso = F.when(F.col("_e") > 0, F.col("empleo_total")).otherwise(F.col("n_establecimientos").cast("double"))
    return w.join(total, "cvegeo").groupBy("cvegeo", F.col("sector_serio").alias("sector")).agg(F.sum(peso).alias("peso"))


def community_weights(sectors: DataFrame, communities: DataFrame) -> DataFrame:
    """(cvegeo, cluster_id, peso) over the sectors that belong to a community."""
    return sectors.join(communities.select("sector", "cluster_id"), "sector").groupBy("cvegeo", "cluster_id").agg(F.sum("peso").alias("peso"))


def unmapped_sectors(sectors: DataFrame, communities: DataFrame) -> DataFrame:
    return sectors.select("sector").distinct().join(communities.select("sector"), "sector", "left_anti")


def universe(sectors: DataFrame, communities: DataFrame) -> DataFrame:
    """(cvegeo, cluster_id, peso_cluster, sector_dominante, sector_peso, peso_total, n_sectores, participacion_pct, ranking, entidad, municipio).

    Zones whose sectors all lack a community have no profile.  The total counts
    every sector; shares and ranks are over profiled zones.  Ties go to the
    smallest community, sector and zone.
    """
    by_c = community_weights(sectors, communities)
    dom_c = by_c.withColumn("_r", F.row_number().over(_by_weight("cvegeo", "cluster_id"))).filter("_r = 1").select("cvegeo", "cluster_id", F.col("peso").alias("peso_cluster"))
    dom_s = sectors.withColumn("_r", F.row_number().over(_by_weight("cvegeo", "sector"))).filter("_r = 1").select("cvegeo", F.col("sector").alias("sector_dominante"), F.col("peso").alias("sector_peso"))
    total = sectors.groupBy("cvegeo").agg(F.sum("peso").alias("peso_total"), F.countDistinct("sector").alias("n_sectores"))
    d = dom_c.join(dom_s, "cvegeo").join(total, "cvegeo")
    whole = d.agg(F.sum("peso_total").alias("t")).first()["t"] or 0.0
    share = F.col("peso_total") * 100 / whole if whole else F.lit(0.0)
    ranked = rank_all(d.withColumn("participacion_pct", share), "peso_total", "cvegeo", "ranking")
    return ranked.withColumns(territory("cvegeo"))


def observed_weight(w: DataFrame) -> DataFrame:
    """(id, s): the sum of a zone's weights over its sectors; 0 where none is known."""
    return w.groupBy(F.col("cvegeo").alias("id")).agg(F.coalesce(F.sum("omega"), F.lit(0.0)).alias("s"))


def rank_all(d: DataFrame, value: str, key: str, name: str, parts: int | None = None) -> DataFrame:
    """``d`` with the place of every row by value (largest first), then key, over the whole table.

    A window without partition would put all rows in one task.  The rows are
    range-partitioned by the order instead; each partition numbers its own and
    adds the rows of the partitions before it, whose counts are one number per
    partition.
    """
    from zonaria.session import materialise

    spark = d.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    placed = d.repartitionByRange(n, F.desc(value), F.col(key)).sortWithinPartitions(F.desc(value), key)
    placed = materialise(placed.select("*", F.shiftright(row, 33).alias("_p"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    before, rows = 0, []
    for r in placed.groupBy("_p").count().orderBy("_p").collect():
        rows.append((r["_p"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(rows, "_p bigint, _o bigint"))
    return placed.join(starts, "_p").withColumn(name, F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def _leaders(u: DataFrame, keys: list[str], top: int) -> DataFrame:
    """(keys, agebs_principales): the heaviest zones of each group, ties by zone.

    The rank is filtered where it is made, so a group of any size leaves each
    task as ``top`` rows.
    """
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("peso_total"), "cvegeo"))
    best = u.select(*keys, "cvegeo", "peso_total").withColumn("_r", r).filter(F.col("_r") <= top)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "cvegeo"))), lambda x: x["cvegeo"]).alias("agebs_principales"))


def municipality_profiles(u: DataFrame, edges: DataFrame | None = None, simulation: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(entidad, municipio, n_agebs, sectores, comunidades, peso_total, participacion_pct, peso_medio, agebs_principales[, impacto_*]).

    With a simulation (cvegeo, shock_directo, impacto_propagado,
    impacto_indirecto) the sums of impacts, null where no zone has one.
    """
    d = u if simulation is None else u.join(simulation, "cvegeo", "left")
    impact = [] if simulation is None else [F.sum(c).alias(c) for c in ("shock_directo", "impacto_propagado", "impacto_indirecto")]
    agg = d.groupBy("entidad", "municipio").agg(
        F.count("*").alias("n_agebs"),
        F.array_sort(F.collect_set("sector_dominante")).alias("sectores"),
        F.array_sort(F.collect_set("cluster_id")).alias("comunidades"),
        F.sum("peso_total").alias("peso_total"),
        F.sum("participacion_pct").alias("participacion_pct"),
        F.avg("peso_total").alias("peso_medio"),
        *impact,
    )
    return agg.join(_leaders(u, ["entidad", "municipio"], top), ["entidad", "municipio"])


def community_profiles(u: DataFrame, granular: DataFrame, communities: DataFrame, top: int = 5) -> DataFrame:
    """(cluster_id, nombre, n_agebs, peso_total, peso_granular, municipios, agebs_principales): every community, empty ones with zeros.

    peso_total gives a zone's whole weight to its dominant community;
    peso_granular splits it by sector.  ``communities`` has (sector,
    cluster_id[, nombre]); a community may have no sector row of the table.
    """
    name = F.min("nombre") if "nombre" in communities.columns else F.min("sector")
    meta = communities.groupBy("cluster_id").agg(name.alias("nombre"), F.count("sector").alias("n_sectores"))
    agg = u.groupBy("cluster_id").agg(F.count("*").alias("n_agebs"), F.sum("peso_total").alias("peso_total"), F.array_sort(F.collect_set(F.concat("entidad", "municipio"))).alias("municipios"))
    fine = granular.groupBy("cluster_id").agg(F.sum("peso").alias("peso_granular"))
    none = F.array().cast("array<string>")
    return (
        meta.join(agg, "cluster_id", "left")
        .join(_leaders(u, ["cluster_id"], top), "cluster_id", "left")
        .join(fine, "cluster_id", "left")
        .na.fill(0, ["n_agebs", "peso_total", "peso_granular"])
        .withColumns({"municipios": F.coalesce("municipios", none), "agebs_principales": F.coalesce("agebs_principales", none)})
    )


def dominant_by_municipality(u: DataFrame, granular: DataFrame | None = None) -> DataFrame:
    """(entidad, municipio, cluster_id, peso): by the zones' totals, or by the granular weights where given."""
    zones = u.select("cvegeo", "entidad", "municipio", "cluster_id", "peso_total")
    if granular is None:
        w = zones.groupBy("entidad", "municipio", "cluster_id").agg(F.sum("peso_total").alias("peso"))
    else:
        w = granular.join(zones.select("cvegeo", "entidad", "municipio"), "cvegeo").groupBy("entidad", "municipio", "cluster_id").agg(F.sum("peso").alias("peso"))
    r = F.row_number().over(Window.partitionBy("entidad", "municipio").orderBy(F.desc("peso"), "cluster_id"))
    return w.withColumn("_r", r).filter("_r = 1").drop("_r")


def relations(u: DataFrame, edges: DataFrame) -> DataFrame:
    """(origen, tipo, destino): zone to municipality, community and sector, and zone to neighbour."""
    own = u.select(F.inline(F.array(*(F.struct(F.col("cvegeo").alias("origen"), F.lit(t).alias("tipo"), c.cast("string").alias("destino")) for t, c in (
        ("ageb_municipio", F.concat("entidad", "municipio")), ("ageb_comunidad", F.col("cluster_id")), ("ageb_sector", F.col("sector_dominante"))
    )))))
    near = edges.select(F.col("src").alias("origen"), F.lit("ageb_vecino").alias("tipo"), F.col("dst").alias("destino")).distinct()
    return own.unionByName(near)


def neighbour_context(u: DataFrame, edges: DataFrame) -> DataFrame:
    """(cvegeo, agebs_relacionadas, municipios_conectados, comunidades_conectadas): sorted and distinct, over neighbours with a profile."""
    near = edges.select(F.col("src").alias("cvegeo"), F.col("dst").alias("_d")).distinct().join(u.select(F.col("cvegeo").alias("_d"), F.concat("entidad", "municipio").alias("_m"), F.col("cluster_id").alias("_c")), "_d")
    g = near.groupBy("cvegeo").agg(
        F.array_sort(F.collect_set("_d")).alias("agebs_relacionadas"), F.array_sort(F.collect_set("_m")).alias("municipios_conectados"), F.array_sort(F.collect_set("_c")).alias("comunidades_conectadas")
    )
    d = u.select("cvegeo").join(g, "cvegeo", "left")
    return d.select("cvegeo", F.coalesce("agebs_relacionadas", F.array().cast("array<string>")).alias("agebs_relacionadas"), F.coalesce("municipios_conectados", F.array().cast("array<string>")).alias("municipios_conectados"), F.coalesce("comunidades_conectadas", F.array().cast("array<int>")).alias("comunidades_conectadas"))


def with_simulation(u: DataFrame, simulation: DataFrame, nodes: DataFrame) -> DataFrame:
    """Zones with their impacts (null where there is none, never 0), island flag and whether the graph covers them."""
    covered = nodes.select(F.col("id").alias("cvegeo")).withColumn("cobertura_espacial", F.lit(True))
    return u.join(simulation, "cvegeo", "left").join(covered, "cvegeo", "left").na.fill(False, ["cobertura_espacial"])
