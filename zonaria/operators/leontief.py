"""Input-output operators over long tables keyed by state: coefficients, inverse, shocks, multipliers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonaria.errors import ContractError, ScenarioConfigError

UNIT = 1e-6  #: the model counts in millions
MAX_SECTORS = 2_000  #: sectors up to which a state's matrix is inverted in one task


def coefficients(flows: DataFrame, column_sum: float | None = None) -> DataFrame:
    """(state, i, j, a) from flows (state, i, j, z): each column over its sum, times ``column_sum`` where given."""
    total = flows.groupBy("state", "j").agg(F.sum("z").alias("_t"))
    d = flows.join(total, ["state", "j"]).filter(F.col("_t") != 0)
    return d.select("state", "i", "j", (F.col("z") / F.col("_t") * (1.0 if column_sum is None else column_sum)).alias("a"))


def inverse(a: DataFrame) -> DataFrame:
    """(state, i, j, l): (I - A)^-1 of every state, one dense inverse per task (at most MAX_SECTORS sectors)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf["i"], *pdf["j"]})
        if len(ids) > MAX_SECTORS:
            raise ContractError(f"{len(ids)} sectors in one state")
        at = {x: k for k, x in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()), pdf["a"].to_numpy())
        inv = np.linalg.inv(np.eye(len(ids)) - m)
        return pd.DataFrame({"state": pdf["state"].iloc[0], "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "l": inv.ravel()})

    return a.groupBy("state").applyInPandas(run, "state string, i string, j string, l double")


def shock(l_matrix: DataFrame, demand: DataFrame, vectors: DataFrame) -> DataFrame:
    """The detail of one or many shocks: ΔX = L ΔY, ΔVA = v ΔX, ΔE = e ΔX by sector.

    ``demand`` is (escenario, state, sector, monto); several sectors of a
    scenario superpose.  ``vectors`` is (state, sector, x, v, e): production,
    value added and employment per unit of production.  All scenarios and
    states run in one job.  variacion_pct is null where production is <= 1e-6,
    share 0 where ΔX sums to 0.
    """
    dx = (
        l_matrix.join(demand.select("escenario", "state", F.col("sector").alias("j"), (F.col("monto") * UNIT).alias("m")), ["state", "j"])
        .groupBy("escenario", "state", F.col("i").alias("sector"))
        .agg(F.sum(F.col("l") * F.col("m")).alias("delta_X"))
    )
    total = dx.groupBy("escenario", "state").agg(F.sum("delta_X").alias("_t"))
    origin = demand.select("escenario", "state", "sector", F.lit(True).alias("_o")).distinct()
    d = dx.join(total, ["escenario", "state"]).join(vectors, ["state", "sector"], "left").join(origin, ["escenario", "state", "sector"], "left")
    return d.select(
        "escenario",
        "state",
        "sector",
        "delta_X",
        (F.col("delta_X") / UNIT).alias("delta_X_pesos"),
        (F.col("delta_X") * F.col("v")).alias("delta_VA"),
        (F.col("delta_X") * F.col("e")).alias("delta_E"),
        F.when(F.col("x") > 1e-6, F.col("delta_X") / F.col("x") * 100).alias("variacion_pct"),
        F.when(F.col("_t") != 0, F.col("delta_X") / F.col("_t")).otherwise(0.0).alias("share_produccion"),
        F.coalesce("_o", F.lit(False)).alias("es_origen_shock"),
    )


def by_size(detail: DataFrame, sectors: DataFrame) -> DataFrame:
    """A shock's detail with the sectors' names and ``lugar``: largest absolute change first, ties in the model's order of sectors.

    ``sectors`` is (indice, sector, nombre).  Contractions rank by their size,
    as expansions do.  A state has at most MAX_SECTORS rows.
    """
    d = detail.join(sectors.select("indice", "sector", "nombre"), "sector", "left")
    place = F.row_number().over(Window.partitionBy("escenario", "state").orderBy(F.desc(F.round(F.abs("delta_X_pesos"), 3)), F.asc_nulls_last("indice"), "sector"))
    return d.withColumn("lugar", place)


def shock_totals(detail: DataFrame, demand: DataFrame) -> DataFrame:
    """(escenario, state, delta_X, delta_VA, delta_E, mult_produccion, mult_valor, mult_empleo): multipliers are 0 for an amount of 0."""
    amount = demand.groupBy("escenario", "state").agg(F.sum(F.col("monto") * UNIT).alias("_m"))
    sums = detail.groupBy("escenario", "state").agg(*(F.sum(c).alias(c) for c in ("delta_X", "delta_VA", "delta_E")))
    per = lambda c: F.when(F.col("_m") != 0, F.col(c) / F.col("_m")).otherwise(0.0)
    d = sums.join(amount, ["escenario", "state"])
    return d.select(*sums.columns, per("delta_X").alias("mult_produccion"), per("delta_VA").alias("mult_valor"), per("delta_E").alias("mult_empleo"))


def compare_states(l_matrix: DataFrame, vectors: DataFrame, sector: str, amount: float) -> DataFrame:
    """Totals of one shock in every state where the sector is active (v > 0), by production multiplier; none gives no rows."""
    active = vectors.filter((F.col("sector") == sector) & (F.col("v") > 0))
    demand = active.select(F.lit(0).alias("escenario"), "state", "sector", F.lit(float(amount)).alias("monto"))
    return shock_totals(shock(l_matrix, demand, vectors), demand).drop("escenario").orderBy(F.desc("mult_produccion"), "state")


def top_multipliers(l_matrix: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """(state, sector, multiplicador): the n largest column sums of L per state among active sectors, ties by sector."""
    sums = l_matrix.groupBy("state", F.col("j").alias("sector")).agg(F.sum("l").alias("multiplicador"))
    d = sums.join(vectors.filter("v > 0").select("state", "sector"), ["state", "sector"])
    return d.sparkSession.sql(
        f"select state, sector, multiplicador from (select *, row_number() over (partition by state order by round(multiplicador, 9) desc, sector) as r from {{d}}) where r <= {int(n)}", d=d
    )


def value_added(a: DataFrame) -> DataFrame:
    """(state, j, v_n): 1 minus the column sum of A, between 0 and 1."""
    return a.groupBy("state", "j").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sum("a"))).alias("v_n"))


def linkages(l_matrix: DataFrame) -> DataFrame:
    """(state, sector, bl, fl): column and row sums of L over their means."""
    back = l_matrix.groupBy("state", F.col("j").alias("sector")).agg(F.sum("l").alias("b"))
    forth = l_matrix.groupBy("state", F.col("i").alias("sector")).agg(F.sum("l").alias("f"))
    d = back.join(forth, ["state", "sector"])
    mean = d.groupBy("state").agg(F.avg("b").alias("mb"), F.avg("f").alias("mf"))
    return d.join(mean, "state").select("state", "sector", (F.col("b") / F.col("mb")).alias("bl"), (F.col("f") / F.col("mf")).alias("fl"))


def state_summary(vectors: DataFrame) -> DataFrame:
    """(state, suma_X, suma_VA, suma_E, activos)."""
    return vectors.groupBy("state").agg(
        F.sum("x").alias("suma_X"), F.sum(F.col("v") * F.col("x")).alias("suma_VA"), F.sum(F.col("e") * F.col("x")).alias("suma_E"), F.count_if(F.col("v") > 0).alias("activos")
    )


def read_arrays(spark: SparkSession, folder: str, state: str, sectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(L, vectors) of a state's .npy arrays L, X, v and e as long tables; shapes must fit the sectors."""
    m, n = np.load(f"{folder}/{state}/L.npy"), len(sectors)
    x, v, e = (np.load(f"{folder}/{state}/{k}.npy") for k in ("X", "v", "e"))
    if m.shape != (n, n) or any(a.shape != (n,) for a in (x, v, e)):
        raise ContractError("array shapes don't fit the sectors")
    long = pd.DataFrame({"state": state, "i": np.repeat(sectors, n), "j": np.tile(sectors, n), "l": m.ravel()})
    vec = pd.DataFrame({"state": state, "sector": sectors, "x": x, "v": v, "e": e})
    return spark.createDataFrame(long), spark.createDataFrame(vec)


def check_sector(vectors: DataFrame, state: str, sector: str) -> bool:
    """Whether the sector is active in the state; unknown ones raise."""
    rows = vectors.filter(F.col("state") == state).select("sector", "v").collect()
    if not rows:
        raise ScenarioConfigError(f"unknown state {state}")
    v = {r["sector"]: r["v"] for r in rows}
    if sector not in v:
        raise ScenarioConfigError(f"unknown sector {sector}")
    return (v[sector] or 0) > 0
