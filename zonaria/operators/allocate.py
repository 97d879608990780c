"""Spreading sector shocks over zones by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaria.operators.warehouse import TOLERANCE


def allocate(omega: DataFrame, shock: DataFrame) -> DataFrame:
    """(cvegeo, sector, omega, omega_metodo, shock_sectorial, shock_ageb) of the sectors with a shock.

    Zones whose weight is null take no part.  A sector without any weight gets
    no fallback (see ``uncovered``).
    """
    s = shock.select("sector", F.col("delta_x").alias("shock_sectorial"))
    d = omega.filter(F.col("omega").isNotNull()).join(s, "sector")
    return d.select("cvegeo", "sector", "omega", "omega_metodo", "shock_sectorial", (F.col("omega") * F.col("shock_sectorial")).alias("shock_ageb"))


def uncovered(omega: DataFrame, shock: DataFrame) -> DataFrame:
    """(sector): sectors of the shock without a weight anywhere."""
    return shock.select("sector").join(omega.filter(F.col("omega").isNotNull()).select("sector").distinct(), "sector", "left_anti")


def allocation_report(omega: DataFrame, shock: DataFrame) -> DataFrame:
    """Per covered sector: zones with and without weight, sum of weights, whether it is off one, total distributed."""
    per = omega.groupBy("sector").agg(
        F.count("omega").alias("zonas"), F.count_if(F.col("omega").isNull()).alias("zonas_excluidas"), F.sum("omega").alias("suma_omega")
    )
    d = shock.join(per.filter("zonas > 0"), "sector")
    return d.withColumn("no_normalizado", F.abs(F.col("suma_omega") - 1) > TOLERANCE).withColumn("distribuido", F.col("suma_omega") * F.col("delta_x"))


def shock_vector(allocated: DataFrame) -> DataFrame:
    """(cvegeo, s): the shock of each zone over all sectors."""
    return allocated.groupBy("cvegeo").agg(F.sum("shock_ageb").alias("s"))
