"""The N best items of every group, ties by identifier."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.functions.codes import norm_code
from zonaria.session import materialise
from zonaria.sources.tables import deliveries

PLAIN = 1e24  #: smaller weights are summed in one decimal, larger ones in decimals of their own size
PLACES = 6  #: decimal places of a sum
STEP = 8  #: powers of ten that share one decimal above PLAIN


def top_n(df: DataFrame, group: str, item: str, order: list[str], n: int) -> DataFrame:
    """(group, puesto, item): rows ranked in every group by ``order``, which must end in the item.

    The filter on row_number lets the optimiser put a group limit before the
    shuffle, so at most n rows per group leave a task, and again after it.  A
    null group is a group of its own; null items and scores rank last.
    """
    spark: SparkSession = df.sparkSession
    by = ", ".join(order)
    return spark.sql(
        f"select `{group}`, puesto, `{item}` from (select `{group}`, `{item}`, row_number() over (partition by `{group}` order by {by}) as puesto from {{d}}) where puesto <= {int(n)}",
        d=df,
    ).withColumn("puesto", F.col("puesto").cast("bigint"))


def weight(c: str) -> Column:
    """A weight as a double; null, negative and not finite weigh 0."""
    x = F.col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= 0), x).otherwise(0.0)


def _large_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, partes): sums of the weights from PLAIN on as (unit, sum), each an exact decimal in powers of ten.

    A double's digits times ten to the power between STEP and 2 * STEP above its
    unit is a whole number of at most 10 + 2 * STEP digits, so 10^10 of them fit
    in a decimal.  A group has at most 36 units.
    """
    text = F.col("x").cast("string")  # as 1.25E30
    power = F.regexp_extract(text, r"E(\d+)$", 1).cast("int")
    unit = power - F.pmod(power, F.lit(STEP)) - 2 * STEP
    whole = F.concat(F.regexp_extract(text, r"^([0-9.]+)E", 1), F.lit("E"), power - F.col("unidad")).cast("decimal(38,0)")
    sums = rows.withColumn("unidad", unit).groupBy(*keys, "unidad").agg(F.sum(whole).alias("s"))
    return sums.groupBy(*keys).agg(F.collect_list(F.struct("unidad", "s")).alias("partes"))


def _digits(w: pd.Series, parts: pd.Series) -> pd.Series:
    """Sums as digits of one length, which order as the numbers do."""
    out = []
    for small, large in zip(w, parts, strict=True):
        total = int(small.scaleb(PLACES)) if small is not None else 0
        for p in large if large is not None else ():
            total += int(p["s"]) * 10 ** (int(p["unidad"]) + PLACES)
        out.append(f"{total:0340d}")
    return pd.Series(out)


def totals(rows: DataFrame, keys: Sequence[str], large: DataFrame | None) -> DataFrame:
    """``rows`` (keys, w) with ``orden``, the exact sum in a form that orders.

    ``large`` are the rows (keys, x) from PLAIN on, None where there are none:
    then the decimal itself is the order.
    """
    if large is None:
        return rows.withColumn("orden", F.col("w"))
    more = _large_sums(large, keys)
    named = more.select(*(F.col(k).alias(f"_{k}") for k in keys), "partes")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*(f"_{k}" for k in keys)).withColumn("orden", F.pandas_udf(_digits, "string")("w", "partes"))


def leaders(warehouse: DataFrame, zones: int = 5) -> DataFrame:
    """(lista, grupo, puesto, elemento): dominant sector of each zone and the heaviest zones of each municipality.

    Weights of any size are summed as exact decimals, so equal totals are equal
    in any order of addition, and finer parts than 10^-PLACES are rounded off
    each weight.  Rows without zone are left out; rows without sector count for
    their zone only.  Totals of (zone, sector) are formed before anything is
    ranked, so a hot zone or sector leaves each task as one row.
    """
    rows = deliveries(warehouse, "fila_id", "cvegeo", "sector_serio", "empleo_total").filter(F.col("cvegeo").isNotNull())
    rows = rows.select("cvegeo", norm_code("sector_serio").alias("sector"), weight("empleo_total").alias("x"))
    plain = F.when(F.col("x") < PLAIN, F.col("x")).otherwise(0.0).cast(f"decimal(30,{PLACES})")
    pairs = materialise(rows.groupBy("cvegeo", "sector").agg(F.sum(plain).alias("w"), F.count_if(F.col("x") >= PLAIN).alias("grandes")))
    large = materialise(rows.filter(F.col("x") >= PLAIN)) if pairs.filter("grandes > 0").limit(1).count() else None
    by_pair = totals(pairs.filter(F.col("sector").isNotNull()).select("cvegeo", "sector", "w"), ["cvegeo", "sector"], large)
    best = top_n(by_pair, "cvegeo", "sector", ["orden desc", "sector"], 1)
    by_zone = totals(pairs.groupBy("cvegeo").agg(F.sum("w").alias("w")), ["cvegeo"], large).withColumn("mun", F.substring("cvegeo", 1, 5))
    heaviest = top_n(by_zone, "mun", "cvegeo", ["orden desc", "cvegeo"], zones)
    return best.select(F.lit("sector_dominante").alias("lista"), F.col("cvegeo").alias("grupo"), "puesto", F.col("sector").alias("elemento")).unionByName(
        heaviest.select(F.lit("agebs_principales").alias("lista"), F.col("mun").alias("grupo"), "puesto", F.col("cvegeo").alias("elemento"))
    )
