"""Column profiles of loads and what changes between a load and the one before it.

All figures derive from one grouped table, the *value counts*
(load, column, value -> rows, valid rows).  It is mergeable: counts of two
parts of a load add up, and so do the exact power sums drawn from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaria.session import materialise
from zonaria.sources.tables import deliveries

RESOLUTION = 256  #: buckets per doubling of a value in the two-level running sums


@dataclass(frozen=True)
class Measure:
    """A column to profile: ``valid`` is its rule over the row, ``words`` the allowed words of a text column."""

    name: str
    valid: Column
    words: tuple[str, ...] = ()


def value_counts(rows: DataFrame, load: str, measures: Sequence[Measure]) -> DataFrame:
    """(load, columna, num, ent, txt, n, n_valid): rows per distinct value.

    num, ent and txt hold the value of double, integer and text columns; all
    three are null for a null.  NaN is a value (and -0.0 is 0.0).
    """
    kinds = dict(rows.dtypes)
    items = []
    for m in measures:
        kind = kinds[m.name]
        integer = kind in ("tinyint", "smallint", "int", "bigint")
        c = F.col(m.name)
        items.append(
            F.struct(
                F.lit(m.name).alias("columna"),
                (F.lit(None) if integer or kind == "string" else c).cast("double").alias("num"),
                (c if integer else F.lit(None)).cast("bigint").alias("ent"),
                (c if kind == "string" else F.lit(None)).cast("string").alias("txt"),
                F.coalesce(c.isNotNull() & m.valid, F.lit(False)).cast("int").alias("v"),
            )
        )
    return (
        rows.select(F.col(load), F.inline(F.array(*items)))
        .groupBy(load, "columna", "num", "ent", "txt")
        .agg(F.count("*").alias("n"), F.sum("v").alias("n_valid"))
    )


def _not_null() -> Column:
    return F.coalesce("num", F.col("ent").cast("double")).isNotNull() | F.col("txt").isNotNull()


SUMS = ("s1", "s2", "s3", "s4")
GRID = 100  #: values on this grid are taken to whole numbers by arithmetic, others by their digits


def _whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, e) with x = m * 10 ** e exactly: the decimals the doubles stand for, as whole numbers of any size."""
    scaled = np.rint(x * GRID)
    plain = (scaled / GRID == x) & (abs(scaled) < 1e15)
    m, e = np.where(plain, scaled, 0).astype(np.int64).astype(object), np.full(len(x), -2)
    for k in np.flatnonzero(~plain):
        sign, digits, power = Decimal(repr(float(x[k]))).as_tuple()
        m[k], e[k] = (-1) ** sign * int("".join(map(str, digits))), power
    return m, e


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Power sums of a batch per load, column and exponent; whole numbers as text."""
    for pdf in batches:
        x, n = pdf["x"].to_numpy(dtype=float), pdf["n_valid"].to_numpy(dtype=object)
        finite = np.isfinite(x)
        m, e = _whole(np.where(finite, x, 0.0))
        part = pd.DataFrame({"carga": pdf["carga"], "columna": pdf["columna"], "e": e, "infinitos": (~finite).astype(int)})
        term = n
        for s in SUMS:
            term = term * m
            part[s] = term
        out = part.groupby(["carga", "columna", "e"], dropna=False, as_index=False).sum()
        yield out.assign(**{s: out[s].map(str) for s in SUMS})


def _merged_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row from the parts of a load and column: exact sums as decimal text, mean and variance rounded once."""
    low = int(pdf["e"].min())
    totals = [sum(int(v) * 10 ** (k * (int(e) - low)) for v, e in zip(pdf[s], pdf["e"], strict=True)) for k, s in enumerate(SUMS, 1)]
    known = not pdf["infinitos"].any()
    row = {"carga": pdf["carga"].iloc[:1], "columna": pdf["columna"].iloc[:1]}
    for k, (s, t) in enumerate(zip(SUMS, totals, strict=True), 1):
        text = format(Context(prec=10_000).scaleb(Decimal(t), k * low), "f")
        row[s] = (text.rstrip("0").rstrip(".") if "." in text else text) if known else None
    return pd.DataFrame(row)


def _moments(pdf: pd.DataFrame) -> pd.DataFrame:
    def number(f: Fraction) -> float:
        try:
            return float(f)
        except OverflowError:
            return math.inf if f > 0 else -math.inf

    media, varianza = [], []
    for s1, s2, n in zip(pdf["s1"], pdf["s2"], pdf["validos"], strict=True):
        known = isinstance(s1, str) and n > 0
        mean = Fraction(s1) / int(n) if known else None
        media.append(number(mean) if known else None)
        varianza.append(number(Fraction(s2) / int(n) - mean * mean) if known else None)
    return pdf.assign(media=pd.Series(media, index=pdf.index, dtype=float), varianza=pd.Series(varianza, index=pdf.index, dtype=float))


def power_sums(counts: DataFrame, load: str) -> DataFrame:
    """(load, columna, s1, s2, s3, s4): exact sums of the powers of the valid numbers, as decimal text.

    The decimals that the doubles stand for are summed as whole numbers of any
    size, per batch and exponent, then per load: no value is rounded or left
    out, and the sums of two parts of a load add up to those of the whole.
    They are null when a valid value is infinite or no number.
    """
    kind = dict(counts.dtypes)[load]
    numbers = counts.filter(F.col("n_valid") > 0).filter(F.col("txt").isNull())
    rows = numbers.select(F.col(load).alias("carga"), "columna", F.coalesce("num", F.col("ent").cast("double")).alias("x"), "n_valid")
    text = ", ".join(f"{s} string" for s in SUMS)
    parts = rows.mapInPandas(_partial_sums, f"carga {kind}, columna string, e int, infinitos bigint, {text}")
    return parts.groupBy("carga", "columna").applyInPandas(_merged_sums, f"carga {kind}, columna string, {text}").withColumnRenamed("carga", load)


def profile(counts: DataFrame, load: str) -> DataFrame:
    """One row per load and column: rows, nulls, violations, distinct values, range, exact power sums, mean and variance.

    s1..s4, media and varianza are null for columns without valid numbers;
    integers beyond 2 ** 53 count as the double next to them.
    """
    number = F.coalesce("num", F.col("ent").cast("double"))
    valid_number = F.when(F.col("n_valid") > 0, number)
    base = counts.groupBy(load, "columna").agg(
        F.sum("n").alias("filas"),
        F.sum(F.when(~_not_null(), F.col("n")).otherwise(0)).alias("nulos"),
        F.sum(F.when(_not_null(), F.col("n") - F.col("n_valid")).otherwise(0)).alias("no_validos"),
        F.sum("n_valid").alias("validos"),
        F.count_if(_not_null()).alias("distintos"),
        F.min(valid_number).alias("minimo"),
        F.max(valid_number).alias("maximo"),
    )
    sums = power_sums(counts, load).select(F.col(load).alias("_carga"), F.col("columna").alias("_columna"), *SUMS)
    both = base.join(sums, F.col(load).eqNullSafe(F.col("_carga")) & (F.col("columna") == F.col("_columna")), "left").drop("_carga", "_columna")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in both.dtypes), "media double", "varianza double"])
    return both.mapInPandas(lambda it: map(_moments, it), schema)


def predecessors(loads: DataFrame, load: str) -> DataFrame:
    """(load, anterior): the load of the same feed with the next smaller month.

    ``loads`` has one row per load, so the window over a feed holds its months.
    A name that isn't ``feed-YYYYMM`` has no predecessor.
    """
    feed = F.regexp_extract(load, r"(?s)^(.*)-(\d{6})$", 1)
    month = F.regexp_extract(load, r"(?s)^(.*)-(\d{6})$", 2)
    w = Window.partitionBy("_feed").orderBy("_mes")
    named = loads.select(load).filter(F.col(load).isNotNull()).distinct().withColumns({"_feed": feed, "_mes": month})
    return named.filter(F.col("_mes") != "").withColumn("anterior", F.lag(load).over(w)).select(load, "anterior")


def with_previous(prof: DataFrame, load: str) -> DataFrame:
    """The profile with the preceding load's figures (``p_`` columns) and standardised differences.

    ``dif_media`` is the difference of the means over the pooled standard
    deviation, ``separacion`` that over the sum of the standard deviations (no
    number when both are 0 and the means differ, which is infinitely far) and
    ``razon_sd`` the ratio of the standard deviations.
    """
    seq = predecessors(prof, load)
    before = prof.select(
        F.col(load).alias("anterior"),
        "columna",
        *(F.col(c).alias(f"p_{c}") for c in prof.columns if c not in (load, "columna")),
    )
    apart, spread = F.col("media") - F.col("p_media"), F.sqrt("varianza") + F.sqrt("p_varianza")
    pooled = F.sqrt((F.col("varianza") + F.col("p_varianza")) / 2)
    return (
        prof.join(seq, load, "left")
        .join(before, ["anterior", "columna"], "left")
        .withColumn("dif_media", F.when(pooled > 0, (F.col("media") - F.col("p_media")) / pooled))
        .withColumn("separacion", F.when(spread > 0, F.abs(apart) / spread).when(apart != 0, float("inf")).when(apart == 0, 0.0))
        .withColumn("razon_sd", F.when(F.col("p_varianza") > 0, F.sqrt(F.col("varianza") / F.col("p_varianza"))))
    )


def gaps(counts: DataFrame, both: DataFrame, load: str) -> DataFrame:
    """(load, columna, brecha, n_ahora, n_antes): largest gap between a load's shares and those of the one before.

    Numbers: the largest difference over all v of the shares of values <= v,
    scaled by n_ahora * n_antes so that it stays an exact integer.  Texts: the
    sum of the absolute differences of the word shares on the same scale (twice
    the total variation).  Running sums have two levels (buckets of nearby
    values, values inside a bucket), so no task sorts all values of a load.
    """
    valid = counts.filter(F.col("n_valid") > 0)
    pairs = both.filter(F.col("anterior").isNotNull() & (F.col("validos") > 0) & (F.col("p_validos") > 0)).select(
        load, "anterior", "columna", F.col("validos").alias("n_ahora"), F.col("p_validos").alias("n_antes")
    )
    sides = F.array(
        F.struct(F.col(load).alias("par"), F.lit(1).alias("es_ahora")),
        F.struct(F.col("_sig").alias("par"), F.lit(0).alias("es_ahora")),
    )
    nxt = pairs.select(F.col("anterior").alias(load), "columna", F.col(load).alias("_sig"))
    value = F.coalesce("num", F.col("ent").cast("double"))
    merged = (
        valid.join(nxt, [load, "columna"], "left")
        .select("columna", "num", "ent", "txt", "n_valid", F.inline(sides))
        .filter(F.col("par").isNotNull())
        .groupBy("par", "columna", "num", "ent", "txt")
        .agg(
            F.sum(F.when(F.col("es_ahora") == 1, F.col("n_valid")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("es_ahora") == 0, F.col("n_valid")).otherwise(0)).alias("b"),
        )
        .withColumn("cubo", F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * RESOLUTION))
    )
    key = ["par", "columna", "cubo"]
    inside = Window.partitionBy(*key).orderBy("num", "ent").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("par", "columna").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    numbers = merged.filter(F.col("txt").isNull())
    offsets = (
        numbers.groupBy(*key)
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .select(*key, F.coalesce(F.sum("a").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("ob"))
    )
    at = pairs.select(F.col(load).alias("par"), "columna", "n_ahora", "n_antes")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    diff = F.abs(big("ca") * big("n_antes") - big("cb") * big("n_ahora"))
    running = (
        numbers.select(*key, F.sum("a").over(inside).alias("a"), F.sum("b").over(inside).alias("b"))
        .join(offsets, key)
        .select("par", "columna", (F.col("oa") + F.col("a")).alias("ca"), (F.col("ob") + F.col("b")).alias("cb"))
        .join(at, ["par", "columna"])
        .groupBy("par", "columna")
        .agg(F.max(diff).alias("brecha"), F.max("n_ahora").alias("n_ahora"), F.max("n_antes").alias("n_antes"))
    )
    words = (
        merged.filter(F.col("txt").isNotNull())
        .select("par", "columna", F.col("a").alias("ca"), F.col("b").alias("cb"))
        .join(at, ["par", "columna"])
        .groupBy("par", "columna")
        .agg((F.sum(diff) / 2).cast("decimal(38,1)").alias("brecha"), F.max("n_ahora").alias("n_ahora"), F.max("n_antes").alias("n_antes"))
    )
    return running.withColumn("brecha", F.col("brecha").cast("decimal(38,1)")).unionByName(words).withColumnRenamed("par", load)


def certainly_shifted(gap: float) -> Column:
    """Whether means and variances alone prove a gap above ``gap`` between two loads.

    By the one-sided Chebyshev bound at the point that parts the means in
    proportion to the standard deviations, the gap is at least
    1 - 2 / (1 + separacion ** 2).  Moments can't prove the contrary, so all
    other pairs of loads have their running sums compared.
    """
    return F.coalesce(F.col("separacion") * F.col("separacion") > (1 + gap) / (1 - gap) * (1 + 1e-6), F.lit(False))


def findings(counts: DataFrame, measures: Sequence[Measure], load: str, null_step: str = "0.10", gap: str = "0.25") -> DataFrame:
    """(load, columna, hallazgo), one row per finding: nulos, rango, patron, constante, distribucion.

    A first load, or one without values on either side, has no finding against
    its predecessor.  Shares are compared as exact fractions, so a difference
    equal to the threshold is no finding.  Rows without load belong to none.
    distribucion comes from the standardised difference of the means where that
    decides (see certainly_shifted), else from the exact running sums.
    """
    counts = counts.filter(F.col(load).isNotNull())
    both = materialise(with_previous(profile(counts, load), load))
    big = lambda c: F.col(c).cast("decimal(16,0)")
    step = F.lit(null_step).cast("decimal(4,3)")
    more_nulls = big("nulos") * big("p_filas") - big("p_nulos") * big("filas") > step * (big("filas") * big("p_filas"))
    texts = [m.name for m in measures if m.words]
    own = both.select(
        load,
        "columna",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("anterior").isNotNull() & more_nulls, F.lit("nulos")),
                    F.when(F.col("no_validos") > 0, F.when(F.col("columna").isin(texts), F.lit("patron")).otherwise(F.lit("rango"))),
                    F.when(F.col("distintos") == 1, F.lit("constante")),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("hallazgo"),
    )
    big18 = lambda c: F.col(c).cast("decimal(18,0)")
    far = certainly_shifted(float(gap))
    own = own.unionByName(both.filter(far).select(load, "columna", F.lit("distribucion").alias("hallazgo")))
    shifted = gaps(counts, both.filter(~far), load).filter(F.col("brecha") > F.lit(gap).cast("decimal(3,2)") * (big18("n_ahora") * big18("n_antes")))
    return own.unionByName(shifted.select(load, "columna", F.lit("distribucion").alias("hallazgo")))


def warehouse_measures() -> list[Measure]:
    # The methods a weight can have.
    words = ("empleo", "establecimientos", "sin_datos")
    e, k = F.col("empleo_total"), F.col("n_empleo_faltante")
    finite = ~F.isnan(e) & (F.abs(e) != float("inf"))
    return [
        Measure("empleo_total", finite & (e >= 0)),
        Measure("n_empleo_faltante", (k >= 0) & (k <= F.col("n_establecimientos"))),
        Measure("omega_metodo", F.col("omega_metodo").rlike(r"\A(?:" + "|".join(words) + r")\z"), words),
    ]


def warehouse_counts(warehouse: DataFrame) -> tuple[DataFrame, list[Measure]]:
    """Value counts of the warehouse, repeated deliveries once; written, as every figure is drawn from them."""
    ms = warehouse_measures()
    rows = deliveries(warehouse, "fila_id", "lote", "n_establecimientos", *(m.name for m in ms))
    return materialise(value_counts(rows, "lote", ms)), ms


def warehouse_findings(warehouse: DataFrame) -> DataFrame:
    counts, ms = warehouse_counts(warehouse)
    return findings(counts, ms, "lote").select("lote", "columna", "hallazgo")


def warehouse_profile(warehouse: DataFrame) -> DataFrame:
    counts, _ = warehouse_counts(warehouse)
    return with_previous(profile(counts.filter(F.col("lote").isNotNull()), "lote"), "lote")
