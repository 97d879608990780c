"""References whose key is missing from its catalogue, or not in force in the month of the reference."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaria.functions.codes import month_start, norm_code
from zonaria.session import materialise

RANGE_KEYS = 250_000  #: parent rows per key range, at most
LEAST_KEYS = 64  #: parent rows below which a range isn't cut further
PROBE_KEYS = 1_000_000  #: distinct references per probing task
SMALL_MISSES = 100_000  #: misses up to which they are broadcast to the referring rows


@dataclass(frozen=True)
class Parents:
    """A catalogue: key, start and end of force (both null when it has none)."""

    name: str
    rows: DataFrame
    key: Column
    since: Column
    until: Column


@dataclass(frozen=True)
class References:
    """A referring column: ``ident`` names the row, ``month`` is its first instant, ``period`` as it is reported."""

    table: str
    field: str
    target: str
    rows: DataFrame
    ident: str
    key: Column
    month: Column
    period: Column


def _probe(parents: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """Verdicts of a range's references against its parents, held as arrays sorted by key and start.

    The parents of a key that start before a reference's month ends are a
    prefix of its slice, found by one binary search; the latest end within the
    prefix is a running maximum.  No step loops over keys, parents or references.
    """
    out = refs[["objetivo", "llave", "mes"]].copy()
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    us = lambda s, null: s.astype("datetime64[us]").astype("int64").where(s.notna(), null).to_numpy()
    p_keys, r_keys = ((d["objetivo"] + "\x00" + d["llave"]).to_numpy(dtype=object) for d in (parents, out))
    since, until = us(parents["desde"], low), us(parents["hasta"], high)
    start, end = us(out["mes"], low), us(refs["mes_fin"], low)
    keys = np.unique(p_keys)
    p_code, r_code = np.searchsorted(keys, p_keys), np.searchsorted(keys, r_keys)
    there = r_code < len(keys)
    there[there] = keys[r_code[there]] == r_keys[there]
    order = np.lexsort((since, p_code))
    p_code, since, until = p_code[order], since[order], until[order]
    # One number per key and date, the date by its place among all dates, so that one search finds both.
    dates = np.unique(np.concatenate([since, end]))
    width = len(dates) + 1
    prefix = np.searchsorted(p_code * width + np.searchsorted(dates, since), r_code * width + np.searchsorted(dates, end), "left")
    begun = there & (prefix > np.searchsorted(p_code, r_code, "left"))
    latest = pd.Series(until).groupby(p_code).cummax().to_numpy()
    held = begun.copy()
    held[begun] = latest[prefix[begun] - 1] > start[begun]
    known = out["mes"].notna().to_numpy()
    out["motivo"] = np.where(~there, "inexistente", np.where(begun | ~known, "retirada", "posterior"))
    return out[~there | (known & ~held)]


def _parent_table(parents: Sequence[Parents]) -> DataFrame:
    """(objetivo, llave, desde, hasta): per key and month of start the latest end, null when one has no end.

    References ask about whole months, so a start matters by its month and of
    the rows that start in one month only the one that lasts longest.  A key
    with any number of rows is left with one per month, summed up before the
    shuffle.
    """
    out = None
    for p in parents:
        start = F.date_trunc("month", p.since.cast("timestamp"))
        d = p.rows.select(F.lit(p.name).alias("objetivo"), p.key.alias("llave"), start.alias("desde"), p.until.cast("timestamp").alias("hasta"))
        last = F.when(F.count_if(F.col("hasta").isNull()) == 0, F.max("hasta"))
        d = d.filter(F.col("llave").isNotNull()).groupBy("objetivo", "llave", "desde").agg(last.alias("hasta"))
        out = d if out is None else out.unionByName(d)
    return out


def _referring(r: References, *more: Column) -> DataFrame:
    """Rows with a key; a blank or null key refers to nothing."""
    d = r.rows.select(F.lit(r.table).alias("tabla"), F.lit(r.field).alias("campo"), F.lit(r.target).alias("objetivo"), r.key.alias("llave"), r.month.cast("timestamp").alias("mes"), *more)
    return d.filter(F.col("llave").isNotNull())


def _ranges(parents: DataFrame) -> list[str]:
    """First key of every key range but the lowest.

    As many ranges as the session has shuffle partitions, but none of fewer than
    LEAST_KEYS parents or more than RANGE_KEYS.
    """
    count, tasks = parents.count(), int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-count // RANGE_KEYS), min(tasks, count // LEAST_KEYS))
    if n < 2:
        return []
    full = F.concat("objetivo", F.lit("\x00"), "llave").alias("k")
    firsts = parents.select(full).repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted(r["k"] for r in firsts.collect())[1:]


def misses(refs: Sequence[References], parents: Sequence[Parents]) -> DataFrame:
    """(objetivo, llave, mes, motivo): the distinct references that don't hold.

    References are reduced to distinct (key, month) on the map side before any
    shuffle, so a key that owns most rows weighs no more than any other.  Keys
    are cut into ranges; a range with many references is split into shards, and
    its parents go to each shard.  Every shard is one task's sorted arrays.
    """
    table = materialise(_parent_table(parents))
    bounds = _ranges(table)
    keys = None
    for r in refs:
        d = _referring(r).select("objetivo", "llave", "mes").distinct()
        keys = d if keys is None else keys.unionByName(d)
    keys = keys.distinct()

    def to_range(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.searchsorted(np.array(bounds, dtype=object), s.to_numpy(dtype=object), "right")).astype("int32")

    full = F.concat("objetivo", F.lit("\x00"), "llave")
    rango = F.pandas_udf(to_range, "int")(full)
    keys = materialise(keys.select("*", F.add_months("mes", 1).cast("timestamp").alias("mes_fin"), rango.alias("rango")))
    shards = keys.groupBy("rango").agg(F.ceil(F.count("*") / PROBE_KEYS).cast("int").alias("partes"))
    copies = F.explode(F.sequence(F.lit(0), F.col("partes") - 1)).alias("p_parte")
    home = table.select("*", rango.alias("rango")).join(shards, "rango").select("objetivo", "llave", "desde", "hasta", F.col("rango").alias("p_rango"), copies)
    sharded = keys.join(shards, "rango").withColumn("parte", F.pmod(F.xxhash64("llave", "mes"), F.col("partes")).cast("int"))
    out = "objetivo string, llave string, mes timestamp, motivo string"
    return sharded.groupBy("rango", "parte").cogroup(home.groupBy("p_rango", "p_parte")).applyInPandas(lambda r, p: _probe(p, r), out)


def orphans(refs: Sequence[References], parents: Sequence[Parents]) -> DataFrame:
    """(tabla, campo, periodo, fila_id, motivo): one row per referring row whose reference doesn't hold.

    Null and blank keys refer to nothing.  A row whose month is unknown is only
    tested for existence.  A row delivered again counts once.  The misses are
    broadcast to the referring rows when their counted number is small, else
    both sides are shuffled and adaptive execution splits skewed keys.
    """
    bad = materialise(misses(refs, parents))
    few = bad.count() <= SMALL_MISSES
    bad = F.broadcast(bad) if few else bad
    out = None
    for r in refs:
        d = _referring(r, r.period.alias("periodo"), F.col(r.ident).alias("fila_id"))
        b = bad.select(*(F.col(c).alias(f"_{c}") for c in ("objetivo", "llave", "mes")), "motivo")
        same = (F.col("objetivo") == F.col("_objetivo")) & (F.col("llave") == F.col("_llave")) & F.col("mes").eqNullSafe(F.col("_mes"))
        d = d.join(b, same).select("tabla", "campo", "periodo", "fila_id", "motivo", "llave").distinct().drop("llave")
        out = d if out is None else out.unionByName(d)
    return out


def report(refs: Sequence[References], parents: Sequence[Parents]) -> DataFrame:
    """(tabla, campo, periodo, motivo, filas): orphans per table and period."""
    return orphans(refs, parents).groupBy("tabla", "campo", "periodo", "motivo").agg(F.count("*").alias("filas"))


def economy(warehouse: DataFrame, denue: DataFrame, crosswalk: DataFrame, sectores: DataFrame, scian: DataFrame) -> tuple[list[References], list[Parents]]:
    """The references between the warehouse, the register and their catalogues."""
    since, until = F.col("vigente_desde"), F.col("vigente_hasta")
    start = F.date_trunc("month", "vigente_desde")
    period = F.date_format("vigente_desde", "yyyy-MM")
    month, per = month_start("periodo"), F.col("periodo")
    refs = [
        References("warehouse", "sector_serio", "sectores", warehouse, "fila_id", norm_code("sector_serio"), month, per),
        References("denue", "codigo_act", "crosswalk", denue, "fila_id", norm_code("codigo_act"), month, per),
        References("crosswalk", "sector_serio", "sectores", crosswalk, "fila_id", norm_code("sector_serio"), start, period),
        References("crosswalk", "scian_codigo", "scian", crosswalk, "fila_id", norm_code("scian_codigo"), start, period),
    ]
    parents = [
        Parents("sectores", sectores, norm_code("scian"), since, until),
        Parents("crosswalk", crosswalk, norm_code("scian_codigo"), since, until),
        Parents("scian", scian, norm_code("scian_codigo"), since, until),
    ]
    return refs, parents
