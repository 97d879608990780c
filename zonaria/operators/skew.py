"""Per-key results when a few keys own most rows: fragment and replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.functions.codes import norm_code
from zonaria.session import materialise

BUCKETS_PER_TASK = 16  #: hash buckets for the light keys, per task


def slots(spark: SparkSession, tasks: int) -> list[int]:
    """For each partition number the smallest integer that hash partitioning sends there."""
    found: dict[int, int] = {}
    n = 0
    while len(found) < tasks:
        step = max(1024, 8 * tasks)
        rows = spark.range(n, n + step, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
        for r in rows.collect():
            found.setdefault(r["p"], r["id"])
        n += step
    return [found[p] for p in range(tasks)]


@dataclass(frozen=True)
class Plan:
    """``heavy``: key -> the slots of its shards.  ``light``: slot of each hash bucket of the other keys."""

    tasks: int
    heavy: dict[str, list[int]]
    light: list[int]


def plan(loads: DataFrame, key: str, rows: str, tasks: int) -> Plan:
    """Bin-packs keys to tasks by their row counts.

    ``loads`` has one row per key; a null key is a key like any other, named "".
    A key above a task's fair share is split in
    proportion to it, so there are at most 2 * tasks shards; every other key
    goes with its hash bucket.  Shards and buckets, largest first, go to the
    task with the least load.  The driver holds O(tasks) numbers.
    """
    spark = loads.sparkSession
    slot = slots(spark, tasks)
    total = loads.agg(F.sum(rows)).first()[0] or 0
    share = max(1, -(-total // tasks))
    buckets = BUCKETS_PER_TASK * tasks
    loads = loads.groupBy(_named(key).alias(key)).agg(F.sum(rows).alias(rows))
    heavy = loads.filter(F.col(rows) >= share).select(key, rows).collect()
    light = (
        loads.filter(F.col(rows) < share)
        .groupBy(_bucket(F.col(key), buckets).alias("b"))
        .agg(F.sum(rows).alias("n"))
        .collect()
    )
    pieces: list[tuple[int, str | int]] = []
    for r in heavy:
        parts = -(-r[rows] // share)
        pieces += [(-(-r[rows] // parts), r[key])] * parts
    pieces += [(r["n"], r["b"]) for r in light]
    bins = [(0, t) for t in range(tasks)]
    at: dict[str, list[int]] = {r[key]: [] for r in heavy}
    where = [slot[b % tasks] for b in range(buckets)]
    for n, what in sorted(pieces, key=lambda p: (-p[0], str(p[1]))):
        load, t = heapq.heappop(bins)
        heapq.heappush(bins, (load + n, t))
        if isinstance(what, str):
            at[what].append(slot[t])
        else:
            where[what] = slot[t]
    return Plan(tasks, at, where)


def _named(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit(""))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _placed(p: Plan, df: DataFrame, key: str, kind: str) -> DataFrame:
    """``df`` with ``_slots``, the slots its key lives in."""
    spark = df.sparkSession
    slots_of = F.from_json(F.lit(str(p.light)), "array<int>")  # folded to one constant, whatever its length
    light = F.array(F.element_at(slots_of, _bucket(_named(key), len(p.light)) + 1))
    if not p.heavy:
        return df.withColumn("_slots", light)
    known = F.broadcast(spark.createDataFrame([(k, v) for k, v in p.heavy.items()], f"_k {kind}, _h array<int>"))
    return df.join(known, _named(key) == F.col("_k"), "left").withColumn("_slots", F.coalesce("_h", light)).drop("_k", "_h")


def fragment(p: Plan, rows: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with ``_slot``, hash-partitioned on it: each row sits in the one shard that ``spread`` picks.

    Equal values of ``spread`` and key share a shard, so repeated rows meet.
    """
    d = _placed(p, rows, key, "string")
    pick = F.pmod(F.xxhash64(spread), F.size("_slots")).cast("int")
    return d.withColumn("_slot", F.get("_slots", pick)).drop("_slots").repartition(p.tasks, "_slot")


def replicate(p: Plan, side: DataFrame, key: str) -> DataFrame:
    """The matching side, copied to exactly those slots that hold rows of its key."""
    d = _placed(p, side, key, "string")
    return d.withColumn("_slot", F.explode(F.array_distinct("_slots"))).drop("_slots").repartition(p.tasks, "_slot")


def default_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sector_totals(warehouse: DataFrame, sectores: DataFrame, tasks: int | None = None, threshold: float = 0.05) -> DataFrame:
    """(sector_serio, nombre, filas, empleo_total, proporcion, dominante): one row per normalised sector.

    Null and blank sectors form the sector null, which counts in the total and
    is never dominant.  Employment that is null, negative or not finite adds 0.
    Repeated deliveries count once: the copies of a row have the same key and
    identifier, so they meet in one shard and are removed there, without a
    shuffle of their own.  Several catalogue rows of a sector give the smallest
    name; a sector without one has none.
    """
    tasks = tasks or default_tasks(warehouse)
    e = F.col("empleo_total")
    usable = e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")) & (e >= 0)
    rows = warehouse.select("fila_id", norm_code("sector_serio").alias("sector_serio"), F.when(usable, e).otherwise(0.0).alias("empleo"))
    loads = materialise(rows.groupBy("sector_serio").agg(F.count("*").alias("n")))
    p = plan(loads, "sector_serio", "n", tasks)
    left = fragment(p, rows, "sector_serio", "fila_id").select("_slot", "sector_serio", "fila_id", "empleo").distinct()
    names = sectores.groupBy(norm_code("scian").alias("_s")).agg(F.min("nombre").alias("nombre"))
    right = replicate(p, names, "_s").withColumnRenamed("_slot", "_slot2")
    joined = left.join(right, (F.col("_slot") == F.col("_slot2")) & (F.col("sector_serio") == F.col("_s")), "left")
    per_shard = joined.groupBy("_slot", "sector_serio", "nombre").agg(F.count("*").alias("filas"), F.sum("empleo").alias("empleo_total"))
    totals = materialise(per_shard.groupBy("sector_serio", "nombre").agg(F.sum("filas").alias("filas"), F.sum("empleo_total").alias("empleo_total")))
    n = totals.agg(F.sum("filas")).first()[0] or 1
    share = F.col("filas") / F.lit(n)
    return totals.select(
        "sector_serio",
        "nombre",
        "filas",
        "empleo_total",
        share.alias("proporcion"),
        (F.col("sector_serio").isNotNull() & (share >= threshold)).alias("dominante"),
    )


def dominant_sectors(warehouse: DataFrame, sectores: DataFrame, tasks: int | None = None, threshold: float = 0.05) -> DataFrame:
    return sector_totals(warehouse, sectores, tasks, threshold).filter("dominante").select("sector_serio")


