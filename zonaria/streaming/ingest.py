"""Establishments as a stream: counts and employment per (zone, sector) kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zonaria.operators import crosswalk, warehouse
from zonaria.operators.ingest import normalise_establishments


def start(stream: DataFrame, zones: DataFrame, lookup: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Aggregates each micro-batch into ``folder``/lote=N.

    A batch that is run again after a failure replaces its own folder, so its
    rows count once.  Weights need the totals of all batches: see ``current``.
    """

    def batch(df: DataFrame, number: int) -> None:
        located = crosswalk.apply(warehouse.locate(normalise_establishments(df), zones), lookup)
        warehouse.aggregate(located).write.mode("overwrite").parquet(f"{folder}/lote={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted table over all batches so far."""
    parts = spark.read.parquet(folder)
    total = parts.groupBy("cvegeo", "sector_serio").agg(*(F.sum(c).alias(c) for c in ("n_establecimientos", "empleo_total", "n_empleo_faltante")))
    return warehouse.weights(total)
