"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def deliveries(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The rows of ``df`` on ``key`` and ``columns``, repeated deliveries counted once.

    A row that repeats the key is the same row delivered again, so equal values
    of the chosen columns are one row.  Rows without a key are the same row when
    all chosen columns agree.  Every column is a grouping key: a hash
    aggregation without buffers, spread over the cluster by the row's key.
    """
    return df.select(key, *columns).distinct()
