"""The input-output model on disk: sectors, summary by state, national matrices and the arrays of every state."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.errors import ContractError, ScenarioConfigError, require

# The arrays of a state, by shape, and the state that is not named by its folder.
VECTORS = ("X", "Y", "v", "e", "VA_r", "PO_r")
MATRICES = ("L", "A", "FLQ")
NAMED = {"CDMX": "Ciudad de México"}


def state_name(key: str) -> str:
    """A folder's name as people read it."""
    return NAMED.get(key, key.replace("_", " ").title())


def state_name_column(c: str) -> Column:
    named: Column = F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))
    for k, v in NAMED.items():
        named = F.when(F.col(c) == k, v).otherwise(named)
    return named


@dataclass
class IoModel:
    """``sectors``: (indice, sector, nombre).  ``summary``: one row per state.  ``national``: (i, j, a).  Arrays of a state are read once."""

    spark: SparkSession
    folder: str
    codes: list[str]
    sectors: DataFrame
    summary: DataFrame
    states: list[str]
    national: DataFrame
    national_x: DataFrame
    _read: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def by_name(self) -> dict[str, str]:
        return {state_name(s): s for s in self.states}

    def state(self, key: str) -> tuple[DataFrame, DataFrame]:
        """(matrices (state, i, j, l, a, flq), vectors (state, sector, x, y, v, e, va_r, po_r)); unknown states raise."""
        if key not in self.states:
            raise ScenarioConfigError(f"unknown state {key}")
        if key not in self._read:
            n = len(self.codes)
            arrays = {k: np.load(f"{self.folder}/{key}/{k}.npy") for k in (*VECTORS, *MATRICES)}
            for k, a in arrays.items():
                if a.shape != ((n,) if k in VECTORS else (n, n)):
                    raise ContractError(f"{key}/{k}.npy has the shape {a.shape}")
            wide = pd.DataFrame({"state": key, "i": np.repeat(self.codes, n), "j": np.tile(self.codes, n)} | {k.lower(): arrays[k].ravel().astype(float) for k in MATRICES})
            long = pd.DataFrame({"state": key, "sector": self.codes} | {k.lower(): arrays[k].astype(float) for k in VECTORS})
            self._read[key] = self.spark.createDataFrame(wide), self.spark.createDataFrame(long)
        return self._read[key]

    def all_states(self) -> tuple[DataFrame, DataFrame]:
        """The arrays of every state in one pair of tables: a state more is a partition more."""
        parts = [self.state(s) for s in self.states]
        if not parts:
            raise ContractError("no state with an inverse")
        matrices, vectors = parts[0]
        for m, v in parts[1:]:
            matrices, vectors = matrices.unionByName(m), vectors.unionByName(v)
        return matrices, vectors

    def facts(self, key: str) -> dict:
        """Totals of a state and its mean multiplier, None where the summary has none."""
        _, v = self.state(key)
        f = v.agg(F.sum("x").alias("suma_X"), F.sum("va_r").alias("suma_VA"), F.sum("po_r").cast("bigint").alias("suma_PO"), F.count_if(F.col("va_r") > 0).alias("activos")).first().asDict()
        row = self.summary.filter(F.col("estado") == key).select("mult_promedio").first() if "mult_promedio" in self.summary.columns else None
        return f | {"mult_promedio": row[0] if row else None}


def read_model(spark: SparkSession, folder: str) -> IoModel:
    """The model under ``folder``; a state is a folder that has an inverse.  The national matrices are small and read whole."""
    root = Path(folder)
    meta = json.loads((root / "meta.json").read_text(encoding="utf-8"))
    codes, names = [str(s) for s in meta["sectores"]], meta["sector_names"]
    listed = spark.read.option("header", True).csv(f"{folder}/sectores.csv")
    require(listed, "scian", "nombre")
    summary = spark.read.option("multiLine", True).json(f"{folder}/resumen.json")
    require(summary, "estado")
    a, x, n = np.load(root / "A_nacional.npy"), np.load(root / "X_nacional.npy"), len(codes)
    if a.shape != (n, n) or x.shape != (n,):
        raise ContractError("the national arrays don't fit the sectors")
    sectors = spark.createDataFrame([(k, c, names.get(c)) for k, c in enumerate(codes)], "indice int, sector string, nombre string")
    national = spark.createDataFrame(pd.DataFrame({"state": "nacional", "i": np.repeat(codes, n), "j": np.tile(codes, n), "a": a.ravel().astype(float)}))
    states = sorted(d.name for d in root.iterdir() if (d / "L.npy").exists())
    return IoModel(spark, folder, codes, sectors, summary, states, national, spark.createDataFrame(pd.DataFrame({"sector": codes, "x": x.astype(float)})))


def read_sector_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((sector, nombre), (nombre, sector)): the sectors and the code of every name; of a repeated name the last code."""
    from zonaria.sources.files import read_contract

    d = read_contract(spark, path, ["scian", "nombre"]).select(F.trim("scian").alias("sector"), F.trim("nombre").alias("nombre"), F.monotonically_increasing_id().alias("_n"))
    return d.drop("_n"), d.groupBy("nombre").agg(F.max_by("sector", "_n").alias("sector"))
