"""From a demand shock to propagated impacts, end to end; dossiers and lookups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaria.errors import ContractError
from zonaria.operators import allocate as al
from zonaria.operators import leontief, propagate
from zonaria.operators import warehouse as wh
from zonaria.operators.ingest import shock_from_detail
from zonaria.report import Report
from zonaria.session import materialise

METHODS = ("manual", "sensitivity", "morans_i_calibration")


@dataclass
class Model:
    """What a scenario needs; each part is read once and kept.

    ``weights`` is a weighted table, ``nodes`` (id) and ``edges`` (src, dst, w)
    the graph, ``l_matrix`` and ``vectors`` the input-output model by state.
    """

    weights: DataFrame
    nodes: DataFrame
    edges: DataFrame
    l_matrix: DataFrame
    vectors: DataFrame
    _kept: dict[str, DataFrame] = field(default_factory=dict)

    def omega(self) -> DataFrame:
        if "omega" not in self._kept:
            self._kept["omega"] = materialise(wh.omega_table(self.weights))
        return self._kept["omega"]

    def health(self) -> dict[str, bool]:
        return {k: getattr(self, k) is not None for k in ("weights", "nodes", "edges", "l_matrix", "vectors")}

    def catalog(self) -> dict[str, list[str]]:
        return {
            "estados": [r["state"] for r in self.vectors.select("state").distinct().orderBy("state").collect()],
            "sectores": [r["sector"] for r in self.vectors.select("sector").distinct().orderBy("sector").collect()],
        }


@dataclass(frozen=True)
class Result:
    detail: DataFrame
    zones: DataFrame
    report: Report


@dataclass(frozen=True)
class Scenario:
    """A demand of ``montos`` (sector -> amount) in one state, spread over zones and propagated with ``rho``."""

    state: str
    montos: Mapping[str, float]
    rho: float = 0.35

    def run(self, m: Model, strict: bool = False) -> Result:
        propagate.check_rho(self.rho)
        if not self.montos:
            raise ContractError("a scenario needs a sector")
        active = {s: leontief.check_sector(m.vectors, self.state, s) for s in self.montos}
        spark = m.weights.sparkSession
        demand = spark.createDataFrame([(0, self.state, s, float(a)) for s, a in self.montos.items()], "escenario int, state string, sector string, monto double")
        l_state = m.l_matrix.filter(F.col("state") == self.state)
        detail = materialise(leontief.shock(l_state, demand, m.vectors.filter(F.col("state") == self.state)))
        shock = shock_from_detail(detail.withColumnRenamed("sector", "scian"))
        omega = m.omega()
        vector = al.shock_vector(al.allocate(omega, shock)).select(F.col("cvegeo").alias("id"), "s")
        zones = materialise(propagate.propagate(m.nodes, m.edges, materialise(propagate.align(m.nodes, vector, strict)), self.rho))
        missing = [r["sector"] for r in al.uncovered(omega, shock).orderBy("sector").collect()]
        totals = leontief.shock_totals(detail, demand).drop("escenario").first().asDict()
        report = Report.of("scenario", propagate.propagation_report(zones, self.rho), sectores_sin_peso=missing, sectores_activos=active, **totals)
        return Result(detail, zones, report)


def compare(a: Result, b: Result) -> dict[str, Any]:
    """Differences b - a of the sums, multipliers (null as 0) and touched zones."""
    n = lambda r: r.zones.filter(F.abs("y") > 0).count()
    va, vb = a.report.values, b.report.values
    return {
        "delta_impacto": (vb["suma_Y"] or 0.0) - (va["suma_Y"] or 0.0),
        "delta_multiplicador": (vb["multiplicador"] or 0.0) - (va["multiplicador"] or 0.0),
        "delta_zonas": n(b) - n(a),
    }


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def artifact(path: str, version: str | None = None) -> dict[str, Any]:
    p = Path(path)
    there = p.is_file()
    return {"path": path, "available": there, "version": version, "sha256": hashlib.sha256(p.read_bytes()).hexdigest() if there else None}


def ranking(zones: DataFrame, top: int = 10) -> DataFrame:
    """(lugar, id, y): the largest |y|, ties by id."""
    if top < 1:
        raise ContractError("top must be 1 or more")
    best = zones.orderBy(F.desc(F.abs("y")), "id").limit(top)
    rows = [(k, r["id"], r["y"]) for k, r in enumerate(best.collect(), 1)]
    return zones.sparkSession.createDataFrame(rows, f"lugar int, id {dict(zones.dtypes)['id']}, y double")


def dossier(result: Result, artifacts: Mapping[str, str], method: str = "manual", top: int = 10, tolerance: float = 1e-12) -> dict[str, Any]:
    """A reproducible summary of a run; its id derives from artefacts, parameters and summary, not from the time."""
    if method not in METHODS:
        raise ContractError(f"unknown method {method}")
    z = result.zones
    cover = z.agg(
        F.count("*").alias("zonas"), F.count_if(F.abs("s") > tolerance).alias("con_shock"), F.count_if(F.abs("y") > tolerance).alias("con_impacto"), F.count_if("isla").alias("islas")
    ).first().asDict()
    files = {k: artifact(p) for k, p in artifacts.items()}
    summary = {k: result.report.values[k] for k in ("suma_S", "suma_Y", "multiplicador")}
    params = {"rho": result.report.values["rho"], "metodo": method}
    mark = fingerprint({"artifacts": files, "parameters": params, "summary": summary})
    best = [r.asDict() for r in ranking(z, top).collect()]
    return {"report_id": f"edu-{mark[:16]}", "fingerprint": mark, "artifacts": files, "parameters": params, "summary": summary, "coverage": cover, "ranking": best, "nota": propagate.NOTE if method == METHODS[2] else None}
