"""Whole chains in one call: the weighted table from establishments, and the decision-support report from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonaria.operators import crosswalk as cw
from zonaria.operators import profiles as pf
from zonaria.operators import results
from zonaria.operators import warehouse as wh
from zonaria.report import Report
from zonaria.session import materialise


@dataclass(frozen=True)
class Warehouse:
    """``located``: establishments with zone and sector.  ``table``: weights per zone and sector.  Reports of the join and of integrity."""

    located: DataFrame
    table: DataFrame
    join_report: Report
    integrity_report: Report

    def with_zones(self, zones: DataFrame) -> DataFrame:
        """Every zone with its geometry and weights; zones without establishments have nulls."""
        return results.with_geometry(self.table, zones, "right")

    def audit(self, universe: int = 78) -> Report:
        return wh.audit(self.table, self.join_report, universe, n_filas=self.integrity_report.values["n_filas"])

    def write(self, folder: str, epsg: int = 6372) -> str:
        return wh.write(self.table, folder, epsg, join_report=self.join_report, integrity_report=self.integrity_report)


def warehouse(establishments: DataFrame, zones: DataFrame, lookup: DataFrame) -> Warehouse:
    """Points to zones, codes to sectors, sums, weights and both reports.

    ``establishments`` is normalised (id, scian, x, y, empleo_estimado),
    ``zones`` (cvegeo, geometry), ``lookup`` (scian, sector).
    """
    one = results.one_geometry(zones).filter(F.col("geometry").isNotNull())
    located = materialise(cw.apply(wh.locate(establishments, one), lookup))
    table = materialise(wh.weights(wh.aggregate(located)))
    join = Report.of("spatial_join", wh.join_report(located))
    checks = wh.integrity(table, located).first().asDict() | {"zonas_sin_geometria": wh.without_geometry(table, one).count()}
    return Warehouse(located, table, join, Report("integrity", checks))


@dataclass(frozen=True)
class DecisionSupport:
    """All tables of the report; ``unmapped`` are sectors without community, ``neighbours`` and ``relations`` None without a graph."""

    universe: DataFrame
    granular: DataFrame
    municipalities: DataFrame
    communities: DataFrame
    unmapped: DataFrame
    relations: DataFrame | None
    neighbours: DataFrame | None

    def counts(self) -> DataFrame:
        """(parte, n): rows of every table there is."""
        parts = {k: v for k, v in vars(self).items() if v is not None}
        out = None
        for k, v in parts.items():
            d = v.agg(F.count("*").alias("n")).select(F.lit(k).alias("parte"), "n")
            out = d if out is None else out.unionByName(d)
        return out

    def write(self, folder: str) -> None:
        for k, v in vars(self).items():
            if v is not None:
                v.write.mode("overwrite").parquet(f"{folder}/{k}.parquet")


def decision_support(table: DataFrame, communities: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, simulation: DataFrame | None = None) -> DecisionSupport:
    """Profiles of zones, municipalities and communities with their relations.

    ``table`` has weights per zone and sector, ``communities`` is (sector,
    cluster_id, nombre).  Without a graph there are no neighbours, without a
    simulation no impacts.
    """
    sectors = materialise(pf.sector_weights(table))
    mapped = communities.filter("sector is not null")
    u = pf.universe(sectors, mapped)
    granular = materialise(pf.community_weights(sectors, mapped))
    municipalities = pf.municipality_profiles(u, simulation=simulation)
    dominant = pf.dominant_by_municipality(u, granular)
    zones = u if simulation is None or nodes is None else pf.with_simulation(u, simulation, nodes)
    return DecisionSupport(
        zones,
        granular,
        results.with_dominant(municipalities, dominant, communities),
        pf.community_profiles(u, granular, communities),
        pf.unmapped_sectors(sectors, mapped),
        pf.relations(u, edges) if edges is not None else None,
        pf.neighbour_context(u, edges) if edges is not None else None,
    )
