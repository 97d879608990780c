"""The queries of the spatial-economic operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.functions import geometry as G
from zonaria.functions.codes import norm_code
from zonaria.operators import allocate as al
from zonaria.operators import build, clusters, graph, ingest, leontief, propagate, results, score
from zonaria.operators import crosswalk as cw
from zonaria.operators import profiles as pf
from zonaria.operators import warehouse as wh
from zonaria.report import Report
from zonaria.session import materialise
from zonaria.sources.tables import deliveries, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sql_code(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(upper({c}), '^\s+|\s+$', '', 'g'), '\.0$', ''), '')"


# ---- shared inputs -------------------------------------------------------

# A table of rules at every level, drawn from the crosswalk in words both engines read.
_RULES = """
    select code, case length(code) when 2 then 'SECTOR' when 3 then 'SUBSECTOR' when 4 then 'RAMA' when 5 then 'SUBRAMA' else 'CLASE' end as level,
           title, sector, case when sector = '' and f % 2 = 0 then 'REVIEW_REQUIRED' when sector = '' then 'PENDING' else 'VERIFIED' end as status, evidence, case when sector = '' and f % 4 = 0 then 'AMBIGUOUS' else 'EXACT' end as mapping,
           'derivada' as justification, case when f % 5 = 0 then 'HIGH' when f % 5 < 3 then 'MEDIUM' else 'LOW' end as priority, title as notes
    from (select code, min(title) as title, case when min(f) % 7 = 0 then '' else min(sector) end as sector, case when min(f) % 9 = 0 then 'INFERRED' else 'OFFICIAL' end as evidence, min(f) as f
          from (select substring(trim(scian_codigo), 1, cast(2 + fila_id % 5 as int)) as code, coalesce(notas, '') as title, coalesce(trim(sector_serio), '') as sector, fila_id as f
                from crosswalk where length(trim(scian_codigo)) = 6) as a
          group by code) as b
"""

_E = "case when empleo_total is not null and not isnan(empleo_total) and not isinf(empleo_total) and empleo_total >= 0 then empleo_total end"
_W = f"""
    wr as (select distinct fila_id, cvegeo, {_sql_code('sector_serio')} as sector_serio, n_establecimientos as n, {_E} as e,
                  case when n_empleo_faltante between 0 and n_establecimientos then n_empleo_faltante end as m
           from warehouse where cvegeo is not null),
    agg as (select cvegeo, sector_serio, cast(coalesce(sum(n), 0) as bigint) as n_establecimientos, coalesce(sum(e), 0.0) as empleo_total, cast(coalesce(sum(m), 0) as bigint) as n_empleo_faltante
            from wr where sector_serio is not null group by all),
    tot as (select sector_serio, sum(empleo_total) as te, sum(n_establecimientos) as tn from agg group by all),
    w as (select agg.*, case when te > 0 then empleo_total / te when tn > 0 then n_establecimientos / tn end as omega,
                 case when te > 0 then 'empleo' when tn > 0 then 'establecimientos' else 'sin_datos' end as omega_metodo
          from agg join tot using (sector_serio))
"""
_SHOCK = """shock as (select scian as sector, (indice + 1) * 1000.0 as delta_x from sectores
                      union all select 'SIN_PESO', 500.0)"""
_ZONES = "z as (select distinct cvegeo, geometry from ageb where geometry is not null)"
_EDGES = f"""{_ZONES},
    v as (select distinct cvegeo, p.x as x, p.y as y from (select cvegeo, unnest(flatten(flatten(geometry))) as p from z)),
    e as (select distinct a.cvegeo as src, b.cvegeo as dst from v a join v b using (x, y) where a.cvegeo <> b.cvegeo),
    nodes as (select distinct cvegeo as id from z)"""
_WS = "deg as (select src, count(*) as d from e group by all), ws as (select src, dst, 1.0 / d as w from e join deg using (src))"
_COMM = "comm as (select scian as sector, indice % 7 as cluster_id, nombre from sectores union all select null, 99, 'vacía')"
_PESO = """sw as (select cvegeo, sector_serio as sector, sum(case when ze > 0 then empleo_total else n_establecimientos end) as peso
                  from agg join (select cvegeo, sum(empleo_total) as ze from agg group by all) using (cvegeo) group by all),
    gr as (select cvegeo, cluster_id, sum(peso) as peso from sw join comm using (sector) group by all)"""
_UNI = f"""{_PESO},
    dc as (select cvegeo, cluster_id, peso as peso_cluster from gr qualify row_number() over (partition by cvegeo order by peso desc, cluster_id) = 1),
    ds as (select cvegeo, sector as sector_dominante, peso as sector_peso from sw qualify row_number() over (partition by cvegeo order by peso desc, sector) = 1),
    zt as (select cvegeo, sum(peso) as peso_total, count(distinct sector) as n_sectores from sw group by all),
    u0 as (select * from dc join ds using (cvegeo) join zt using (cvegeo)),
    u as (select *, peso_total * 100 / sum(peso_total) over () as participacion_pct, row_number() over (order by peso_total desc, cvegeo) as ranking,
                 case when length(cvegeo) >= 2 then substr(cvegeo, 1, 2) else '—' end as entidad, case when length(cvegeo) >= 5 then substr(cvegeo, 3, 3) else '—' end as municipio from u0)"""
_S = "s as (select id, coalesce(sv.s, 0) as s from nodes left join (select cvegeo, sum(omega * delta_x) as s from w join shock on shock.sector = w.sector_serio where omega is not null group by all) sv on sv.cvegeo = nodes.id)"


def _establishments(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "denue")
    return deliveries(raw, "fila_id", "id", "nom_estab", "codigo_act", "per_ocu", "latitud", "longitud")


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return results.one_geometry(table(spark, d, "ageb")).filter("geometry is not null")


def _sectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sectores").select(F.col("scian").alias("sector"))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "crosswalk").select("fila_id", "scian_codigo", "sector_serio", "notas").distinct()
    return cw.tag_flat(c, _sectors(spark, d))


def _authoring(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_RULES.replace("from crosswalk", "from {crosswalk}"), crosswalk=table(spark, d, "crosswalk"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return cw.check_rules(_authoring(spark, d))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalise_establishments(_establishments(spark, d)).select("scian")


def _located(spark: SparkSession, d: str) -> DataFrame:
    e = ingest.normalise_establishments(_establishments(spark, d))
    return cw.apply(wh.locate(e, _zones(spark, d)), cw.lookup(_flat(spark, d)))


def _omega(spark: SparkSession, d: str) -> DataFrame:
    return wh.weights(wh.condense(table(spark, d, "warehouse")))


def _shock(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sectores").select(F.col("scian").alias("sector"), ((F.col("indice") + 1) * 1000.0).alias("delta_x"))
    return ingest.shock_table(spark, s.union(spark.createDataFrame([("SIN_PESO", 500.0)], s.schema)))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    z = materialise(_zones(spark, d))
    return z.select(F.col("cvegeo").alias("id")), materialise(graph.vertex_edges(z))


def _vector(spark: SparkSession, d: str, nodes: DataFrame, omega: DataFrame | None = None) -> DataFrame:
    a = al.allocate(wh.omega_table(_omega(spark, d) if omega is None else omega), _shock(spark, d))
    v = al.shock_vector(a).select(F.col("cvegeo").alias("id"), "s")
    return propagate.align(nodes, v, strict=False)


def _communities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "sectores").select(F.col("scian").alias("sector"), (F.col("indice") % 7).alias("cluster_id"), "nombre")
    return c.union(spark.createDataFrame([(None, 99, "vacía")], "sector string, cluster_id int, nombre string"))


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(universe, community weights, communities)"""
    sw = materialise(pf.sector_weights(wh.condense(table(spark, d, "warehouse"))))
    c = _communities(spark, d)
    return pf.universe(sw, c.filter("sector is not null")), pf.community_weights(sw, c), c


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ---- ingest --------------------------------------------------------------


@query("""
    with d as (select distinct fila_id, id, codigo_act, latitud, longitud from denue),
    t as (select fila_id, latitud is not null and not isnan(latitud) as lat_presente, longitud is not null and not isnan(longitud) as lon_presente,
                 coalesce(latitud between 14 and 33, false) as lat_rango, coalesce(longitud between -119 and -86, false) as lon_rango,
                 coalesce(trim(codigo_act) <> '', false) as scian_presente, count(*) over (partition by id) = 1 as id_unico from d)
    select *, lat_presente and lon_presente and lat_rango and lon_rango and scian_presente and id_unico as valido from t""")
def ingest_tagging(spark, d):
    t = ingest.tag_establishments(_establishments(spark, d).drop("nom_estab", "per_ocu"))
    names = {"chk_lat_present": "lat_presente", "chk_lon_present": "lon_presente", "chk_lat_range": "lat_rango", "chk_lon_range": "lon_rango", "chk_scian_present": "scian_presente", "chk_id_unique": "id_unico", "_valid": "valido"}
    return t.select("fila_id", *(F.col(k).alias(v) for k, v in names.items()))


@query("""
    with r as (select cvegeo, actualizado_en, geometry, flatten(geometry) as rings, count(*) over (partition by cvegeo) as n from ageb)
    select cvegeo, geometry is not null as no_nula, geometry is not null and len(flatten(rings)) > 0 as no_vacia,
           geometry is not null and len(list_filter(rings, lambda g: len(g) < 4 or g[1] <> g[-1])) = 0 as valida, n = 1 as id_unico from r""")
def zone_tagging(spark, d):
    t = ingest.tag_zones(table(spark, d, "ageb"))
    return t.select("cvegeo", F.col("chk_not_null").alias("no_nula"), F.col("chk_not_empty").alias("no_vacia"), F.col("chk_is_valid").alias("valida"), F.col("chk_id_unique").alias("id_unico"))


_RINGS = f"""{_ZONES},
    p as (select cvegeo, generate_subscripts(geometry, 1) as i, unnest(geometry) as poly from z),
    r as (select cvegeo, i, generate_subscripts(poly, 1) as k, unnest(poly) as ring from p),
    ed as (select cvegeo, i, k, ring[1].x as ox, ring[1].y as oy, ring[j].x as x1, ring[j].y as y1, ring[j % len(ring) + 1].x as x2, ring[j % len(ring) + 1].y as y2
           from (select *, unnest(range(1, len(ring) + 1)) as j from r))"""


@query(f"""
    with {_RINGS},
    a as (select cvegeo, i, k, sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) / 2 as s, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) as l from ed group by all)
    select cvegeo, round(sum(abs(s) * case when k = 1 then 1 else -1 end) * 1e6, 6) as area, round(sum(l), 9) as perimetro from a group by all""")
def geo_measures(spark, d):
    return _zones(spark, d).select("cvegeo", F.round(G.area("geometry") * 1e6, 6).alias("area"), F.round(G.perimeter("geometry"), 9).alias("perimetro"))


def _conformal(lat: str) -> str:
    return f"tan(pi() / 4 - ({lat}) / 2) / pow((1 - e * sin({lat})) / (1 + e * sin({lat})), e / 2)"


def _scale(lat: str) -> str:
    return f"cos({lat}) / sqrt(1 - pow(e * sin({lat}), 2))"


# The grid from its definition: standard parallels 17.5 and 29.5, origin 12 N 102 W, false easting 2 500 000 m, GRS 80.
# The latitude of the centroid comes from fixed-point steps, not from the series the columns use.
_GRID = f"""{_RINGS},
    k0 as (select sqrt(f * (2 - f)) as e, radians(17.5) as p1, radians(29.5) as p2, radians(12.0) as p0 from (select 1 / 298.257222101 as f)),
    k1 as (select e, ln(({_scale('p1')}) / ({_scale('p2')})) / ln(({_conformal('p1')}) / ({_conformal('p2')})) as n, {_conformal('p1')} as t1, {_conformal('p0')} as t0, {_scale('p1')} as m1 from k0),
    k as (select e, n, 6378137.0 * m1 / (n * pow(t1, n)) as af, 6378137.0 * m1 / (n * pow(t1, n)) * pow(t0, n) as r0 from k1),
    q as (select cvegeo, i, k as anillo, j, ring[j].x as lon, radians(ring[j].y) as lat, len(ring) as largo from (select *, unnest(range(1, len(ring) + 1)) as j from r)),
    xy as (select cvegeo, i, anillo, j, largo, 2500000 + af * pow({_conformal('lat')}, n) * sin(n * (radians(lon) - radians(-102.0))) as x, r0 - af * pow({_conformal('lat')}, n) * cos(n * (radians(lon) - radians(-102.0))) as y from q, k),
    g as (select a.cvegeo, a.i, a.anillo, o.x as ox, o.y as oy, a.x - o.x as u1, a.y - o.y as v1, b.x - o.x as u2, b.y - o.y as v2
          from xy a join xy b on b.cvegeo = a.cvegeo and b.i = a.i and b.anillo = a.anillo and b.j = a.j % a.largo + 1 join xy o on o.cvegeo = a.cvegeo and o.i = a.i and o.anillo = a.anillo and o.j = 1),
    h as (select cvegeo, i, anillo, sum(u1 * v2 - u2 * v1) / 2 as s, sum((u1 + u2) * (u1 * v2 - u2 * v1)) / 6 + any_value(ox) * sum(u1 * v2 - u2 * v1) / 2 as mx, sum((v1 + v2) * (u1 * v2 - u2 * v1)) / 6 + any_value(oy) * sum(u1 * v2 - u2 * v1) / 2 as my,
                 sum(sqrt(pow(u2 - u1, 2) + pow(v2 - v1, 2))) as l from g group by all),
    t as (select cvegeo, sum(abs(s) * f) as area, sum(l) as perimetro, sum(mx * sign(s) * f) / sum(abs(s) * f) as cx, sum(my * sign(s) * f) / sum(abs(s) * f) as cy from (select *, case when anillo = 1 then 1 else -1 end as f from h) group by cvegeo),
    c0 as (select *, degrees(atan2(cx - 2500000, r0 - cy) / n) - 102 as lon, pow(sqrt(pow(cx - 2500000, 2) + pow(r0 - cy, 2)) / af, 1 / n) as tt, pi() / 2 - 2 * atan(pow(sqrt(pow(cx - 2500000, 2) + pow(r0 - cy, 2)) / af, 1 / n)) as phi from t, k),
    {', '.join(f"c{m} as (select * replace (pi() / 2 - 2 * atan(tt * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)) as phi) from c{m - 1})" for m in range(1, 9))}"""


@query(f"with {_GRID} select cvegeo, round(area / 100, 2) as area_ha100, round(perimetro, 3) as perimetro_m, round(lon, 7) as centro_lon, round(degrees(phi), 7) as centro_lat from c8")
def zones_normalised(spark, d):
    z = ingest.normalise_zones(_zones(spark, d))
    return z.select("cvegeo", F.round(F.col("area_m2") / 100, 2).alias("area_ha100"), F.round("perimeter_m", 3).alias("perimetro_m"), F.round("centroid_lon", 7).alias("centro_lon"), F.round("centroid_lat", 7).alias("centro_lat"))


@query("""
    with d as (select distinct fila_id, per_ocu from denue)
    select per_ocu, case trim(per_ocu) when '0 a 5 personas' then 2.5 when '6 a 10 personas' then 8.0 when '11 a 30 personas' then 20.5 when '31 a 50 personas' then 40.5
                    when '51 a 100 personas' then 75.5 when '101 a 250 personas' then 175.5 when '251 y más personas' then 300.0 end::double as empleo, count(*) as n from d group by all""")
def midpoint_map(spark, d):
    e = ingest.normalise_establishments(_establishments(spark, d))
    return e.groupBy("per_ocu", F.col("empleo_estimado").alias("empleo")).agg(F.count("*").alias("n"))


# ---- crosswalk -----------------------------------------------------------

_FLAT = """f0 as (select distinct fila_id, trim(scian_codigo) as c, trim(sector_serio) as s, notas from crosswalk),
    f as (select fila_id, c, s, c is not null as con_codigo, coalesce(regexp_full_match(c, '[0-9]{6}'), false) as seis, s is not null as con_sector,
                 coalesce(s in (select scian from sectores), false) as conocido, c is null or count(*) over (partition by c) = 1 as unico from f0),
    lk as (select c as scian, s as sector from f where con_codigo and seis and con_sector and conocido and unico)"""
_EST = f"est as (select distinct fila_id, id, {_sql_code('codigo_act')} as scian, per_ocu, longitud as x, latitud as y from denue)"


@query(f"with {_FLAT} select fila_id, con_codigo, seis, con_sector, conocido, unico, con_codigo and seis and con_sector and conocido and unico as valido from f")
def crosswalk_flat_validate(spark, d):
    f = _flat(spark, d)
    names = {"chk_code_present": "con_codigo", "chk_code_six_digits": "seis", "chk_sector_present": "con_sector", "chk_sector_known": "conocido", "chk_code_unique": "unico", "_valid": "valido"}
    return f.select("fila_id", *(F.col(k).alias(v) for k, v in names.items()))


@query(f"with {_FLAT}, {_EST} select id, est.scian, sector from est left join lk using (scian)")
def crosswalk_apply(spark, d):
    return cw.apply(ingest.normalise_establishments(_establishments(spark, d)), cw.lookup(_flat(spark, d))).select("id", "scian", "sector")


@query(f"with {_FLAT}, {_EST} select distinct est.scian from est anti join lk using (scian) where trim(est.scian) <> ''")
def crosswalk_unmapped(spark, d):
    return cw.unmapped(ingest.normalise_establishments(_establishments(spark, d)), cw.lookup(_flat(spark, d)))


_AUTH = f"au as ({_RULES})"
_RES = f"""{_AUTH}, {_EST}, rules as (select length(code) as digits, code as prefix, sector from au where status = 'VERIFIED'),
    oc as (select distinct scian from est where trim(scian) <> ''),
    hit as (select scian, digits, prefix, sector from oc join rules on substr(scian, 1, digits) = prefix where regexp_full_match(scian, '[0-9]{{6}}')
            qualify row_number() over (partition by scian order by digits desc) = 1),
    res as (select oc.scian, case digits when 2 then 'SECTOR' when 3 then 'SUBSECTOR' when 4 then 'RAMA' when 5 then 'SUBRAMA' when 6 then 'CLASE' end as nivel, prefix as prefijo, sector from oc left join hit using (scian))"""


@query(f"""with {_AUTH}, t as (select *, regexp_full_match(code, '[0-9]+') as numerico, sector in (select scian from sectores) as conocido from au)
    select code, numerico, true as longitud, true as unico, conocido or sector = '' as sector_valido,
           case when status = 'VERIFIED' then sector <> '' and evidence <> 'INFERRED' else sector = '' end as estado from t""")
def authoring_validate(spark, d):
    t = cw.tag_authoring(_authoring(spark, d), _sectors(spark, d))
    return t.select("code", F.col("chk_numeric").alias("numerico"), F.col("chk_length").alias("longitud"), F.col("chk_unique").alias("unico"), F.col("chk_sector").alias("sector_valido"), F.col("chk_state").alias("estado"))


@query(f"with {_AUTH} select lower(trim(title)) as titulo, count(distinct sector) as sectores from au where trim(title) <> '' and sector <> '' group by all having count(distinct sector) > 1")
def crosswalk_shared_titles(spark, d):
    return cw.shared_titles(_authoring(spark, d))


@query(f"with {_RES} select * from res")
def crosswalk_resolve(spark, d):
    return cw.resolve(_codes(spark, d), _rules(spark, d))


@query(f"with {_RES} select scian as scian_codigo, sector as sector_serio, 'nivel ' || nivel || ' ' || prefijo as notas from res where sector is not null")
def crosswalk_compile(spark, d):
    return cw.compile_flat(_codes(spark, d), _rules(spark, d))


@query(f"""with {_RES} select scian as code, 'CLASE' as level, '' as sector, 'PENDING' as status, case when res.sector is not null then 'INFERRED' else '' end as evidence, 'MEDIUM' as priority, coalesce(res.sector, '') as notes
    from res where regexp_full_match(scian, '[0-9]{{6}}') and scian not in (select code from au where level = 'CLASE')""")
def crosswalk_suggest(spark, d):
    return cw.suggest(_codes(spark, d), _authoring(spark, d), _rules(spark, d))


@query(f"""with {_RES}, cat as (select distinct trim(scian_codigo) as scian from scian where trim(scian_codigo) <> ''),
    a as (select count(*) as catalogo, count(*) filter (scian in (select code from au where level = 'CLASE' and status = 'VERIFIED')) as catalogo_cubierto from cat),
    b as (select count(*) as observados, count(sector) as observados_resueltos from res),
    c as (select count(*) as clases, count(*) filter (status = 'VERIFIED') as n_verified, count(*) filter (status = 'REVIEW_REQUIRED') as n_review_required, count(*) filter (status = 'OUT_OF_SCOPE') as n_out_of_scope, count(*) filter (status = 'PENDING') as n_pending from au where level = 'CLASE')
    select *, round(catalogo_cubierto * 100.0 / catalogo, 2)::double as coverage_catalog_pct, round(observados_resueltos * 100.0 / observados, 2)::double as coverage_denue_pct, round(n_verified * 100.0 / clases, 2)::double as verified_pct from a, b, c""")
def crosswalk_coverage(spark, d):
    cat = table(spark, d, "scian").select(F.col("scian_codigo").alias("scian"))
    return cw.coverage(_authoring(spark, d), cat, _codes(spark, d), _rules(spark, d))


_CLASS = "cl as (select * from au where level = 'CLASE')"


@query(f"with {_AUTH}, {_CLASS} select priority, count(code) as n, round(coalesce(count(*) filter (status = 'VERIFIED') * 100.0 / nullif(count(code), 0), 0), 2)::double as verified_pct from (select unnest(['HIGH', 'MEDIUM', 'LOW']) as priority) left join cl using (priority) group by all")
def crosswalk_priorities(spark, d):
    return cw.by_priority(_authoring(spark, d))


@query(f"with {_AUTH}, {_CLASS} select sector, count(*) as n from cl where status = 'VERIFIED' group by all")
def crosswalk_by_sector(spark, d):
    return cw.by_sector(_authoring(spark, d))


@query(f"with {_AUTH}, {_CLASS} select code, title, priority, notes from cl where status = 'REVIEW_REQUIRED'")
def crosswalk_review_queue(spark, d):
    return cw.review_queue(_authoring(spark, d))


@query(f"with {_RES} select scian from res where sector is null")
def crosswalk_unresolved(spark, d):
    return cw.unresolved(_codes(spark, d), _rules(spark, d))


@query(f"""with {_AUTH}, {_CLASS} select {', '.join(f"round(count(*) filter (status = '{s}') * 100.0 / count(*), 2)::double as {s.lower()}_pct" for s in ("VERIFIED", *cw.BLANK_STATES))}, round(count(*) filter (mapping = 'AMBIGUOUS') * 100.0 / count(*), 2)::double as ambiguous_pct from cl""")
def crosswalk_status_shares(spark, d):
    return cw.status_shares(_authoring(spark, d))


@query(f"with {_AUTH} select code as scian_codigo, level as scian_nivel, status, '2024.1' as scian_version, case when trim(notes) = '' then '' else notes end as notes from au")
def crosswalk_template(spark, d):
    a = _authoring(spark, d).withColumnsRenamed({"code": "scian_codigo", "level": "scian_nivel", "title": "scian_titulo", "sector": "serio_sector"})
    t = cw.authoring_template(a, {"crosswalk_version": "1", "scian_version": "2024.1", "serio_version": "1", "generated_by": "zonaria"})
    return t.select("scian_codigo", "scian_nivel", "status", "scian_version", F.when(F.trim("notes") == "", "").otherwise(F.col("notes")).alias("notes"))


# ---- location, aggregation, weights ---------------------------------------

_PIP = f"""{_RINGS}, {_EST}, {_FLAT},
    ei as (select cvegeo, i, cast(round(x1 * 1e6) as bigint) as x1, cast(round(y1 * 1e6) as bigint) as y1, cast(round(x2 * 1e6) as bigint) as x2, cast(round(y2 * 1e6) as bigint) as y2 from ed),
    bx as (select cvegeo, i, min(x1) as bx0, max(x1) as bx1, min(y1) as by0, max(y1) as by1 from ei group by all),
    pt as (select distinct x, y, cast(round(x * 1e6) as bigint) as px, cast(round(y * 1e6) as bigint) as py from est where x is not null and y is not null and isfinite(x) and isfinite(y)),
    cand as (select x, y, px, py, cvegeo, i from pt join bx on px between bx0 and bx1 and py between by0 and by1),
    t as (select x, y, cvegeo, i, count(*) filter ((y1 > py) <> (y2 > py) and ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) > 0) = (y2 > y1)) % 2 = 1
                 or bool_or((x2 - x1) * (py - y1) = (y2 - y1) * (px - x1) and px between least(x1, x2) and greatest(x1, x2) and py between least(y1, y2) and greatest(y1, y2)) as dentro
          from cand join ei using (cvegeo, i) group by x, y, cvegeo, i),
    h as (select x, y, count(distinct cvegeo) as n, min(cvegeo) as zona from t where dentro group by all),
    loc as (select fila_id, id, est.scian, per_ocu, case when n = 1 then zona end as cvegeo, case when n = 1 then 'matched' when n > 1 then 'ambiguous' else 'orphan' end as estado from est left join h using (x, y)),
    locs as (select loc.*, sector from loc left join lk using (scian)),
    pagg as (select cvegeo, sector as sector_serio, count(*) as n_establecimientos, coalesce(sum(em), 0) as empleo_total, count(*) filter (em is null) as n_empleo_faltante
             from (select *, case trim(per_ocu) when '0 a 5 personas' then 2.5 when '6 a 10 personas' then 8.0 when '11 a 30 personas' then 20.5 when '31 a 50 personas' then 40.5
                    when '51 a 100 personas' then 75.5 when '101 a 250 personas' then 175.5 when '251 y más personas' then 300.0 end::double as em from locs)
             where estado = 'matched' and sector is not null group by all),
    ptot as (select sector_serio, sum(empleo_total) as te, sum(n_establecimientos) as tn from pagg group by all),
    pw as (select pagg.*, case when te > 0 then empleo_total / te when tn > 0 then n_establecimientos / tn end as omega,
                  case when te > 0 then 'empleo' when tn > 0 then 'establecimientos' else 'sin_datos' end as omega_metodo from pagg join ptot using (sector_serio))"""


@query(f"with {_PIP} select id, cvegeo, estado from loc")
def pip_join(spark, d):
    e = ingest.normalise_establishments(_establishments(spark, d))
    return wh.locate(e, _zones(spark, d)).select("id", "cvegeo", F.col("_join_status").alias("estado"))


@query(f"with {_PIP} select count(*) as n_total, count(*) filter (estado = 'matched') as n_matched, count(*) filter (estado = 'orphan') as n_orphan, count(*) filter (estado = 'ambiguous') as n_ambiguous from loc")
def pip_status_counts(spark, d):
    return wh.join_report(_located(spark, d))


@query(f"with {_PIP} select * from pagg")
def agg_zone_sector(spark, d):
    return wh.aggregate(_located(spark, d))


@query(f"with {_PIP} select cvegeo, sector_serio, n_establecimientos, empleo_total, n_empleo_faltante, round(omega, 9) as omega, omega_metodo from pw")
def build_warehouse(spark, d):
    w = wh.weights(wh.aggregate(_located(spark, d)))
    return w.select("cvegeo", "sector_serio", "n_establecimientos", "empleo_total", "n_empleo_faltante", _r("omega", 9), "omega_metodo")


@query(f"with {_W} select cvegeo, sector_serio, n_establecimientos, empleo_total, n_empleo_faltante, round(omega, 9) as omega, omega_metodo from w")
def omega(spark, d):
    return _omega(spark, d).select("cvegeo", "sector_serio", "n_establecimientos", "empleo_total", "n_empleo_faltante", _r("omega", 9), "omega_metodo")


@query(f"""with {_W}, per as (select sector_serio, sum(omega) as s from w group by all), pr as (select cvegeo, sector_serio, count(*) as c from w group by all)
    select count(*) as n_filas, count(*) filter (omega is null) as omega_nula, count(*) filter (n_establecimientos <= 0 or empleo_total < 0) as n_invalidas,
           cast(sum(n_establecimientos) as bigint) as establecimientos, cast(sum(n_empleo_faltante) as bigint) as faltantes,
           (select count(*) from per where abs(s - 1) > 1e-6) as sectores_sin_suma_uno, (select count(*) from per) as n_sectores, (select count(*) from pr where c > 1) as pares_repetidos,
           round(1 - sum(n_empleo_faltante) / sum(n_establecimientos), 9) as cobertura_empleo from w""")
def integrity(spark, d):
    return wh.integrity(_omega(spark, d)).withColumn("cobertura_empleo", F.round("cobertura_empleo", 9))


@query(f"""with {_PIP}, k as (select count(*) filter (estado = 'matched') as ma, count(*) filter (estado = 'orphan') as o, count(*) filter (estado = 'ambiguous') as am, count(*) as t from loc),
    x as (select count(distinct sector_serio) as ns, sum(n_establecimientos) as n, count(*) filter (omega_metodo = 'sin_datos') as sd, count(*) filter (omega_metodo = 'empleo') as em, count(*) filter (omega_metodo = 'establecimientos') as es, count(*) filter (n_establecimientos <= 0 or empleo_total < 0) as inv from pw),
    y as (select count(*) as off from (select sector_serio from pw group by all having abs(sum(omega) - 1) > 1e-6))
    select case when inv > 0 or ma < n then 'CRITICAL' when ns < 78 or ma <> n or o > 0.1 * t or am > 0 or off > 0 or sd > 0 then 'WARNING' else 'OK' end as estado,
           cast((ns < 78)::int + (ma < n)::int + (ma > n)::int + (o > 0.1 * t)::int + (am > 0)::int + (inv > 0)::int + (off > 0)::int + (sd > 0)::int as bigint) as n_banderas, em as empleo, es as establecimientos, sd as sin_datos from k, x, y""")
def quality_audit(spark, d):
    loc = materialise(_located(spark, d).drop("nombre"))
    w = wh.weights(wh.aggregate(loc))
    r = wh.audit(w, Report.of("join", wh.join_report(loc)))
    m = r.values["metodos"]
    return spark.createDataFrame([(r.values["estado"], len(r.values["banderas"]), m["empleo"], m["establecimientos"], m["sin_datos"])], "estado string, n_banderas bigint, empleo bigint, establecimientos bigint, sin_datos bigint")


@query(f"with {_W} select sector_serio, cast(sum(n_establecimientos) as bigint) as n_establecimientos, sum(empleo_total) as empleo_total, bool_and(omega_metodo in ('establecimientos', 'sin_datos')) as sin_empleo from w group by all order by empleo_total desc, sector_serio limit 10")
def sector_ranking(spark, d):
    return wh.sector_totals(_omega(spark, d))


@query(f"with {_PIP} select zs.cvegeo, sector_serio, n_establecimientos, round(omega, 9) as omega, true as con_geometria from (select distinct cvegeo from z) zs left join pw on pw.cvegeo = zs.cvegeo")
def warehouse_zones(spark, d):
    """Every zone with its weights and geometry, built in one call."""
    w = build.warehouse(ingest.normalise_establishments(_establishments(spark, d)), table(spark, d, "ageb"), cw.lookup(_flat(spark, d)))
    z = w.with_zones(_zones(spark, d))
    return z.select("cvegeo", "sector_serio", "n_establecimientos", _r("omega", 9), F.col("geometry").isNotNull().alias("con_geometria"))


@query(f"with {_W}, {_ZONES} select distinct cvegeo from w where cvegeo not in (select cvegeo from z)")
def zones_without_geometry(spark, d):
    return wh.without_geometry(_omega(spark, d), _zones(spark, d))


@query(f"with {_W} select sector_serio as sector, count(omega) as zonas, count(*) filter (omega is null) as sin_omega, round(coalesce(sum(omega), 0), 9) as suma_omega from w group by all")
def omega_by_sector(spark, d):
    return wh.omega_views(wh.omega_table(_omega(spark, d))).withColumn("suma_omega", F.round("suma_omega", 9))


@query(f"with {_W} select cvegeo as id, round(coalesce(sum(omega), 0), 9) as s from w group by all")
def observed_weight(spark, d):
    return pf.observed_weight(_omega(spark, d)).withColumn("s", F.round("s", 9))


# ---- shocks ---------------------------------------------------------------


@query(f"with {_W}, {_SHOCK} select cvegeo, sector, round(omega, 9) as omega, omega_metodo, delta_x as shock_sectorial, round(omega * delta_x, 6) as shock_ageb from w join shock on sector = sector_serio where omega is not null")
def allocate_shock(spark, d):
    return al.allocate(wh.omega_table(_omega(spark, d)), _shock(spark, d)).withColumns({"omega": F.round("omega", 9), "shock_ageb": F.round("shock_ageb", 6)})


@query(f"with {_W}, {_SHOCK} select sector from shock where sector not in (select sector_serio from w where omega is not null)")
def uncovered_sectors(spark, d):
    return al.uncovered(wh.omega_table(_omega(spark, d)), _shock(spark, d))


@query(f"""with {_W}, {_SHOCK}, p as (select sector_serio as sector, count(omega) as zonas, count(*) filter (omega is null) as zonas_excluidas, sum(omega) as suma_omega from w group by all)
    select sector, delta_x, zonas, zonas_excluidas, round(suma_omega, 9) as suma_omega, abs(suma_omega - 1) > 1e-6 as no_normalizado, round(suma_omega * delta_x, 6) as distribuido from shock join p using (sector) where zonas > 0""")
def allocation_report(spark, d):
    return al.allocation_report(wh.omega_table(_omega(spark, d)), _shock(spark, d)).withColumns({"suma_omega": F.round("suma_omega", 9), "distribuido": F.round("distribuido", 6)})


@query(f"with {_W}, {_SHOCK}, {_EDGES}, {_S} select id, round(s, 6) as s from s")
def shock_vector(spark, d):
    nodes, _ = _graph(spark, d)
    return _vector(spark, d, nodes).select("id", _r("s"))


@query(f"with {_W}, {_SHOCK}, {_ZONES} select w.cvegeo, sector, round(omega * delta_x, 6) as shock_ageb, z.cvegeo is not null as con_geometria from w join shock on sector = sector_serio left join z on z.cvegeo = w.cvegeo where omega is not null")
def shock_zones(spark, d):
    a = results.with_geometry(al.allocate(wh.omega_table(_omega(spark, d)), _shock(spark, d)), _zones(spark, d))
    return a.select("cvegeo", "sector", F.round("shock_ageb", 6).alias("shock_ageb"), F.col("geometry").isNotNull().alias("con_geometria"))


# ---- graph ----------------------------------------------------------------


# Micro-degrees, doubled so that midpoints of edges are integers too; all signs are exact.
_TOUCH = f"""{_RINGS},
    ei as (select cvegeo, cast(round(x1 * 1e6) as bigint) * 2 as x1, cast(round(y1 * 1e6) as bigint) * 2 as y1, cast(round(x2 * 1e6) as bigint) * 2 as x2, cast(round(y2 * 1e6) as bigint) * 2 as y2 from ed where x1 <> x2 or y1 <> y2),
    zb as (select cvegeo, min(x1) as bx0, max(x1) as bx1, min(y1) as by0, max(y1) as by1 from ei group by all),
    pr as (select a.cvegeo as a, b.cvegeo as b from zb a join zb b on a.cvegeo < b.cvegeo and a.bx0 <= b.bx1 and b.bx0 <= a.bx1 and a.by0 <= b.by1 and b.by0 <= a.by1),
    sg as (select pr.a, pr.b, sign((e.x2 - e.x1) * (f.y1 - e.y1) - (e.y2 - e.y1) * (f.x1 - e.x1)) as s1, sign((e.x2 - e.x1) * (f.y2 - e.y1) - (e.y2 - e.y1) * (f.x2 - e.x1)) as s2,
                  sign((f.x2 - f.x1) * (e.y1 - f.y1) - (f.y2 - f.y1) * (e.x1 - f.x1)) as s3, sign((f.x2 - f.x1) * (e.y2 - f.y1) - (f.y2 - f.y1) * (e.x2 - f.x1)) as s4,
                  greatest(least(greatest(e.x1, e.x2), greatest(f.x1, f.x2)) - greatest(least(e.x1, e.x2), least(f.x1, f.x2)), least(greatest(e.y1, e.y2), greatest(f.y1, f.y2)) - greatest(least(e.y1, e.y2), least(f.y1, f.y2))) as tramo
           from pr join ei e on e.cvegeo = a join ei f on f.cvegeo = b
           where greatest(e.x1, e.x2) >= least(f.x1, f.x2) and greatest(f.x1, f.x2) >= least(e.x1, e.x2) and greatest(e.y1, e.y2) >= least(f.y1, f.y2) and greatest(f.y1, f.y2) >= least(e.y1, e.y2)),
    st as (select a, b, bool_or(s1 * s2 < 0 and s3 * s4 < 0) as cruza, bool_or(s1 * s2 <= 0 and s3 * s4 <= 0) as toca, bool_or(s1 = 0 and s2 = 0 and s3 = 0 and s4 = 0 and tramo > 0) as comun from sg group by all),
    dir as (select a as own, b as other from pr union all select b, a from pr),
    tp as (select own, other, unnest([x1, (x1 + x2) // 2]) as x, unnest([y1, (y1 + y2) // 2]) as y from dir join ei on cvegeo = own),
    ins as (select own, other, x, y, count(*) filter ((y1 > y) <> (y2 > y) and ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0) = (y2 > y1)) % 2 = 1 as impar,
                   bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)) as borde from (select distinct * from tp) join ei on cvegeo = other group by own, other, x, y),
    sol as (select distinct least(own, other) as a, greatest(own, other) as b from ins where impar and not borde),
    par as (select a, b, comun from st anti join sol using (a, b) where toca and not cruza)"""


@query(f"with {_TOUCH} select a as src, b as dst from par union all select b, a from par")
def contiguity_queen(spark, d):
    return graph.contiguity(_zones(spark, d), "queen")


@query(f"with {_TOUCH} select a as src, b as dst from par where comun union all select b, a from par where comun")
def contiguity_rook(spark, d):
    return graph.contiguity(_zones(spark, d), "rook")


@query(f"with {_EDGES} select * from e")
def contiguity_vertices(spark, d):
    return graph.vertex_edges(_zones(spark, d))


@query(f"with {_EDGES}, {_WS} select src, dst, round(w, 9) as w from ws")
def row_standardise(spark, d):
    return graph.row_standardise(graph.vertex_edges(_zones(spark, d))).withColumn("w", F.round("w", 9))


@query(f"with {_EDGES}, {_WS}, g as (select id, coalesce(d, 0) as g from nodes left join deg on src = id) select count(*) as nodos, cast(sum(g) / 2 as bigint) as aristas, count(*) filter (g = 0) as islas, round(avg(g), 9) as grado_medio, min(g) as grado_min, max(g) as grado_max from g")
def graph_stats(spark, d):
    n, e = _graph(spark, d)
    return graph.graph_stats(n, e).withColumn("grado_medio", F.round("grado_medio", 9))


@query(f"with {_EDGES} select id from nodes anti join (select * from e where substr(src, 1, 9) = substr(dst, 1, 9)) on src = id")
def graph_islands(spark, d):
    """Zones without a neighbour in their own locality."""
    nodes, e = _graph(spark, d)
    return graph.islands(nodes, e.filter(F.substring("src", 1, 9) == F.substring("dst", 1, 9)))


@query(f"with {_EDGES}, {_WS}, uno as (select min(id) as id from nodes) select nodes.id, round(coalesce(w, 0), 9) as w from nodes left join (select dst, w from ws where src = (select id from uno)) on dst = nodes.id")
def matrix_row(spark, d):
    """The row of the first zone."""
    nodes, e = _graph(spark, d)
    m = graph.Matrix(nodes, graph.row_standardise(e))
    return m.row(nodes.agg(F.min("id")).first()[0]).withColumn("w", F.round("w", 9))


@query(f"""with {_RINGS}, g as (select cvegeo, i, k, sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) / 2 as s, sum((x1 + x2 - 2 * ox) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / 6 + any_value(ox) * sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) / 2 as mx,
              sum((y1 + y2 - 2 * oy) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / 6 + any_value(oy) * sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) / 2 as my from ed group by all)
    select round(sum(mx * sign(s) * f) / sum(abs(s) * f), 6) as x, round(sum(my * sign(s) * f) / sum(abs(s) * f), 6) as y from (select *, case when k = 1 then 1 else -1 end as f from g)""")
def map_centre(spark, d):
    return results.map_centre(_zones(spark, d)).select(_r("x"), _r("y"))


# ---- propagation ----------------------------------------------------------


def _neumann_sql(rho: str, terms: int) -> str:
    return f"""with recursive {_W}, {_SHOCK}, {_EDGES}, {_WS}, {_S},
    it(k, id, v) as (select 0, id, s::double from s union all
        select it.k + 1, src, sum(w * v) * {rho} from it join ws on dst = it.id where it.k < {terms} group by it.k, src),
    y as (select id, sum(v) as y from it group by all)"""


@query(_neumann_sql("0.35", 20) + " select id, round(y, 6) as y from y")
def neumann_fixed_k(spark, d):
    nodes, e = _graph(spark, d)
    y, _, _ = propagate.neumann(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), 0.35, terms=20, fixed=True)
    return y.select("id", _r("y"))


@query(_neumann_sql("0.35", 40) + " select id, round(s, 6) as s, round(y, 6) as y, id not in (select src from e) as isla from y join s using (id)")
def propagate_exact(spark, d):
    nodes, e = _graph(spark, d)
    r = propagate.propagate(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), 0.35)
    return r.select("id", _r("s"), _r("y"), "isla")


@query(f"""with {_W}, {_SHOCK}, {_EDGES}, {_WS}, {_S}, dv as (select id, s - avg(s) over () as d from s)
    select round((select count(*) from dv) / (select sum(w) from ws) * (select sum(w * a.d * b.d) from ws join dv a on a.id = src join dv b on b.id = dst) / (select sum(d * d) from dv), 9) as i""")
def moran(spark, d):
    nodes, e = _graph(spark, d)
    s = materialise(_vector(spark, d, nodes))
    return propagate.morans_i(nodes, materialise(graph.row_standardise(e)), s.select("id", F.col("s").alias("v"))).select(_r("i", 9))


@query(f"""with recursive {_W}, {_SHOCK}, {_EDGES}, {_WS}, {_S}, rs as (select unnest([0.1, 0.35, 0.6])::double as rho),
    it(k, rho, id, v) as (select 0, rho, id, s::double from s, rs union all
        select it.k + 1, rho, src, sum(w * v) * rho from it join ws on dst = it.id where it.k < 70 group by it.k, rho, src)
    select rho, round((select sum(s) from s), 4) as suma_s, round(sum(v), 4) as suma_y, round(sum(v) / (select sum(s) from s), 6) as multiplicador from it group by rho""")
def rho_sweep_summary(spark, d):
    nodes, e = _graph(spark, d)
    t, _ = propagate.sweep(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), [0.1, 0.35, 0.6, 1.5])
    return t.select("rho", F.round("suma_S", 4).alias("suma_s"), F.round("suma_Y", 4).alias("suma_y"), _r("multiplicador"))


def _grid_sql(n: int, rhos: str) -> str:
    """Moran's I of the propagated pattern for each rho of a grid, from the terms W^k S."""
    return f"""
    g{n} as ({rhos}),
    y{n} as (select rho, id, sum(v * pow(rho, k)) as y from it, g{n} group by all),
    d{n} as (select rho, id, y - avg(y) over (partition by rho) as d from y{n}),
    i{n} as (select a.rho, (select count(*) from nodes) / (select sum(w) from ws) * sum(w * a.d * b.d) / any_value(q) as i from ws join d{n} a on a.id = src join d{n} b on b.id = dst and b.rho = a.rho join (select rho as r, sum(d * d) as q from d{n} group by all) on r = a.rho group by a.rho)"""


@query(f"""with recursive {_W}, {_SHOCK}, {_EDGES}, {_WS}, {_S},
    it(k, id, v) as (select 0, id, s::double from s union all select it.k + 1, src, sum(w * v) from it join ws on dst = it.id where it.k < 600 group by it.k, src),
    ob as (select id, coalesce(o, 0) as v from nodes left join (select cvegeo, sum(omega) as o from w group by all) on cvegeo = id), od as (select id, v - avg(v) over () as d from ob),
    ti as (select (select count(*) from od) / (select sum(w) from ws) * (select sum(w * a.d * b.d) from ws join od a on a.id = src join od b on b.id = dst) / (select sum(d * d) from od) as i),
    {_grid_sql(1, "select -0.95 + 1.9 / 14 * unnest(range(15))::double as rho")},
    b1 as (select i1.rho from i1, ti order by abs(i1.i - ti.i), rho limit 1),
    {_grid_sql(2, "select greatest(-0.95, rho - 1.9 / 14) + (least(0.95, rho + 1.9 / 14) - greatest(-0.95, rho - 1.9 / 14)) / 10 * unnest(range(11))::double as rho from b1")},
    al as (select 1 as malla, rho, i from i1 union all select 2, rho, i from i2)
    select round(al.rho, 6) as rho, round(ti.i, 6) as i_observado, round(al.i, 6) as i_modelo, (select count(*)::int from al) as n_rho_evaluados, true as convergio from al, ti order by abs(al.i - ti.i), malla, al.rho limit 1""")
def rho_calibration(spark, d):
    nodes, e = _graph(spark, d)
    o = materialise(_omega(spark, d))
    s = materialise(_vector(spark, d, nodes, o))
    seen = materialise(propagate.align(nodes, pf.observed_weight(o), strict=False).select("id", F.col("s").alias("v")))
    r = propagate.calibrate(nodes, materialise(graph.row_standardise(e)), s, seen)
    got = [round(r[c], 6) for c in ("rho", "i_observado", "i_modelo")]
    return spark.createDataFrame([(*got, r["n_rho_evaluados"], r["convergio"])], "rho double, i_observado double, i_modelo double, n_rho_evaluados int, convergio boolean")


@query(_neumann_sql("0.35", 40) + """ select count(*) filter (abs(y) > 0) as afectadas, round(avg(y), 6) as media, round(max(abs(y)), 6) as maximo,
    round((select sum(a) from (select abs(y) as a from y order by a desc limit 10)) / sum(abs(y)), 6) as parte_principal from y""")
def impact_figures(spark, d):
    nodes, e = _graph(spark, d)
    r = materialise(propagate.propagate(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), 0.35))
    return score.impact_figures(r).select("afectadas", _r("media"), _r("maximo"), _r("parte_principal"))


@query(_neumann_sql("0.35", 40) + ", r as (select id, round(abs(y), 6) as y from y) select id, y, rank() over (order by y desc) as lugar from r")
def rank_by_impact(spark, d):
    nodes, e = _graph(spark, d)
    r = propagate.propagate(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), 0.35)
    return score.competition_rank(r.select("id", F.round(F.abs("y"), 6).alias("y")), "y", "id")


@query(_neumann_sql("0.35", 40) + ", r as (select id, round(s, 6) as ya, round(y, 6) as yb from y join s using (id)) select id, ya, yb, round(yb - ya, 6) as diferencia from r order by abs(round(yb - ya, 6)) desc, id limit 10")
def scenario_compare(spark, d):
    nodes, e = _graph(spark, d)
    r = materialise(propagate.propagate(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), 0.35))
    c = score.compare_results(r.select("id", F.round("s", 6).alias("y")), r.select("id", F.round("y", 6).alias("y")))
    return c.withColumn("diferencia", F.round("diferencia", 6))


def _simulation(spark: SparkSession, d: str) -> DataFrame:
    nodes, e = _graph(spark, d)
    r = propagate.propagate(nodes, materialise(graph.row_standardise(e)), materialise(_vector(spark, d, nodes)), 0.35)
    return materialise(results.assembled(r, _zones(spark, d)))


_SIM = _neumann_sql("0.35", 40) + ", sim as (select id as cvegeo, s as directo, y - s as indirecto, y as propagado, id not in (select src from e) as isla from y join s using (id))"


@query(_SIM + " select cvegeo, round(directo, 6) as shock_directo, round(indirecto, 6) as impacto_indirecto, round(propagado, 6) as impacto_propagado, isla, true as con_geometria, round(abs(directo), 6) as intensidad, case when abs(directo) > 1 then round(abs(indirecto) / (abs(directo) + 1e-9), 6) end as decaimiento from sim")
def simulation_zones(spark, d):
    """The result with geometry and the figures of its map; the decay is shown where the direct shock is above 1."""
    r = results.propagation_layer(_simulation(spark, d))
    shown = F.when(F.col("intensidad") > 1, F.round("decaimiento", 6)).alias("decaimiento")
    return r.select("cvegeo", *(_r(c) for c in results.IMPACTS), "isla", F.col("geometry").isNotNull().alias("con_geometria"), _r("intensidad"), shown)


@query(_SIM + " select cvegeo, round(propagado * 100 / sum(propagado) over (), 6) as participacion_pct, substr(cvegeo, 1, 2) as entidad, substr(cvegeo, 3, 3) as municipio from sim")
def simulation_map(spark, d):
    return results.map_table(_simulation(spark, d)).select("cvegeo", _r("participacion_pct"), "entidad", "municipio")


@query(_SIM.replace(f"with recursive {_W}", f"with recursive {_W}, {_COMM}, {_UNI}") + " select cluster_id, round(sum(directo), 4) as shock_directo, round(sum(indirecto), 4) as impacto_indirecto, round(sum(propagado), 4) as impacto_propagado from u join sim using (cvegeo) group by all")
def shock_by_community(spark, d):
    u, _, _ = _profiles(spark, d)
    return results.shock_by(u, _simulation(spark, d), "cluster_id").select("cluster_id", *(_r(c, 4) for c in results.IMPACTS))


@query(_SIM + """, b as (select cvegeo, round(propagado, 6) as impacto from sim order by impacto desc, cvegeo limit 10) select cvegeo, impacto, round(impacto / (select max(abs(impacto)) from b), 6) as barra from b""")
def impact_bars(spark, d):
    r = _simulation(spark, d).select("cvegeo", F.round("impacto_propagado", 6).alias("impacto"))
    return results.bars(r, "impacto", "cvegeo").withColumn("barra", F.round("barra", 6))


# ---- input-output ---------------------------------------------------------

_IO = f"""{_W}, fl as (select substr(a.cvegeo, 1, 2) as state, a.sector_serio as i, b.sector_serio as j, sum(a.n_establecimientos * b.n_establecimientos)::double as z from agg a join agg b using (cvegeo) group by all),
    co as (select state, i, j, z / sum(z) over (partition by state, j) * 0.5 as a from fl),
    vec as (select substr(cvegeo, 1, 2) as state, sector_serio as sector, sum(empleo_total) as x, case when sum(empleo_total) > 0 then 0.4 else 0.0 end as v,
                   case when sum(empleo_total) > 0 then sum(n_establecimientos)::double / sum(empleo_total) else 0.0 end as e from agg group by all)"""


def _flows(w: DataFrame, state: Column) -> DataFrame:
    """(state, i, j, z) from the condensed warehouse."""
    a = w.select("cvegeo", F.col("sector_serio").alias("i"), F.col("n_establecimientos").alias("ni"))
    b = w.select("cvegeo", F.col("sector_serio").alias("j"), F.col("n_establecimientos").alias("nj"))
    return a.join(b, "cvegeo").groupBy(state.alias("state"), "i", "j").agg(F.sum(F.col("ni") * F.col("nj")).cast("double").alias("z"))


def _io(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(A, L, vectors): sectors that share zones buy from each other; a state is an entity."""
    w = materialise(wh.condense(table(spark, d, "warehouse")))
    flows = _flows(w, F.substring("cvegeo", 1, 2))
    coef = materialise(leontief.coefficients(flows, 0.5))
    x, n = F.sum("empleo_total"), F.sum("n_establecimientos")
    vec = w.groupBy(F.substring("cvegeo", 1, 2).alias("state"), F.col("sector_serio").alias("sector")).agg(x.alias("x"), F.when(x > 0, 0.4).otherwise(0.0).alias("v"), F.when(x > 0, n / x).otherwise(0.0).alias("e"))
    return coef, materialise(leontief.inverse(coef)), vec


def _demand(vec: DataFrame, sectors: list[str]) -> DataFrame:
    return vec.filter(F.col("sector").isin(sectors)).select(F.lit(0).alias("escenario"), "state", "sector", F.lit(5e6).alias("monto"))


def _dx_sql(sectors: str) -> str:
    return f"""with recursive {_IO}, d0 as (select state, sector, 5.0::double as m from vec where sector in ({sectors})),
    it(k, state, sector, v) as (select 0, state, sector, m from d0 union all
        select it.k + 1, it.state, co.i, sum(co.a * it.v) from it join co on co.state = it.state and co.j = it.sector where it.k < 45 group by it.k, it.state, co.i),
    dx as (select state, sector, sum(v) as dx from it group by all)"""


def _detail(spark: SparkSession, d: str, sectors: list[str]) -> DataFrame:
    _, m, vec = _io(spark, d)
    r = leontief.shock(m, _demand(vec, sectors), vec)
    return r.select("state", "sector", _r("delta_X"), F.round("delta_X_pesos", 0).alias("delta_X_pesos"), _r("delta_VA"), _r("delta_E"), F.round("variacion_pct", 4).alias("variacion_pct"), _r("share_produccion"), "es_origen_shock")


def _detail_sql(sectors: str) -> str:
    return _dx_sql(sectors) + f""" select state, sector, round(dx, 6) as delta_X, round(dx / 1e-6, 0) as delta_X_pesos, round(dx * v, 6) as delta_VA, round(dx * e, 6) as delta_E, round(case when x > 1e-6 then dx / x * 100 end, 4) as variacion_pct,
        round(dx / sum(dx) over (partition by state), 6) as share_produccion, sector in ({sectors}) as es_origen_shock from dx join vec using (state, sector)"""


@query(_detail_sql("'SEC005'"))
def leontief_shock(spark, d):
    return _detail(spark, d, ["SEC005"])


@query(_dx_sql("'SEC005'") + """ select state, sector, row_number() over (partition by state order by round(abs(dx / 1e-6), 3) desc, indice nulls last, sector) as lugar, n.nombre from dx join vec using (state, sector) left join (select scian as sector, min(indice) as indice, min(nombre) as nombre from sectores group by all) n using (sector)
    qualify lugar <= 15""")
def leontief_largest(spark, d):
    """The 15 largest changes of a shock in every state."""
    _, m, vec = _io(spark, d)
    names = table(spark, d, "sectores").groupBy(F.col("scian").alias("sector")).agg(F.min("indice").alias("indice"), F.min("nombre").alias("nombre"))
    r = leontief.by_size(leontief.shock(m, _demand(vec, ["SEC005"]), vec), names)
    return r.filter("lugar <= 15").select("state", "sector", "lugar", "nombre")


@query(_detail_sql("'SEC005', 'SEC043'"))
def leontief_multi(spark, d):
    return _detail(spark, d, ["SEC005", "SEC043"])


@query(_dx_sql("'SEC005'") + """ select state, round(sum(dx), 6) as delta_X, round(sum(dx * v), 6) as delta_VA, round(sum(dx * e), 6) as delta_E, round(sum(dx) / 5, 6) as mult_produccion, round(sum(dx * v) / 5, 6) as mult_valor, round(sum(dx * e) / 5, 6) as mult_empleo
    from dx join vec using (state, sector) where state in (select state from vec where sector = 'SEC005' and v > 0) group by all""")
def compare_states(spark, d):
    _, m, vec = _io(spark, d)
    return leontief.compare_states(m, vec, "SEC005", 5e6).select("state", *(_r(c) for c in ("delta_X", "delta_VA", "delta_E", "mult_produccion", "mult_valor", "mult_empleo")))


@query(f"""with recursive {_IO}, it(k, state, sector, v) as (select 0, state, sector, 1.0::double from vec union all
        select it.k + 1, it.state, co.j, sum(co.a * it.v) from it join co on co.state = it.state and co.i = it.sector where it.k < 45 group by it.k, it.state, co.j),
    ms as (select state, sector, round(sum(v), 9) as m from it group by all)
    select state, sector, round(m, 6) as multiplicador from ms join vec using (state, sector) where v > 0 qualify row_number() over (partition by state order by m desc, sector) <= 10""")
def top_multipliers(spark, d):
    _, m, vec = _io(spark, d)
    return leontief.top_multipliers(m, vec).select("state", "sector", _r("multiplicador"))


@query(f"with {_IO} select state, j, round(least(1.0, greatest(0.0, 1 - sum(a))), 9) as v_n from co group by all")
def value_added(spark, d):
    return leontief.value_added(_io(spark, d)[0]).withColumn("v_n", F.round("v_n", 9))


@query(f"with {_IO} select state, sum(x) as suma_X, round(sum(v * x), 6) as suma_VA, round(sum(e * x), 6) as suma_E, count(*) filter (v > 0) as activos from vec group by all")
def state_summary(spark, d):
    return leontief.state_summary(_io(spark, d)[2]).withColumns({"suma_VA": F.round("suma_VA", 6), "suma_E": F.round("suma_E", 6)})


@query()
def sector_communities(spark, d):
    """Partition of the sectors by the national matrix, the flows of all states; tested by modularity and partition properties, as labels are no part of the result."""
    flows = _flows(materialise(wh.condense(table(spark, d, "warehouse"))), F.lit("nacional"))
    m = materialise(leontief.inverse(leontief.coefficients(flows, 0.5)))
    sim = materialise(clusters.largest_component(materialise(clusters.similarity(m.select("i", "j", "l")))))
    names = table(spark, d, "sectores").select(F.col("scian").alias("sector"), "nombre")
    return clusters.communities(spark, sim, leontief.linkages(m).drop("state"), names)


# ---- profiles -------------------------------------------------------------

_P = f"with {_W}, {_COMM}, {_UNI}"


@query(f"with {_W}, {_COMM}, {_PESO} select * from sw")
def zone_sector_weight(spark, d):
    return pf.sector_weights(wh.condense(table(spark, d, "warehouse")))


@query(f"with {_W}, {_COMM}, {_PESO} select * from gr")
def zone_community_weight(spark, d):
    return _profiles(spark, d)[1]


@query(_P + " select cvegeo, cluster_id, peso_cluster, sector_dominante, sector_peso, peso_total, n_sectores, round(participacion_pct, 9) as participacion_pct, ranking, entidad, municipio from u")
def zone_universe(spark, d):
    return _profiles(spark, d)[0].withColumn("participacion_pct", F.round("participacion_pct", 9))


@query(_P + " select cluster_id, sum(peso) as peso_granular from gr group by all")
def granular_community(spark, d):
    return _profiles(spark, d)[1].groupBy("cluster_id").agg(F.sum("peso").alias("peso_granular"))


@query(_P + """, r as (select *, row_number() over (partition by entidad, municipio order by peso_total desc, cvegeo) as k from u)
    select entidad, municipio, count(*) as n_agebs, array_to_string(list_sort(list(distinct sector_dominante)), ',') as sectores, array_to_string(list_sort(list(distinct cluster_id)), ',') as comunidades, sum(peso_total) as peso_total,
           round(sum(participacion_pct), 6) as participacion_pct, round(avg(peso_total), 6) as peso_medio, string_agg(cvegeo, ',' order by k) filter (k <= 5) as agebs_principales from r group by all""")
def municipality_profile(spark, d):
    m = pf.municipality_profiles(_profiles(spark, d)[0])
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("sectores", "comunidades", "agebs_principales")}
    return m.withColumns(joined | {"participacion_pct": F.round("participacion_pct", 6), "peso_medio": F.round("peso_medio", 6)})


@query(_P + """, r as (select *, row_number() over (partition by cluster_id order by peso_total desc, cvegeo) as k from u),
    a as (select cluster_id, count(*) as n, sum(peso_total) as t, array_to_string(list_sort(list(distinct entidad || municipio)), ',') as ms, string_agg(cvegeo, ',' order by k) filter (k <= 5) as top from r group by all),
    g as (select cluster_id, sum(peso) as p from gr group by all), m as (select cluster_id, min(nombre) as nombre, count(sector) as n_sectores from comm group by all)
    select cluster_id, nombre, n_sectores, coalesce(n, 0) as n_agebs, coalesce(t, 0) as peso_total, coalesce(p, 0) as peso_granular, coalesce(ms, '') as municipios, coalesce(top, '') as agebs_principales from m left join a using (cluster_id) left join g using (cluster_id)""")
def community_profile(spark, d):
    u, g, c = _profiles(spark, d)
    return pf.community_profiles(u, g, c).withColumns({k: F.array_join(k, ",") for k in ("municipios", "agebs_principales")})


@query(_P + ", m as (select entidad, municipio, cluster_id, sum(peso_total) as peso from u group by all) select * from m qualify row_number() over (partition by entidad, municipio order by peso desc, cluster_id) = 1")
def municipality_dominant(spark, d):
    return pf.dominant_by_municipality(_profiles(spark, d)[0])


@query(_P + ", m as (select entidad, municipio, gr.cluster_id, sum(peso) as peso from gr join u using (cvegeo) group by all) select * from m qualify row_number() over (partition by entidad, municipio order by peso desc, cluster_id) = 1")
def municipality_dominant_granular(spark, d):
    u, g, _ = _profiles(spark, d)
    return pf.dominant_by_municipality(u, g)


@query(_P + f""", {_EDGES} select cvegeo as origen, 'ageb_municipio' as tipo, entidad || municipio as destino from u union all select cvegeo, 'ageb_comunidad', cluster_id::varchar from u
    union all select cvegeo, 'ageb_sector', sector_dominante from u union all select src, 'ageb_vecino', dst from e""")
def relations_edges(spark, d):
    return pf.relations(_profiles(spark, d)[0], _graph(spark, d)[1])


@query(_P + f""", {_EDGES}, n as (select src as cvegeo, array_to_string(list_sort(list(distinct dst)), ',') as a, array_to_string(list_sort(list(distinct entidad || municipio)), ',') as m, array_to_string(list_sort(list(distinct cluster_id)), ',') as c from e join u on u.cvegeo = dst group by all)
    select u.cvegeo, coalesce(a, '') as agebs_relacionadas, coalesce(m, '') as municipios_conectados, coalesce(c, '') as comunidades_conectadas from u left join n using (cvegeo)""")
def neighbour_enrichment(spark, d):
    n = pf.neighbour_context(_profiles(spark, d)[0], _graph(spark, d)[1])
    return n.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in n.columns[1:]})


@query(_P + """, k as (select entidad, municipio, count(*) as n_agebs from u group by all), m as (select entidad, municipio, gr.cluster_id, sum(peso) as peso from gr join u using (cvegeo) group by all),
    b as (select * from m qualify row_number() over (partition by entidad, municipio order by peso desc, cluster_id) = 1)
    select entidad, municipio, n_agebs, b.cluster_id as cluster_dominante, peso as peso_dominante, (select min(nombre) from comm where comm.cluster_id = b.cluster_id) as nombre_cluster from k left join b using (entidad, municipio)""")
def municipality_with_dominant(spark, d):
    u, g, c = _profiles(spark, d)
    m = results.with_dominant(pf.municipality_profiles(u), pf.dominant_by_municipality(u, g), c)
    return m.select("entidad", "municipio", "n_agebs", "cluster_dominante", "peso_dominante", "nombre_cluster")


@query(_P + f""", {_EDGES} select 'universe' as parte, count(*) as n from u union all select 'granular', count(*) from gr where cluster_id <> 99 union all select 'municipalities', count(*) from (select distinct entidad, municipio from u) union all select 'communities', count(distinct cluster_id) from comm
    union all select 'unmapped', count(*) from (select distinct sector from sw where sector not in (select sector from comm where sector is not null)) union all select 'relations', (select 3 * count(*) from u) + (select count(*) from e) union all select 'neighbours', count(*) from u""")
def decision_support(spark, d):
    """Rows of every table of the report, built in one call."""
    nodes, e = _graph(spark, d)
    return build.decision_support(wh.condense(table(spark, d, "warehouse")), _communities(spark, d), nodes, e).counts()


@query(_P + " select sector_dominante, count(*) as n_zonas from u group by all order by n_zonas desc, sector_dominante limit 10")
def top_dominant_sectors(spark, d):
    return results.most_frequent(_profiles(spark, d)[0], ["sector_dominante"], 10)


@query(_P + " select entidad, municipio, count(*) as n_zonas from u group by all order by n_zonas desc, entidad, municipio limit 12")
def top_municipalities(spark, d):
    return results.most_frequent(_profiles(spark, d)[0], ["entidad", "municipio"], 12)


@query(_P + " select cvegeo, peso_total from u order by peso_total desc, cvegeo limit 15")
def top_zones(spark, d):
    return results.largest(_profiles(spark, d)[0], "peso_total", "cvegeo").select("cvegeo", "peso_total")


@query(_P + ", q as (select quantile_cont(peso_total, 0.9) as p from u) select round(p, 6) as umbral, count(*) as n from u, q where peso_total >= p group by all")
def above_p90(spark, d):
    return results.above_percentile(_profiles(spark, d)[0], "peso_total").select(_r("umbral"), "n")


@query(_P + ", m as (select min(entidad || municipio) as m from u) select cvegeo from u, m where entidad || municipio = m and cluster_id in (0, 1, 2)")
def zones_selected(spark, d):
    u = _profiles(spark, d)[0]
    first = u.agg(F.min(F.concat("entidad", "municipio"))).first()[0]
    return results.select_zones(u, [first] if first else [], [0, 1, 2]).select("cvegeo")


# ---- scores, classes ------------------------------------------------------


@query(_P + ", c as (select *, sum(peso_total) over (order by ranking rows unbounded preceding) as acc from u) select min(ranking) as unidades from c where acc >= 0.8 * (select sum(peso_total) from u) * (1 - 1e-12)")
def concentration_80(spark, d):
    n = score.concentration(_profiles(spark, d)[0], "peso_total", "cvegeo")
    return spark.createDataFrame([(n,)], "unidades bigint")


@query(_P + ", ps as (select unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::double as p) select p, round((select quantile_cont(peso_total, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) from u)[list_position([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]::double[], p)], 6) as valor from ps")
def percentiles(spark, d):
    return score.percentiles(_profiles(spark, d)[0], "peso_total").withColumn("valor", F.round("valor", 6))


@query(_P + """, x as (select min(peso_total) as lo, (max(peso_total) - min(peso_total)) / 25 as w from u),
    b as (select least(25, cast(floor((peso_total - lo) / w) as int) + 1) as cubo, count(*) as n from u, x group by all)
    select k.cubo, round(lo + (k.cubo - 1) * w, 4) as desde, round(lo + k.cubo * w, 4) as hasta, coalesce(n, 0) as n from (select unnest(range(1, 26))::int as cubo) k, x left join b on b.cubo = k.cubo""")
def histogram(spark, d):
    return score.histogram(_profiles(spark, d)[0], "peso_total").withColumns({"desde": F.round("desde", 4), "hasta": F.round("hasta", 4)})


@query(_P + ", q as (select list_sort(list_distinct(quantile_cont(peso_total, [0, 1/7, 2/7, 3/7, 4/7, 5/7, 6/7, 1]))) as b from u) select cvegeo, cast(len(list_filter(b[2:len(b) - 1], lambda x: peso_total > x)) as int) as clase from u, q")
def quantile_classes(spark, d):
    return score.classify(_profiles(spark, d)[0], "peso_total").select("cvegeo", "clase")


@query(_P + ", x as (select min(peso_total) as lo, max(peso_total) as hi from u) select cvegeo, cast(len(list_filter(range(1, 7), lambda k: peso_total > lo + (hi - lo) * k / 7)) as int) as clase from u, x")
def equal_interval_classes(spark, d):
    return score.classify(_profiles(spark, d)[0], "peso_total", "equal_interval").select("cvegeo", "clase")


_HHI = "hh as (select cvegeo, sum(power(case when peso_total > 0 then gr.peso / peso_total else 0 end, 2)) as hhi from gr join zt using (cvegeo) group by all)"


@query(_P + f", {_HHI} select cvegeo, round(hhi, 9) as hhi from hh")
def hhi(spark, d):
    u, g, _ = _profiles(spark, d)
    return score.hhi(g, u).withColumn("hhi", F.round("hhi", 9))


def _mm(c: str) -> str:
    return f"case when max({c}) over () - min({c}) over () < 1e-12 then 0.5 else ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) end"


@query(_P + f""", {_HHI}, k as (select u.*, coalesce(hhi, 1.0) as h, (cluster_id + 1) / 10.0 as ce, n_sectores / (select count(distinct sector) from sw) as co from u left join hh using (cvegeo)),
    q as (select cvegeo, 0.3 * {_mm('peso_total')} + 0.15 * {_mm('participacion_pct')} + 0.2 * {_mm('ce')} + 0.15 * {_mm('(1 - h)')} + 0.1 * {_mm('h')} + 0.1 * {_mm('co')} as sc from k)
    select cvegeo, round(sc, 6) as score, case when sc >= 0.66 then 'High' when sc >= 0.33 then 'Medium' else 'Low' end as nivel from q""")
def opportunity_score(spark, d):
    u, g, c = _profiles(spark, d)
    central = c.select("cluster_id", ((F.col("cluster_id") + 1) / 10.0).alias("centralidad_media")).distinct()
    n = wh.condense(table(spark, d, "warehouse")).select("sector_serio").distinct().count()
    return score.opportunity(u, g, central, n).select("cvegeo", F.round("score", 6).alias("score"), "nivel")


@query(_P + " select 'sector' as tipo, cvegeo from u where contains(lower(sector_dominante), 'sec005') order by peso_total desc, cvegeo limit 1")
def search_resolve(spark, d):
    return score.search(_profiles(spark, d)[0], "sec005")


@query(_P + ", t as (select sector_dominante from u group by all order by count(*) desc, sector_dominante limit 12) select cvegeo, case when sector_dominante in (select * from t) then sector_dominante else 'Otros' end as grupo from u")
def top_bucket(spark, d):
    return score.top_bucket(_profiles(spark, d)[0], "sector_dominante").select("cvegeo", "grupo")
