"""The queries of the general problems, p1, p2, p4, p5, p6 and p7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.operators import drift, orphans, profile, rejects, skew, spatial_join
from zonaria.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return profile.warehouse_findings(table(spark, folder, "warehouse"))


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    p = profile.warehouse_profile(table(spark, folder, "warehouse"))
    exact = [F.col(f"s{k}").cast("double").alias(f"s{k}") for k in (1, 2)]
    return p.select("lote", "columna", "filas", "nulos", "no_validos", "validos", "distintos", "minimo", "maximo", *exact, F.round("dif_media", 6).alias("dif_media"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(table(spark, folder, "denue_crudo"))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(table(spark, folder, "denue_crudo"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.reassembled(table(spark, folder, "denue_crudo"))


def _economy(spark: SparkSession, folder: str) -> tuple[list[orphans.References], list[orphans.Parents]]:
    return orphans.economy(*(table(spark, folder, t) for t in ("warehouse", "denue", "crosswalk", "sectores", "scian")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(*_economy(spark, folder))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.report(*_economy(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "denue_entregas"))


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified(table(spark, folder, "denue_entregas")).withColumn("otros", F.to_json("otros"))


def p5_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    return drift.lifespans(table(spark, folder, "denue_entregas"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spatial_join.neighbours(table(spark, folder, "denue"), table(spark, folder, "ageb"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.dominant_sectors(table(spark, folder, "warehouse"), table(spark, folder, "sectores"))


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    d = skew.sector_totals(table(spark, folder, "warehouse"), table(spark, folder, "sectores"))
    return d.withColumn("proporcion", F.round("proporcion", 9))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_profile, p2_found, p2_loaded, p2_records, p4_found, p4_report, p5_found, p5_unified, p5_lifespans, p6_found, p7_found, p7_totals)
}

_CODE = r"nullif(regexp_replace(regexp_replace(upper({}), '^\s+|\s+$', '', 'g'), '\.0$', ''), '')"


def _code(c: str) -> str:
    return _CODE.format(c)


_P1 = """
    r as (select distinct fila_id, lote, n_establecimientos as n, empleo_total as e, n_empleo_faltante as k, omega_metodo as m from warehouse),
    v as (select lote, 'empleo_total' as columna, e as num, null as txt, e is null as nulo, coalesce(not isnan(e) and not isinf(e) and e >= 0, false) as ok from r
          union all select lote, 'n_empleo_faltante', k, null, k is null, coalesce(k between 0 and n, false) from r
          union all select lote, 'omega_metodo', null, m, m is null, coalesce(m in ('empleo', 'establecimientos', 'sin_datos'), false) from r),
    s as (select lote, columna, count(*) as filas, count(*) filter (nulo) as nulos, count(*) filter (not nulo and not ok) as malos, count(*) filter (ok) as validos, count(distinct coalesce(num::varchar, txt)) as distintos from v group by all),
    l as (select lote, lag(lote) over (partition by substr(lote, 1, length(lote) - 7) order by lote[-6:]) as anterior from (select distinct lote from v)),
    b as (select s.*, p.filas as pf, p.nulos as pn, p.validos as pv, l.anterior from s join l using (lote) left join s p on p.lote = l.anterior and p.columna = s.columna),
    vals as (select b.lote as par, v.columna, num, txt, 1 as a, 0 as c from v join b on b.lote = v.lote and b.columna = v.columna where ok and anterior is not null and validos > 0 and pv > 0
             union all select b.lote, v.columna, num, txt, 0, 1 from v join b on b.anterior = v.lote and b.columna = v.columna where ok and validos > 0 and pv > 0),
    g as (select par, columna, num, txt, sum(a) as a, sum(c) as c from vals group by all),
    cum as (select par, columna, txt, sum(a) over w / sum(a) over t as fa, sum(c) over w / sum(c) over t as fc, a / sum(a) over t as xa, c / sum(c) over t as xc from g
            window w as (partition by par, columna order by num rows unbounded preceding), t as (partition by par, columna)),
    d as (select par as lote, columna, case when columna = 'omega_metodo' then sum(abs(xa - xc)) / 2 else max(abs(fa - fc)) end as gap from cum group by par, columna)
"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _field(k: int) -> str:
    raw = f"regexp_extract(l, '{','.join([f'({_FIELD})'] * 6)}', {k})"
    return f"case when {raw}[1] = '\"' then replace({raw}[2:length({raw}) - 1], '\"\"', '\"') else {raw} end"


_P2 = f"""
    l as (select *, coalesce(linea, '') as l from denue_crudo),
    s as (select *, regexp_full_match(l, '{_FIELD}(?:,{_FIELD})*') as comillas, length(regexp_replace(l, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(l, '"(?:[^"]|"")*"', '', 'g'), ',', '')) = 5 as columnas from l),
    f as (select *, {', '.join(f"{_field(k)} as {n}" if k in (2, 4) else f"regexp_replace({_field(k)}, '^[[:space:]]+|[[:space:]]+$', '', 'g') as {n}" for k, n in enumerate(rejects.FIELDS, 1))} from s where comillas and columnas),
    c as (select *, regexp_full_match(id, '[0-9]{{10}}') as b1, regexp_full_match(codigo_act, '[0-9]{{6}}') as b2,
                 case when regexp_full_match(latitud, '[+-]?[0-9]+(\\.[0-9]+)?') then latitud::double between 14 and 33 else false end as b3,
                 case when regexp_full_match(longitud, '[+-]?[0-9]+(\\.[0-9]+)?') then longitud::double between -119 and -86 else false end as b4 from f)
"""

_P5 = r"""
    r as (select distinct registro_id, serie, archivo, fecha_corte, registro from denue_entregas where serie is not null and archivo is not null),
    fi as (select serie, archivo, row_number() over (partition by serie order by min(fecha_corte), archivo) as orden, count(*) over (partition by serie) as ultimo from r group by serie, archivo),
    ok as (select serie, archivo, registro_id, case when json_valid(registro) then registro end as j from r),
    ob as (select row_number() over () as fila, * from ok where json_type(j) = 'OBJECT'),
    fd as (select fila, serie, archivo, lower(regexp_replace(e.key, '^\s+|\s+$', '', 'g')) as campo, case when e.type in ('VARCHAR') then 'text' when e.type = 'BOOLEAN' then 'boolean' when e.type = 'NULL' then null when e.type in ('ARRAY', 'OBJECT') then 'other' else 'number' end as clase,
                  case when e.type <> 'NULL' then case when e.type = 'VARCHAR' then e.value ->> '$' else e.value::varchar end end as valor from ob, json_each(ob.j) as e),
    es as (select fila, min(valor) as est from fd where campo = 'id' and valor is not null group by all),
    kn as (select serie, archivo, campo, clase, count(*) as n from fd group by all),
    pf as (select serie, archivo, campo, arg_min(clase, (-n, clase)) filter (clase is not null) as clase from kn group by all),
    sp as (select *, last_value(clase ignore nulls) over (partition by serie, campo order by orden) as vigente, coalesce(lag(orden) over w <> orden - 1, true) as empieza, coalesce(lead(orden) over w <> orden + 1, true) as termina
           from pf join fi using (serie, archivo) window w as (partition by serie, campo order by orden)),
    go as (select serie, orden + 1 as orden, campo as antes from sp where termina and orden < ultimo),
    ne as (select serie, orden, campo as despues from sp where empieza and orden > 1),
    va as (select distinct fi.serie, orden, est, campo, valor from fd join es using (fila) join fi using (serie, archivo) where valor is not null),
    th as (select distinct fi.serie, orden, est from ob join es using (fila) join fi using (serie, archivo)),
    co as (select a.serie, a.orden, count(*) as comunes from th a join th b on b.serie = a.serie and b.orden = a.orden - 1 and b.est = a.est group by all),
    eq as (select go.serie, go.orden, antes, despues, count(distinct a.est) as iguales from go join ne using (serie, orden) join va a on a.serie = go.serie and a.orden = go.orden - 1 and a.campo = antes
           join va b on b.serie = go.serie and b.orden = go.orden and b.campo = despues and b.est = a.est and b.valor = a.valor group by all),
    re as (select serie, orden, antes, despues from eq join co using (serie, orden) where iguales * 2 >= comunes),
    st as (select serie, orden, campo as antes, campo as despues from sp where not empieza union all select * from re),
    lo as (select serie, orden, 'renombrado' as cambio, antes as campo_antes, despues as campo_despues from re
           union all select serie, orden, 'eliminado', antes, '' from go anti join re using (serie, orden, antes)
           union all select serie, orden, 'agregado', '', despues from ne anti join re using (serie, orden, despues)
           union all select st.serie, st.orden, 'tipo', antes, despues from st join sp a on a.serie = st.serie and a.orden = st.orden - 1 and a.campo = antes join sp b on b.serie = st.serie and b.orden = st.orden and b.campo = despues where a.vigente <> b.clase)
"""

# Coordinates have six decimals, so that micro-degrees are exact integers.
_P6 = """
    pt as (select distinct id, longitud as x, latitud as y, cast(round(longitud * 1e6) as bigint) as px, cast(round(latitud * 1e6) as bigint) as py from denue
           where id is not null and latitud between 14 and 33 and longitud between -119 and -86),
    z as (select distinct cvegeo, geometry from ageb where geometry is not null and cvegeo is not null),
    p as (select cvegeo, generate_subscripts(geometry, 1) as i, unnest(geometry) as poly from z),
    rg as (select cvegeo, i, unnest(poly) as ring from p),
    ed as (select cvegeo, i, cast(round(ring[j].x * 1e6) as bigint) as x1, cast(round(ring[j].y * 1e6) as bigint) as y1, cast(round(ring[j % len(ring) + 1].x * 1e6) as bigint) as x2, cast(round(ring[j % len(ring) + 1].y * 1e6) as bigint) as y2
           from (select *, unnest(range(1, len(ring) + 1)) as j from rg)),
    bx as (select cvegeo, i, min(x1) as bx0, max(x1) as bx1, min(y1) as by0, max(y1) as by1 from ed group by all),
    ca as (select id, px, py, cvegeo, i from pt join bx on px between bx0 and bx1 and py between by0 and by1),
    t as (select id, px, py, cvegeo, i, count(*) filter ((y1 > py) <> (y2 > py) and ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) > 0) = (y2 > y1)) % 2 = 1
                 or bool_or((x2 - x1) * (py - y1) = (y2 - y1) * (px - x1) and px between least(x1, x2) and greatest(x1, x2) and py between least(y1, y2) and greatest(y1, y2)) as dentro
          from ca join ed using (cvegeo, i) group by all),
    c as (select *, cast(floor(y * 3000) as bigint) as cy, cast(floor(x * 2500) as bigint) as cx from pt),
    v as (select *, cy + dy as ny, cx + dx as nx from c, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx)),
    n as (select a.id as a, b.id as b, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2) as h from v a join c b on b.cy = a.ny and b.cx = a.nx and a.id < b.id)
"""

ORACLE: dict[str, str] = {
    "p6_found": f"""with {_P6}
        select distinct 'zona' as relacion, id as clave_1, cvegeo as clave_2 from t where dentro union all select distinct 'cerca', a, b from n where 2 * 6371000.0 * asin(sqrt(h)) <= 30""",
    "p5_found": f"with {_P5} select archivo, cambio, campo_antes, campo_despues from lo join fi using (serie, orden)",
    "p5_lifespans": f"""with {_P5},
        t as (select *, empieza or clase is distinct from lag(clase) over w as nuevo from sp window w as (partition by serie, campo order by orden)),
        u as (select *, sum(nuevo::int) over (partition by serie, campo order by orden) as tramo from t)
        select serie, campo, clase, arg_min(archivo, orden) as desde_archivo, arg_max(archivo, orden) as hasta_archivo, count(*) as archivos from u group by serie, campo, tramo, clase""",
    "p2_found": f"""with {_P2}
        select linea_id, 'comillas' as motivo from s where not comillas union all select linea_id, 'columnas' from s where comillas and not columnas
        union all select linea_id, 'id' from c where not b1 union all select linea_id, 'codigo_act' from c where not b2
        union all select linea_id, 'latitud' from c where not b3 union all select linea_id, 'longitud' from c where not b4""",
    "p2_loaded": f"""with {_P2}
        select linea_id, archivo, linea_no, id, nom_estab, codigo_act, per_ocu, latitud::double as latitud, longitud::double as longitud from c where b1 and b2 and b3 and b4""",
    "p2_records": """
        select archivo, linea_no, linea from denue_crudo where not contains(regexp_replace(linea, '"[^"]*"', '', 'g'), '"') and not contains(regexp_replace(linea, '"[^"]*"', '', 'g'), chr(10))""",
    "p1_found": f"""with {_P1}
        select lote, columna, 'nulos' as hallazgo from b where anterior is not null and nulos / filas - pn / pf > 0.10
        union all select lote, columna, case when columna = 'omega_metodo' then 'patron' else 'rango' end from b where malos > 0
        union all select lote, columna, 'constante' from b where distintos = 1
        union all select lote, columna, 'distribucion' from d where gap > 0.25""",
    "p1_profile": f"""with {_P1},
        m as (select lote, columna, min(num) filter (ok) as minimo, max(num) filter (ok) as maximo, sum(d) as s1, sum(d * d) as s2,
                     (count(*) filter (ok)) as k from (select *, case when ok then num end::decimal(19, 2) as d from v) group by all),
        z as (select lote, columna, minimo, maximo, s1::double as s1, s2::double as s2, s1 / k as media, case when s1 is not null then greatest(0, s2 / k - (s1 / k) * (s1 / k)) end as var from m)
        select b.lote, b.columna, filas, nulos, malos as no_validos, validos, distintos, z.minimo, z.maximo, z.s1, z.s2, round((z.media - p.media) / nullif(sqrt((z.var + p.var) / 2), 0), 6) as dif_media
        from b join z using (lote, columna) left join z p on p.lote = b.anterior and p.columna = b.columna""",
    "p4_found": f"""
        with c as (select distinct fila_id, scian_codigo, sector_serio, vigente_desde, vigente_hasta from crosswalk),
        t as (select 'sectores' as o, {_code('scian')} as k, vigente_desde as a, vigente_hasta as b from sectores union all
              select 'crosswalk', {_code('scian_codigo')}, vigente_desde, vigente_hasta from c union all select 'scian', {_code('scian_codigo')}, vigente_desde, vigente_hasta from scian),
        r as (select distinct 'warehouse' as tabla, 'sector_serio' as campo, 'sectores' as o, periodo, fila_id, {_code('sector_serio')} as k from warehouse union all
              select distinct 'denue', 'codigo_act', 'crosswalk', periodo, fila_id, {_code('codigo_act')} from denue union all
              select 'crosswalk', 'sector_serio', 'sectores', strftime(vigente_desde, '%Y-%m'), fila_id, {_code('sector_serio')} from c union all
              select 'crosswalk', 'scian_codigo', 'scian', strftime(vigente_desde, '%Y-%m'), fila_id, {_code('scian_codigo')} from c),
        q as (select *, (periodo || '-01')::timestamp as m0, (periodo || '-01')::timestamp + interval 1 month as m1 from r where k is not null),
        j as (select tabla, campo, periodo, fila_id, count(t.k) as n, count(*) filter (a < m1 and (b is null or b > m0)) as vale, count(*) filter (a < m1) as antes
              from q left join t on t.o = q.o and t.k = q.k group by all)
        select tabla, campo, periodo, fila_id, case when n = 0 then 'inexistente' when antes = 0 then 'posterior' else 'retirada' end as motivo from j where vale = 0""",
    "p7_found": f"""with r as (select distinct fila_id, {_code('sector_serio')} as s from warehouse)
        select s as sector_serio from r where s is not null group by s having count(*) >= 0.05 * (select count(*) from r)""",
    "p7_totals": f"""with r as (select distinct fila_id, {_code('sector_serio')} as sector_serio, case when empleo_total is null or isnan(empleo_total) or isinf(empleo_total) or empleo_total < 0 then 0 else empleo_total end as e from warehouse)
        select r.sector_serio, n.nombre, count(*) as filas, sum(e) as empleo_total, round(count(*) / (select count(*) from r), 9) as proporcion, r.sector_serio is not null and count(*) >= 0.05 * (select count(*) from r) as dominante
        from r left join (select {_code('scian')} as sector_serio, min(nombre) as nombre from sectores group by 1) n on n.sector_serio = r.sector_serio group by r.sector_serio, n.nombre""",
}

ORACLE["p4_report"] = f"select tabla, campo, periodo, motivo, count(*) as filas from ({ORACLE['p4_found']}) group by all"
