"""The queries of p3, p8, p9 and p10 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonaria.llm import leakage, mixture, stuffing, topn
from zonaria.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.leaders(table(spark, folder, "warehouse"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.cleaned(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    d = mixture.mixed(table(spark, folder, "documents"), table(spark, folder, "mezcla_objetivo"))
    return d.select("doc_id", "source", "copia", "text")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares_reached(table(spark, folder, "documents"), table(spark, folder, "mezcla_objetivo"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed(table(spark, folder, "documents"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    d = stuffing.scores(table(spark, folder, "documents"))
    return d.select("doc_id", "coleccion", *(F.round(c, 9).alias(c) for c in ("propio", "anfitrion", "puntaje")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p8_found, p8_clean, p9_mix, p9_shares, p10_found, p10_scores)}

_CODE = r"nullif(regexp_replace(regexp_replace(upper(sector_serio), '^\s+|\s+$', '', 'g'), '\.0$', ''), '')"

ORACLE: dict[str, str] = {
    "p3_found": f"""
        with r as (select distinct fila_id, cvegeo, {_CODE} as sector,
                     case when empleo_total is null or isnan(empleo_total) or isinf(empleo_total) or empleo_total < 0 then 0 else empleo_total end as w
                   from warehouse where cvegeo is not null),
        p as (select cvegeo, sector, sum(cast(w as decimal(30, 6))) as w from r group by all),
        z as (select cvegeo, sum(w) as w from p group by all)
        select 'sector_dominante' as lista, cvegeo as grupo, cast(1 as bigint) as puesto, sector as elemento from p where sector is not null
        qualify row_number() over (partition by cvegeo order by w desc, sector) = 1
        union all
        select 'agebs_principales', substr(cvegeo, 1, 5), row_number() over (partition by substr(cvegeo, 1, 5) order by w desc, cvegeo) as puesto, cvegeo from z
        qualify puesto <= 5
    """,
    "p8_found": r"""
        with d as (select doc_id, list_filter(regexp_extract_all(lower(text), '\\[\pL]+|[\pL\pN]+'), lambda x: x[1] <> '\') as w from documents),
        i as (select item_id, list_filter(regexp_extract_all(lower(text), '\\[\pL]+|[\pL\pN]+'), lambda x: x[1] <> '\') as w from eval_items),
        ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from i),
        dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from d)
        select distinct doc_id, item_id from dg join ig using (g)
    """,
}
