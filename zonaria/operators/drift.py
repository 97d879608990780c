"""Schemas that drift between the files of a series: a catalogue of field lifespans, its changes, one table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonaria.functions.codes import norm_code
from zonaria.session import materialise
from zonaria.sources.tables import deliveries

# The constant fields and the other spellings under which a first file may bring them.
ALIASES = {
    "id": (),
    "nom_estab": (),
    "codigo_act": ("codigo_act_23", "act_economica", "clase_actividad", "scian"),
    "per_ocu": ("estrato_personal", "personal_ocupado"),
    "latitud": ("lat", "lat_wgs", "coord_norte", "y"),
    "longitud": ("lon", "lng", "coord_este", "x"),
}


def records(entregas: DataFrame) -> DataFrame:
    """(serie, archivo, fecha_corte, registro_id, registro): each record once; rows outside any file are left out."""
    d = deliveries(entregas, "registro_id", "serie", "archivo", "fecha_corte", "registro")
    return d.filter(F.col("serie").isNotNull() & F.col("archivo").isNotNull())


def name_key(c: str | Column) -> Column:
    """A field name in lower case, trimmed."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


NUMBER = re.compile(r"BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(\d+,\s*\d+\)|NUMBER")
FIELD = re.compile(r"(?:`((?:[^`]|``)*)`|([A-Za-z0-9_]+)): ")


def shape(registro: str) -> Column:
    """The names and kinds of a record's fields as one text, null where it doesn't parse."""
    return F.schema_of_variant(F.try_parse_json(registro))


def plain_shape(t: str) -> Column:
    """A shape with one kind for numbers of any width, so that records of a file share few; null for anything but an object.

    Names in back quotes that hold a colon are left as they are.
    """
    plain = F.regexp_replace(t, r": (?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\s*\d+\))(?=[,>])", ": NUMBER")
    return F.when(F.startswith(F.col(t), F.lit("OBJECT")), F.when(F.col(t).rlike("`[^`:]+:"), F.col(t)).otherwise(plain))


def fields_of(shape_text: str) -> list[tuple[str, str | None]]:
    """(name, kind) of the fields of a shape: number, text, boolean or other; None for a JSON null."""
    out, at, end = [], len("OBJECT<"), len(shape_text) - 1
    while at < end:
        m = FIELD.match(shape_text, at)
        name = m[1].replace("``", "`") if m[1] is not None else m[2]
        at = start = m.end()
        depth = 0
        while at < end and (depth or shape_text[at] != ","):  # up to the comma that ends this field
            if shape_text[at] == "`":
                at = shape_text.index("`", at + 1)
            depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(shape_text[at], 0)
            at += 1
        t = shape_text[start:at]
        kind = {"VOID": None, "STRING": "text", "BOOLEAN": "boolean"}.get(t, "number" if NUMBER.fullmatch(t) else "other")
        out.append((name, kind))
        at += 2
    return out


def _unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, a, k, c, n) for s, a, f, n in zip(pdf["serie"], pdf["archivo"], pdf["forma"], pdf["n"], strict=True) for k, c in fields_of(f)]
        yield pd.DataFrame(rows, columns=["serie", "archivo", "clave", "clase", "n"])


@dataclass(frozen=True)
class Catalogue:
    """``files``: (serie, archivo, orden); ``spans``: per file and field its kind and neighbours in time."""

    files: DataFrame
    spans: DataFrame


def catalogue(entregas: DataFrame) -> Catalogue:
    """The column lifespan catalogue.  Its rows are files x fields, not records.

    A record is parsed once and stands for its shape; shapes are counted per
    file before they are unfolded into fields, the footer of the file.
    """
    in_file = entregas.filter(F.col("serie").isNotNull() & F.col("archivo").isNotNull())
    same = F.when(F.col("registro_id").isNull(), F.xxhash64("registro")).alias("sin_id")
    parsed = in_file.select("registro_id", "serie", "archivo", "fecha_corte", shape("registro").alias("_t"), same)
    once = parsed.select("registro_id", "serie", "archivo", "fecha_corte", plain_shape("_t").alias("forma"), "sin_id").distinct()
    shapes = materialise(once.groupBy("serie", "archivo", "fecha_corte", "forma").agg(F.count("*").alias("n")))
    by_date = Window.partitionBy("serie").orderBy(F.col("fecha_corte").asc_nulls_first(), "archivo")
    files = shapes.groupBy("serie", "archivo").agg(F.min("fecha_corte").alias("fecha_corte"))
    files = files.withColumn("orden", F.row_number().over(by_date)).withColumn("ultimo", F.max("orden").over(Window.partitionBy("serie")))
    files = materialise(files)
    named = shapes.filter(F.col("forma").isNotNull()).select("serie", "archivo", "forma", "n")
    keys = named.mapInPandas(_unfold, "serie string, archivo string, clave string, clase string, n bigint").withColumn("campo", name_key("clave"))
    kinds = keys.groupBy("serie", "archivo", "campo", "clase").agg(F.sum("n").alias("n"), F.collect_set("clave").alias("claves"))
    per_field = kinds.groupBy("serie", "archivo", "campo").agg(
        F.min(F.when(F.col("clase").isNotNull(), F.struct((-F.col("n")).alias("n"), "clase")))["clase"].alias("clase"),
        F.sum("n").alias("presentes"),
        F.coalesce(F.sum(F.when(F.col("clase").isNotNull(), F.col("n"))), F.lit(0)).alias("con_valor"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("claves")))).alias("claves"),
    )
    w = Window.partitionBy("serie", "campo").orderBy("orden")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.lag("orden").over(w) != F.col("orden") - 1, F.lit(True))
    spans = (
        per_field.join(files, ["serie", "archivo"])
        .withColumns({"clase_vigente": F.last("clase", True).over(past), "empieza": starts, "siguiente": F.lead("orden").over(w)})
        .withColumn("termina", F.coalesce(F.col("siguiente") != F.col("orden") + 1, F.lit(True)))
        .withColumn("isla", F.sum(F.col("empieza").cast("int")).over(past))
        .drop("siguiente")
    )
    return Catalogue(files, materialise(spans))


def lifespans(entregas: DataFrame) -> DataFrame:
    """(serie, campo, clase, desde_archivo, hasta_archivo, archivos): runs of consecutive files with a field of one kind."""
    spans = catalogue(entregas).spans
    w = Window.partitionBy("serie", "campo").orderBy("orden")
    new = (F.col("empieza") | ~F.col("clase").eqNullSafe(F.lag("clase").over(w))).cast("int")
    return (
        spans.withColumn("_n", new)
        .withColumn("_tramo", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("serie", "campo", "_tramo", "clase")
        .agg(F.min_by("archivo", "orden").alias("desde_archivo"), F.max_by("archivo", "orden").alias("hasta_archivo"), F.count("*").alias("archivos"))
        .drop("_tramo")
    )


def renames(entregas: DataFrame, cat: Catalogue) -> DataFrame:
    """(serie, orden, antes, despues): fields gone in a file whose values live on under a new name.

    Candidates are the pairs of an ending and a beginning lifespan in one file;
    only their files are read again, and of those only the candidates' values.
    At least half of the establishments in both files must have the same
    non-null text.  A record without id belongs to no establishment; an
    establishment's records in one file are alternatives.
    """
    s = cat.spans
    gone = s.filter(F.col("termina") & (F.col("orden") < F.col("ultimo"))).select("serie", (F.col("orden") + 1).alias("par"), F.col("campo").alias("antes"), F.col("claves").alias("_antes"))
    new = s.filter(F.col("empieza") & (F.col("orden") > 1)).select("serie", F.col("orden").alias("par"), F.col("campo").alias("despues"), F.col("claves").alias("_despues"))
    pairs = materialise(gone.join(new, ["serie", "par"]))
    asked = (
        pairs.select("serie", (F.col("par") - 1).alias("orden"), F.struct("par", F.lit(1).alias("lado"), F.col("antes").alias("campo"), F.col("_antes").alias("claves")).alias("pedido"))
        .unionByName(pairs.select("serie", F.col("par").alias("orden"), F.struct("par", F.lit(2).alias("lado"), F.col("despues").alias("campo"), F.col("_despues").alias("claves")).alias("pedido")))
        .groupBy("serie", "orden")
        .agg(F.collect_set("pedido").alias("pedidos"))
    )
    ident = s.filter("campo = 'id'").select("serie", "orden", F.col("claves").alias("ids"))
    asked = materialise(asked.join(cat.files.select("serie", "orden", "archivo"), ["serie", "orden"]).join(ident, ["serie", "orden"]).drop("orden"))
    m = F.from_json("registro", "map<string,string>")
    given = lambda ks: F.filter(F.transform(ks, lambda k: F.try_element_at("_m", k)), lambda v: v.isNotNull())
    d = entregas.select("serie", "archivo", m.alias("_m")).join(asked, ["serie", "archivo"]).withColumn("est", F.get(given(F.col("ids")), F.lit(0))).filter(F.col("est").isNotNull())
    d = d.select("serie", "est", F.inline(F.transform("pedidos", lambda p: F.struct(p["par"].alias("par"), p["lado"].alias("lado"), p["campo"].alias("campo"), given(p["claves"]).alias("_v")))))
    d = d.select("serie", "par", "lado", "campo", "est", F.explode_outer("_v").alias("valor"))
    on = lambda side: F.collect_set(F.when((F.col("lado") == side) & F.col("valor").isNotNull(), F.col("campo")))
    met = materialise(d.groupBy("serie", "par", "est", "valor").agg(F.bit_or("lado").alias("lados"), on(1).alias("antes"), on(2).alias("despues")))
    common = met.groupBy("serie", "par", "est").agg(F.bit_or("lados").alias("lados")).filter("lados = 3").groupBy("serie", "par").agg(F.count("*").alias("comunes"))
    equal = met.filter((F.size("antes") > 0) & (F.size("despues") > 0)).select("serie", "par", "est", F.explode("antes").alias("antes"), "despues")
    equal = equal.select("serie", "par", "est", "antes", F.explode("despues").alias("despues")).distinct().groupBy("serie", "par", "antes", "despues").agg(F.count("*").alias("iguales"))
    named = equal.join(common, ["serie", "par"]).filter(F.col("iguales") * 2 >= F.col("comunes"))
    return named.select("serie", F.col("par").alias("orden"), "antes", "despues")


def _log(cat: Catalogue, named: DataFrame) -> DataFrame:
    s = cat.spans
    files = cat.files.select("serie", "orden", "archivo")
    gone = s.filter(F.col("termina") & (F.col("orden") < F.col("ultimo"))).select("serie", (F.col("orden") + 1).alias("orden"), F.col("campo").alias("antes"))
    new = s.filter(F.col("empieza") & (F.col("orden") > 1)).select("serie", "orden", F.col("campo").alias("despues"))
    ended = gone.join(named, ["serie", "orden", "antes"], "left_anti").select("serie", "orden", F.lit("eliminado").alias("cambio"), F.col("antes").alias("campo_antes"), F.lit("").alias("campo_despues"))
    begun = new.join(named, ["serie", "orden", "despues"], "left_anti").select("serie", "orden", F.lit("agregado").alias("cambio"), F.lit("").alias("campo_antes"), F.col("despues").alias("campo_despues"))
    moved = named.select("serie", "orden", F.lit("renombrado").alias("cambio"), F.col("antes").alias("campo_antes"), F.col("despues").alias("campo_despues"))
    stayed = s.filter(~F.col("empieza")).select("serie", "orden", F.col("campo").alias("antes"), F.col("campo").alias("despues"))
    then = s.select("serie", (F.col("orden") + 1).alias("orden"), F.col("campo").alias("antes"), F.col("clase_vigente").alias("_antes"))
    now = s.select("serie", "orden", F.col("campo").alias("despues"), F.col("clase").alias("_ahora"))
    kind = (
        stayed.unionByName(named)
        .join(then, ["serie", "orden", "antes"])
        .join(now, ["serie", "orden", "despues"])
        .filter(F.col("_antes") != F.col("_ahora"))
        .select("serie", "orden", F.lit("tipo").alias("cambio"), F.col("antes").alias("campo_antes"), F.col("despues").alias("campo_despues"))
    )
    log = ended.unionByName(begun).unionByName(moved).unionByName(kind)
    return log.join(files, ["serie", "orden"]).select("archivo", "cambio", "campo_antes", "campo_despues")


def changes(entregas: DataFrame) -> DataFrame:
    """(archivo, cambio, campo_antes, campo_despues): renombrado, eliminado, agregado and tipo, with their file."""
    cat = catalogue(entregas)
    return _log(cat, materialise(renames(entregas, cat)))


def _alias_rows(pdf: pd.DataFrame, known: dict[str, str]) -> pd.DataFrame:
    """The constant name of every field of a series' files, following renames from file to file."""
    out = []
    named: dict[str, str] = {}
    for orden, g in pdf.sort_values("orden").groupby("orden", sort=True):
        now = {}
        for campo, antes in zip(g["campo"], g["antes"], strict=True):
            if isinstance(antes, str) and antes in named:
                now[campo] = named[antes]
            else:
                now[campo] = named.get(campo) or known.get(campo, campo)
        named |= now
        out += [(g["serie"].iloc[0], int(orden), c, k) for c, k in now.items()]
    return pd.DataFrame(out, columns=["serie", "orden", "campo", "constante"])


def alias_table(cat: Catalogue, named: DataFrame) -> DataFrame:
    """(serie, orden, campo, constante): learned from the renames, with the known spellings for a field's first name.

    One group is a series' catalogue: its files times its fields.
    """
    known = {a: k for k, v in ALIASES.items() for a in (k, *v)}
    one = named.groupBy("serie", "orden", F.col("despues").alias("campo")).agg(F.min("antes").alias("antes"))
    rows = cat.spans.select("serie", "orden", "campo").join(one, ["serie", "orden", "campo"], "left")
    return rows.groupBy("serie").applyInPandas(lambda pdf: _alias_rows(pdf, known), "serie string, orden int, campo string, constante string")


def unified(entregas: DataFrame) -> DataFrame:
    """One table with constant fields and types over all files of all series.

    (registro_id, serie, archivo, orden, id, nom_estab, codigo_act, per_ocu,
    latitud, longitud, otros): codes are normalised, coordinates are doubles or
    null where the text is no number, and other fields stay as text in the map
    ``otros``.  Of several fields with one constant name the first by name with
    a value counts.  A record without fields has nulls.
    """
    cat = catalogue(entregas)
    names = alias_table(cat, materialise(renames(entregas, cat)))
    spelt = cat.spans.select("serie", "orden", "campo", F.explode("claves").alias("clave")).join(names, ["serie", "orden", "campo"])
    per_file = spelt.groupBy("serie", "orden").agg(F.array_sort(F.collect_list(F.struct("campo", "clave", "constante"))).alias("campos"))
    per_file = materialise(cat.files.select("serie", "archivo", "orden").join(per_file, ["serie", "orden"], "left"))
    m = F.when(F.startswith(shape("registro"), F.lit("OBJECT")), F.from_json("registro", "map<string,string>"))
    d = records(entregas).withColumn("_m", m).join(per_file, ["serie", "archivo"])
    value = lambda c: F.struct(c["constante"].alias("constante"), F.try_element_at("_m", c["clave"]).alias("valor"))
    d = d.withColumn("_v", F.filter(F.transform("campos", value), lambda v: v["valor"].isNotNull()))
    first = lambda name: F.get(F.filter("_v", lambda v: v["constante"] == name), F.lit(0))["valor"]
    constant = list(ALIASES)
    rest = F.array_sort(F.array_distinct(F.filter(F.transform("_v", lambda v: v["constante"]), lambda c: ~c.isin(constant))))
    other = F.when(F.size("_v") > 0, F.map_from_arrays(rest, F.transform(rest, first)))
    d = d.select("registro_id", "serie", "archivo", "orden", *(first(c).alias(c) for c in constant), other.alias("otros"))
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    return d.select(
        "registro_id", "serie", "archivo", "orden", F.trim("id").alias("id"), "nom_estab", norm_code("codigo_act").alias("codigo_act"), "per_ocu",
        number("latitud").alias("latitud"), number("longitud").alias("longitud"), "otros",
    )
