"""The hierarchical crosswalk from activity codes (2 to 6 digits) to sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonaria import errors
from zonaria.errors import require
from zonaria.operators.ingest import with_unique
from zonaria.report import Report

# Levels of the code by number of digits, states, evidence, mappings and priorities of a row.
LEVELS = {2: "SECTOR", 3: "SUBSECTOR", 4: "RAMA", 5: "SUBRAMA", 6: "CLASE"}
FLAT_SCHEMA = ("scian_codigo", "sector_serio", "notas")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
AUTHORING_SCHEMA = (
    "scian_codigo", "scian_nivel", "scian_titulo", "serio_sector", "serio_nombre", "evidence_type", "status", "priority", "mapping_type", "source",
    "justification", "reviewed_by", "review_date", "notes", "crosswalk_version", "scian_version", "serio_version", "generated_at", "generated_by",
)
VERSION_COLUMNS = ("crosswalk_version", "scian_version", "serio_version", "generated_by")
BLANK_STATES = ("REVIEW_REQUIRED", "OUT_OF_SCOPE", "PENDING")
MASTER_RULES = (
    # confidence, needs review -> state, mapping, evidence, priority
    ("alta", "no", "VERIFIED", "EXACT", "OFFICIAL", "LOW"),
    ("media", "no", "VERIFIED", "EXACT", "EXPERT", "MEDIUM"),
    ("media", "si", "REVIEW_REQUIRED", "PARTIAL", "EXPERT", "HIGH"),
    ("baja", "si", "REVIEW_REQUIRED", "AMBIGUOUS", "EXPERT", "HIGH"),
)


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def _known(sector: Column, universe: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: the sector is in the universe (sector).  The universe is a catalogue of sectors."""
    u = universe.select(F.trim("sector").alias("_u")).filter("_u is not null").distinct()
    return df.join(u, sector == F.col("_u"), "left").withColumn(name, F.col("_u").isNotNull()).drop("_u")


def tag_flat(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds five chk_ columns and ``_valid`` to (scian_codigo, sector_serio, notas); drops nothing.

    Codes and sectors are trimmed.  Null codes aren't repeats of each other.
    """
    require(rows, "scian_codigo", "sector_serio")
    code, sector = F.trim("scian_codigo"), F.trim("sector_serio")
    d = _known(sector, universe, rows, "chk_sector_known")
    d = d.withColumns(
        {
            "chk_code_present": code.isNotNull(),
            "chk_code_six_digits": F.coalesce(code.rlike(r"\A[0-9]{6}\z"), F.lit(False)),
            "chk_sector_present": sector.isNotNull(),
        }
    )
    d = with_unique(d, code, "chk_code_unique", null_unique=True)
    checks = [c for c in d.columns if c.startswith("chk_")]
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.col(c)
    return d.withColumn("_valid", ok)


def lookup(tagged: DataFrame) -> DataFrame:
    """(scian, sector): the valid rows."""
    return tagged.filter("_valid").select(F.trim("scian_codigo").alias("scian"), F.trim("sector_serio").alias("sector"))


def apply(establishments: DataFrame, table: DataFrame) -> DataFrame:
    """``establishments`` with ``sector``, null where the code has none; every row stays."""
    t = table.select(F.col("scian").alias("_c"), "sector")
    return establishments.join(t, F.col("scian") == F.col("_c"), "left").drop("_c")


def unmapped(establishments: DataFrame, table: DataFrame) -> DataFrame:
    """(scian): the distinct codes without a sector."""
    return establishments.select("scian").filter(_filled("scian")).distinct().join(table, "scian", "left_anti")


def state_ok() -> Column:
    """A verified row names a sector, has evidence that isn't inferred, maps exactly and is justified; an open one names none."""
    verified = _filled("sector") & (F.col("evidence") != "INFERRED") & (F.col("mapping") == "EXACT") & _filled("justification")
    s = F.col("status")
    return F.coalesce(F.when(s == "VERIFIED", verified).when(s.isin(*BLANK_STATES), ~_filled("sector")).otherwise(False), F.lit(False))


def tag_authoring(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds chk_ columns and ``_valid`` to (code, level, title, sector, status, evidence, mapping, justification)."""
    d = rows.na.fill("")
    code = F.trim("code")
    numeric = code.rlike(r"\A[0-9]+\z")
    digits = F.lit(None).cast("int")
    for n, name in LEVELS.items():
        digits = F.when(F.col("level") == name, n).otherwise(digits)
    d = _known(F.trim("sector"), universe, d, "_known")
    d = with_unique(d, F.when(numeric, code), "chk_unique", null_unique=True)
    d = d.withColumns(
        {
            "chk_numeric": numeric,
            "chk_length": F.coalesce(F.length(code) == digits, F.lit(False)),
            "chk_sector": F.col("_known") | ~_filled("sector"),
            "chk_state": state_ok(),
        }
    ).drop("_known")
    checks = [c for c in d.columns if c.startswith("chk_")]
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.col(c)
    return d.withColumn("_valid", ok)


def check_authoring(tagged: DataFrame) -> Report:
    """Counts by check; raises by priority (repeated, unknown sector, length, not numeric, state) naming every category."""
    r = Report.of(
        "crosswalk_authoring",
        tagged.agg(F.count("*").alias("n"), *(F.count_if(~F.col(c)).alias(c[4:]) for c in tagged.columns if c.startswith("chk_"))),
    )
    order = (("unique", errors.DuplicateCodeError), ("sector", errors.UnknownSectorError), ("length", errors.CodeLengthError), ("numeric", errors.NonNumericCodeError), ("state", errors.StateConsistencyError))
    failed = [(k, e) for k, e in order if r.values[k]]
    if failed:
        raise failed[0][1]("; ".join(f"{k}: {r.values[k]}" for k, _ in failed))
    return r


def shared_titles(rows: DataFrame) -> DataFrame:
    """(titulo, sectores): titles that lead to several sectors."""
    return (
        rows.filter(_filled("sector") & _filled("title"))
        .groupBy(F.lower(F.trim("title")).alias("titulo"))
        .agg(F.countDistinct(F.trim("sector")).alias("sectores"))
        .filter("sectores > 1")
    )


def from_master(master: DataFrame, names: DataFrame) -> DataFrame:
    """Authoring rows from (nivel_scian, codigo_scian, descripcion_scian, sector (a name), confianza, requiere_revision, justificacion).

    ``names`` is (nombre, sector).  A review row keeps its candidate in the
    notes only.  A row whose confidence and review flag are no legal pair, or a
    verified one with an unknown sector name, raises.
    """
    spark = master.sparkSession
    rules = spark.createDataFrame(list(MASTER_RULES), "_c string, _r string, status string, mapping string, evidence string, priority string")
    d = master.na.fill("")
    d = d.join(F.broadcast(rules), (F.lower(F.trim("confianza")) == F.col("_c")) & (F.translate(F.lower(F.trim("requiere_revision")), "í", "i") == F.col("_r")), "left").drop("_c", "_r")
    n = names.select(F.trim("nombre").alias("_n"), F.col("sector").alias("_code")).dropDuplicates(["_n"])
    d = d.join(n, F.trim("sector") == F.col("_n"), "left")
    bad = d.filter(F.col("status").isNull() | ((F.col("status") == "VERIFIED") & F.col("_code").isNull())).limit(10).collect()
    if bad:
        raise errors.MasterRuleError("illegal master rows: " + ", ".join(r["codigo_scian"] for r in bad))
    verified = F.col("status") == "VERIFIED"
    return d.select(
        F.trim("codigo_scian").alias("code"),
        F.upper(F.trim("nivel_scian")).alias("level"),
        F.col("descripcion_scian").alias("title"),
        F.when(verified, F.col("_code")).otherwise("").alias("sector"),
        "status",
        "evidence",
        "mapping",
        F.col("justificacion").alias("justification"),
        "priority",
        F.when(verified, "").otherwise(F.col("sector")).alias("notes"),
    )


def prefixes(codes: DataFrame, code: str = "scian") -> DataFrame:
    """``codes`` once per level: (…, digits, prefix), from six digits down to two."""
    parts = F.array(*(F.struct(F.lit(n).alias("digits"), F.substring(F.col(code), 1, n).alias("prefix")) for n in sorted(LEVELS, reverse=True)))
    return codes.select("*", F.inline(parts))


def check_rules(rules: DataFrame) -> DataFrame:
    """The verified rules (digits, prefix, sector); two of them for one code raise."""
    r = rules.filter("status = 'VERIFIED'").select(F.length(F.trim("code")).alias("digits"), F.trim("code").alias("prefix"), F.trim("sector").alias("sector"))
    twice = r.groupBy("prefix").count().filter("count > 1").limit(10).collect()
    if twice:
        raise errors.StateConsistencyError("several verified rules: " + ", ".join(x["prefix"] for x in twice))
    return r


def resolve(codes: DataFrame, rules: DataFrame, code: str = "scian") -> DataFrame:
    """(code, nivel, prefijo, sector): the longest verified prefix of each distinct six-digit code, nulls where none matches.

    Codes that aren't six digits stay unresolved.  One equi-join on the prefix;
    the best of at most five matches is kept while they are aggregated.
    """
    level = F.lit(None).cast("string")
    for n, name in LEVELS.items():
        level = F.when(F.col("m.digits") == n, name).otherwise(level)
    distinct = codes.select(F.trim(F.col(code)).alias(code)).filter(_filled(code)).distinct()
    six = prefixes(distinct.filter(F.col(code).rlike(r"\A[0-9]{6}\z")), code)
    hit = six.join(rules, ["digits", "prefix"]).groupBy(code).agg(F.max(F.struct("digits", "prefix", "sector")).alias("m"))
    return distinct.join(hit, code, "left").select(code, level.alias("nivel"), F.col("m.prefix").alias("prefijo"), F.col("m.sector").alias("sector"))


def compile_flat(codes: DataFrame, rules: DataFrame, code: str = "scian") -> DataFrame:
    """(scian_codigo, sector_serio, notas): the flat table of the observed codes that resolve."""
    r = resolve(codes, rules, code).filter("sector is not null")
    return r.select(F.col(code).alias("scian_codigo"), F.col("sector").alias("sector_serio"), F.concat(F.lit("nivel "), "nivel", F.lit(" "), "prefijo").alias("notas"))


def suggest(codes: DataFrame, authoring: DataFrame, rules: DataFrame, code: str = "scian") -> DataFrame:
    """Pending rows for observed six-digit codes without a row of their own; evidence is inferred where an ancestor resolves."""
    own = authoring.filter("level = 'CLASE'").select(F.trim("code").alias(code))
    new = resolve(codes, rules, code).filter(F.col(code).rlike(r"\A[0-9]{6}\z")).join(own, code, "left_anti")
    return new.select(
        F.col(code).alias("code"),
        F.lit("CLASE").alias("level"),
        F.lit("").alias("sector"),
        F.lit("PENDING").alias("status"),
        F.when(F.col("sector").isNotNull(), "INFERRED").otherwise("").alias("evidence"),
        F.lit("MEDIUM").alias("priority"),
        F.coalesce("sector", F.lit("")).alias("notes"),
    )


def coverage(authoring: DataFrame, catalogue: DataFrame, observed: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: coverage of the catalogue by verified class rows, and of the observed codes through the whole hierarchy.

    The two are never merged.  Percentages have two decimals and are 0 where
    nothing is to be covered.
    """
    clase = authoring.filter("level = 'CLASE'")
    cat = catalogue.select(F.trim("scian").alias("scian")).filter(_filled("scian")).distinct()
    done = clase.filter("status = 'VERIFIED'").select(F.trim("code").alias("scian")).distinct().withColumn("hecho", F.lit(1))
    a = cat.join(done, "scian", "left").agg(F.count("*").alias("catalogo"), F.count("hecho").alias("catalogo_cubierto"))
    b = resolve(observed, rules).agg(F.count("*").alias("observados"), F.count("sector").alias("observados_resueltos"))
    c = clase.agg(F.count("*").alias("clases"), *(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("VERIFIED", *BLANK_STATES)))
    pct = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) * 100.0 / F.col(y), 2)).otherwise(0.0)
    one = lambda d: d.withColumn("_k", F.lit(1))
    return (
        one(a)
        .join(one(b), "_k")
        .join(one(c), "_k")
        .drop("_k")
        .withColumns({"coverage_catalog_pct": pct("catalogo_cubierto", "catalogo"), "coverage_denue_pct": pct("observados_resueltos", "observados"), "verified_pct": pct("n_verified", "clases")})
    )


def by_priority(authoring: DataFrame) -> DataFrame:
    """(priority, n, verified_pct): class rows of each of the three priorities, zeros for one without rows."""
    every = authoring.sparkSession.createDataFrame([(p,) for p in PRIORITIES], "priority string")
    n = authoring.filter("level = 'CLASE'").groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "VERIFIED").alias("_v"))
    d = every.join(n, "priority", "left").na.fill(0, ["n", "_v"])
    return d.select("priority", "n", F.when(F.col("n") > 0, F.round(F.col("_v") * 100.0 / F.col("n"), 2)).otherwise(0.0).alias("verified_pct"))


def by_sector(authoring: DataFrame) -> DataFrame:
    """(sector, n): verified class rows per sector."""
    return authoring.filter("level = 'CLASE' and status = 'VERIFIED'").groupBy("sector").agg(F.count("*").alias("n"))


def review_queue(authoring: DataFrame) -> DataFrame:
    """(code, title, priority, notes): class rows that wait for a review."""
    return authoring.filter("level = 'CLASE' and status = 'REVIEW_REQUIRED'").select("code", "title", "priority", "notes")


def unresolved(observed: DataFrame, rules: DataFrame, code: str = "scian") -> DataFrame:
    """(code): observed codes that no verified rule resolves, or that have not six digits."""
    return resolve(observed, rules, code).filter(F.col("sector").isNull()).select(code)


def status_shares(authoring: DataFrame) -> DataFrame:
    """One row of percentages of the class rows: each status, and ambiguous mappings; 0 without class rows."""
    c = authoring.filter("level = 'CLASE'")
    share = lambda hit: F.when(F.count("*") > 0, F.round(F.count_if(hit) * 100.0 / F.count("*"), 2)).otherwise(0.0)
    states = {s: F.col("status") == s for s in ("VERIFIED", *BLANK_STATES)} | {"AMBIGUOUS": F.col("mapping") == "AMBIGUOUS"}
    return c.agg(*(share(hit).alias(f"{s.lower()}_pct") for s, hit in states.items()))


def coverage_report(authoring: DataFrame, catalogue: DataFrame, observed: DataFrame, rules: DataFrame, versions: dict[str, str] | None = None) -> Report:
    """The whole report as one document.  Its lists are bounded by the catalogue of codes."""
    rows = lambda d: [r.asDict() for r in d.collect()]
    values = coverage(authoring, catalogue, observed, rules).first().asDict() | status_shares(authoring).first().asDict()
    lists = {"priority_breakdown": rows(by_priority(authoring)), "by_sector": rows(by_sector(authoring)), "review_queue": rows(review_queue(authoring)), "unmapped": sorted(r[0] for r in unresolved(observed, rules).collect())}
    return Report("crosswalk_coverage", values | lists | {"metadata": versions or {}})


def second_round(authoring: DataFrame, catalogue: DataFrame, observed: DataFrame, rules: DataFrame) -> tuple[Report, Report]:
    """The coverage before and after the suggested rows are added: what a reviewer has to decide next."""
    added = authoring.unionByName(suggest(observed, authoring, rules), allowMissingColumns=True)
    return coverage_report(authoring, catalogue, observed, rules), coverage_report(added, catalogue, observed, rules)


def authoring_template(rows: DataFrame, versions: dict[str, str]) -> DataFrame:
    """``rows`` in the authoring schema: missing columns blank, version columns filled only where they are blank."""
    filled = {c: F.col(c).cast("string") if c in rows.columns else F.lit("") for c in AUTHORING_SCHEMA}
    d = rows.select(*(F.coalesce(v, F.lit("")).alias(c) for c, v in filled.items()))
    return d.withColumns({c: F.when(F.trim(c).isin("", "nan"), F.lit(v)).otherwise(F.col(c)) for c, v in versions.items() if c in VERSION_COLUMNS})


def write_flat_template(sectors: DataFrame, folder: str) -> None:
    """An empty flat crosswalk and, beside it, the sectors it may name."""
    empty = sectors.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in FLAT_SCHEMA))
    empty.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/crosswalk")
    sectors.select(F.col("sector").alias("sector_serio")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/sectores")
