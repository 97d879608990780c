"""Column functions on codes, keys and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def norm_code(c: str | Column) -> Column:
    """A code without surrounding white space, letter case and a final ``.0``; null and blank give null."""
    return F.nullif(F.regexp_replace(F.upper(strip(c)), r"\.0$", ""), F.lit(""))


def month_start(periodo: str | Column) -> Column:
    """First instant of a ``YYYY-MM`` month, null when it isn't one."""
    return F.try_to_timestamp(F.concat(_col(periodo), F.lit("-01")), F.lit("yyyy-MM-dd"))


def midpoint(band: str | Column) -> Column:
    """Employment midpoint of a DENUE size band; unknown bands give null."""
    # The size bands of the register and their midpoints.
    bands = {
        "0 a 5 personas": 2.5,
        "6 a 10 personas": 8.0,
        "11 a 30 personas": 20.5,
        "31 a 50 personas": 40.5,
        "51 a 100 personas": 75.5,
        "101 a 250 personas": 175.5,
        "251 y más personas": 300.0,
    }
    out = F.lit(None).cast("double")
    for k, v in bands.items():
        out = F.when(_col(band) == k, v).otherwise(out)
    return out
