"""Numbers as short texts."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(c: str | Column, decimals: int = 1, prefix: str = "") -> Column:
    """1234567 as 1.2M: thousands K, millions M, thousands of millions B; nulls as a dash."""
    v = F.col(c) if isinstance(c, str) else c
    a = F.abs(v)
    text = lambda x, unit: F.concat(F.when(v < 0, "-").otherwise(""), F.lit(prefix), F.format_string(f"%.{decimals}f", x), F.lit(unit))
    return (
        F.when(v.isNull(), "—").when(a >= 1e9, text(a / 1e9, "B")).when(a >= 1e6, text(a / 1e6, "M")).when(a >= 1e3, text(a / 1e3, "K")).otherwise(text(a.cast("double"), ""))
    )


def compact_short(c: str | Column) -> Column:
    """The rule of the statistics: M with two decimals, K with one, smaller numbers whole; nulls and NaN as a dash."""
    v = F.col(c) if isinstance(c, str) else c
    v = F.nanvl(v.cast("double"), F.lit(None))
    a, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    shown = F.when(a >= 1e6, F.format_string("%,.2fM", a / 1e6)).when(a >= 1e3, F.format_string("%,.1fK", a / 1e3)).otherwise(F.format_string("%,.0f", a))
    return F.when(v.isNull(), "—").otherwise(F.concat(sign, shown))


def compact_long(c: str | Column, currency: str = "") -> Column:
    """The rule of the simulations: B, M and K, two decimals throughout; with a currency sign where given."""
    v = F.col(c) if isinstance(c, str) else c
    v = v.cast("double")
    a, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    shown = F.when(a >= 1e9, F.format_string("%,.2fB", a / 1e9)).when(a >= 1e6, F.format_string("%,.2fM", a / 1e6)).when(a >= 1e3, F.format_string("%,.2fK", a / 1e3)).otherwise(F.format_string("%,.2f", a))
    return F.concat(sign, F.lit(currency), shown)


def now_iso() -> str:
    """This instant in UTC, as reports carry it."""
    return datetime.now(UTC).isoformat()


def percent(c: str | Column, decimals: int = 1) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v.isNull(), "—").otherwise(F.concat(F.format_string(f"%.{decimals}f", v.cast("double")), F.lit("%")))


def palette(c: str | Column, colours: list[str]) -> Column:
    """The colour of a 1-based place, going round."""
    v = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.array(*map(F.lit, colours)), (F.pmod(v - 1, F.lit(len(colours))) + 1).cast("int"))
