"""Separating CSV records that don't parse, with the reasons, from those that load."""

from __future__ import annotations

import csv
import itertools
import re
import sys
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("id", "nom_estab", "codigo_act", "per_ocu", "latitud", "longitud")
PARSED = "array<string>"
LINES = 1 << 20  #: numbers kept free for the lines of one record


class BrokenQuotes(csv.Error):
    """A field with a double quote outside the quoting rules."""


class WrongWidth(csv.Error):
    """A record with too few or too many fields."""


def assemble(lines: DataFrame, file: str, number: str, text: str, block: int = 100_000) -> DataFrame:
    """(file, number, text): records put together from physical lines, quote-aware.

    A line that starts inside an open quote continues the record before it; the
    record keeps the number of its first line.  Whether a quote is open follows
    from the parity of the quotes before the line, a running sum taken first
    over blocks of lines and then inside each, so that a long file is spread.

    It is for files whose line ends alone part the records.  Records that come
    whole, one to a row, must not go through it: a stray quote in one would join
    it to those after it.
    """
    d = lines.select(file, number, F.coalesce(text, F.lit("")).alias(text)).withColumns(
        {"_q": F.length(text) - F.length(F.replace(F.col(text), F.lit('"'), F.lit(""))), "_b": F.floor(F.col(number) / block)}
    )
    up_to = Window.partitionBy(file, "_b").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(file).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def running(x: DataFrame, c: str, to: str) -> DataFrame:
        start = x.groupBy(file, "_b").agg(F.sum(c).alias("_s")).select(file, "_b", F.coalesce(F.sum("_s").over(blocks), F.lit(0)).alias("_s"))
        return x.join(start, [file, "_b"]).withColumn(to, F.col("_s") + F.coalesce(F.sum(c).over(up_to), F.lit(0))).drop("_s")

    d = running(d, "_q", "_open").withColumn("_new", (F.col("_open") % 2 == 0).cast("int"))
    d = running(d, "_new", "_r").withColumn("_r", F.col("_r") + F.col("_new"))
    parts = F.array_sort(F.collect_list(F.struct(number, text)))
    return d.groupBy(file, "_r").agg(F.min(number).alias(number), parts.alias("_p")).select(
        file, number, F.array_join(F.transform("_p", lambda p: p[text]), "\n").alias(text)
    )


def physical_lines(records: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """(file, number, text): the lines a file of these records has, numbered in their order; number grows by LINES a record."""
    d = records.select(file, (F.col(number).cast("bigint") * LINES).alias(number), F.col(text).alias("_t"))
    return d.select(file, number, F.posexplode(F.split("_t", "\n")).alias("_p", text)).select(file, (F.col(number) + F.col("_p")).alias(number), text)


def whole_on_its_own(text: str) -> Column:
    """Whether a file can give this record back: its quotes are paired and no line end lies outside them."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return ~bare.contains('"') & ~bare.contains("\n")


def _one_line(record: str) -> tuple[str, str]:
    """The record as one line for the reader, and the characters that stand for \\n and \\r.

    The reader ends a record at a line end outside quotes.  Where the record
    comes whole such a line end belongs to its field, so each is replaced by a
    character that the record doesn't have.
    """
    if "\n" not in record and "\r" not in record:
        return record, ""
    a, b = itertools.islice((c for c in map(chr, range(0xE000, 0x110000)) if c not in record), 2)
    return record.replace("\n", a).replace("\r", b), a + b


def fields(record: str | None) -> list[str]:
    """The fields of one record by Python's strict reader; BrokenQuotes or WrongWidth when the structure fails.

    The reader lets a quote pass inside an unquoted field, so the fields are laid
    over the raw record once more: a field that opens with a quote must be there
    in its quoted form, any other must hold no quote.
    """
    if not record:
        raise WrongWidth("no fields")
    raw, ends = _one_line(record)
    try:
        row = next(csv.reader([raw], strict=True))
    except csv.Error as e:
        raise BrokenQuotes(str(e)) from None
    if '"' in raw:
        at = 0
        for f in row:
            if raw.startswith('"', at):
                at += len(f) + f.count('"') + 3
            elif '"' in f:
                raise BrokenQuotes("quote inside an unquoted field")
            else:
                at += len(f) + 1
    if len(row) != len(FIELDS):
        raise WrongWidth(f"{len(row)} fields")
    return [f.replace(ends[0], "\n").replace(ends[1], "\r") for f in row] if ends else row


_digits10, _digits6 = re.compile(r"[0-9]{10}"), re.compile(r"[0-9]{6}")
_number = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?")


def _within(text: str, low: int, high: int) -> bool:
    return bool(_number.fullmatch(text)) and low <= Decimal(text) <= high


def reasons(record: str | None) -> tuple[list[str], list[str] | None]:
    """(reasons, fields): fields are trimmed where they are typed, and null when the structure is broken."""
    try:
        row = fields(record)
    except BrokenQuotes:
        return ["comillas"], None
    except WrongWidth:
        return ["columnas"], None
    for k in (0, 2, 4, 5):
        row[k] = row[k].strip()
    checks = (
        ("id", _digits10.fullmatch(row[0])),
        ("codigo_act", _digits6.fullmatch(row[2])),
        ("latitud", _within(row[4], 14, 33)),
        ("longitud", _within(row[5], -119, -86)),
    )
    return [name for name, good in checks if not good], row


def _parse(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    kind = pa.list_(pa.string())
    for b in batches:
        got = [reasons(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
        rest = [b.column(k) for k in range(b.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], kind)], names=[*b.schema.names, "motivos", "campos"])


def parsed(lines: DataFrame, text: str = "linea") -> DataFrame:
    """``lines`` with ``motivos`` (why the record is unusable, empty when it loads) and ``campos``.

    Narrow: one pass over the records in Arrow batches, no shuffle.  A null or
    empty record has no fields (``columnas``).
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in lines.dtypes), f"motivos {PARSED}", f"campos {PARSED}"])
    return lines.mapInArrow(lambda it: _parse(it, text), schema)


def parsed_file(lines: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """``parsed`` for the physical lines of files: records are assembled first."""
    return parsed(assemble(lines, file, number, text), text)


def reassembled(records: DataFrame, file: str = "archivo", number: str = "linea_no", text: str = "linea") -> DataFrame:
    """(file, number, text): records cut into physical lines and assembled again; those that no file can give back are left out."""
    lines = physical_lines(records.filter(whole_on_its_own(text)), file, number, text)
    return assemble(lines, file, number, text, block=100_000 * LINES).select(file, F.floor(F.col(number) / LINES).cast(dict(records.dtypes)[number]).alias(number), text)


def rejected(lines: DataFrame, key: str = "linea_id", text: str = "linea") -> DataFrame:
    """(key, motivo): one row per reason of each unusable record."""
    return parsed(lines.select(key, text), text).select(key, F.explode("motivos").alias("motivo"))


def loaded(lines: DataFrame, text: str = "linea") -> DataFrame:
    """The usable records as typed rows beside the other columns of the line.

    A column of the line that has the name of a field or of a result of
    ``parsed`` gives way.
    """
    kinds = {"latitud": "double", "longitud": "double"}
    names = [c for c in lines.columns if c != text and c.lower() not in (*FIELDS, "motivos", "campos")]
    good = parsed(lines.select(*names, text), text).filter(F.size("motivos") == 0)
    return good.select(*names, *(F.col("campos")[k].cast(kinds.get(f, "string")).alias(f) for k, f in enumerate(FIELDS)))
