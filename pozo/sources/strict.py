"""Text cells that must be amounts or dates: strict grammars, errors, rejected rows.

Sheets hold what people type: "12,50", "02/01/2023". A cell that is not written
in the declared way is never turned into another number or into NULL without a
word: either the query fails and names the cell, or the row goes to the rejects
with a reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of rejected rows: the reason in words and the columns at fault; and the
# column in which the readers hand over a malformed line.
REASON, FAULTS, MALFORMED = "motivo_rechazo", "columnas_rechazo", "linea_malformada"


@dataclass(frozen=True)
class Formats:
    """How amounts and dates are written in text columns.

    ``dates`` are Spark date patterns, tried in order; the ISO pattern also takes a
    time of day behind the date. Where two patterns fit one text the first counts.
    """

    decimal: str = "."
    thousands: str = ""
    dates: tuple[str, ...] = ("yyyy-MM-dd",)

    def __post_init__(self):
        if self.decimal == self.thousands or len(self.decimal) != 1 or len(self.thousands) > 1:
            raise ValueError("decimal and thousands marks are single, different characters")
        if not self.dates:
            raise ValueError("at least one date pattern is needed")


_ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_amount(c: Column, dtype: T.DecimalType, formats: Formats = Formats()) -> Column:
    """The amount a text cell holds, NULL when it holds none.

    A sign, digits (in groups of three if a thousands mark is declared and used),
    and at most as many decimals as the type keeps, trailing zeros apart: nothing
    is rounded.
    """
    d, t = re.escape(formats.decimal), re.escape(formats.thousands)
    whole = rf"(\d+|\d{{1,3}}({t}\d{{3}})+)" if formats.thousands else r"\d+"
    text = F.trim(c)
    plain = F.regexp_replace(text, t, "") if formats.thousands else text
    plain = F.regexp_replace(plain, d, ".") if formats.decimal != "." else plain
    return F.when(text.rlike(rf"^[+-]?{whole}({d}\d{{1,{dtype.scale}}}0*)?$"), plain.try_cast(dtype))


def parse_date(c: Column, formats: Formats = Formats()) -> Column:
    """The date a text cell holds, NULL when it holds none (30 February is none)."""
    text = F.trim(c)
    ways = [F.when(text.rlike(_ISO), F.substring(text, 1, 10).try_cast("date")) if p == "yyyy-MM-dd"
            else F.try_to_timestamp(text, F.lit(p)).cast("date") for p in formats.dates]
    return F.coalesce(*ways) if len(ways) > 1 else ways[0]


def _value(c: Column, source: T.DataType, target: T.DataType, formats: Formats) -> Column:
    """``c`` as the declared type; NULL where it cannot be."""
    if isinstance(target, T.StringType) or source == target:
        return c.cast(target)
    if isinstance(source, T.StringType):
        if isinstance(target, T.DateType):
            return parse_date(c, formats)
        if isinstance(target, T.DecimalType):
            return parse_amount(c, target, formats)
    if isinstance(target, T.DateType) and isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return c.cast(target)
    if isinstance(target, T.DateType) and not isinstance(source, (T.DateType, T.NullType)):
        return F.lit(None).cast(target)      # a number is no date
    # Binary floats are rounded to the declared scale; NaN and infinities are no amounts.
    return c.try_cast(target)


def _blank(c: Column, source: T.DataType) -> Column:
    """Whether a cell says nothing: NULL or, as text, blanks."""
    return c.isNull() | (F.trim(c) == "") if isinstance(source, T.StringType) else c.isNull()


def _cells(df: DataFrame, schema: T.StructType, formats: Formats):
    """Per declared column present: name, raw column, value, whether the cell is wrong."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name in have:
            raw, source = F.col(f"`{f.name}`"), have[f.name]
            value = _value(raw, source, f.dataType, formats)
            free = source == f.dataType or isinstance(f.dataType, T.StringType) or isinstance(source, T.NullType)
            yield f, raw, value, None if free else ~_blank(raw, source) & value.isNull()
        else:
            yield f, None, F.lit(None).cast(f.dataType), None


def _said(f: T.StructField, raw: Column) -> Column:
    kind = "a date" if isinstance(f.dataType, T.DateType) else "an amount"
    return F.concat(F.lit(f"{f.name}: "), F.to_json(F.struct(raw.cast("string").alias("celda"))), F.lit(f" is not {kind}"))


def reasons(df: DataFrame, schema: T.StructType, formats: Formats = Formats()) -> tuple[Column, Column]:
    """Why a row does not fit ``schema`` (NULL if it fits), and the columns at fault, comma-joined."""
    cells = [(f, raw, wrong) for f, raw, _, wrong in _cells(df, schema, formats) if wrong is not None]
    said = [F.when(wrong, _said(f, raw)) for f, raw, wrong in cells]
    names = [F.when(wrong, F.lit(f.name)) for f, _, wrong in cells]
    if MALFORMED in df.columns:
        line = F.col(MALFORMED).isNotNull()
        said.insert(0, F.when(line, F.concat(F.lit("malformed line: "), F.col(MALFORMED))))
        names.insert(0, F.when(line, F.lit("line")))
    text, at = F.concat_ws("; ", *said), F.concat_ws(",", *names)
    return F.when(at != "", text), F.when(at != "", at)


def conform(df: DataFrame, schema: T.StructType, formats: Formats = Formats()) -> DataFrame:
    """``df`` with the declared columns and types; a wrong cell fails the query that reads it, by name and text."""
    bad_line = F.col(MALFORMED).isNotNull() if MALFORMED in df.columns else None
    cols = []
    for f, raw, value, wrong in _cells(df, schema, formats):
        if wrong is not None:
            value = F.when(wrong, F.raise_error(_said(f, raw)).cast(f.dataType)).otherwise(value)
        if bad_line is not None:
            value = F.when(bad_line, F.raise_error(F.concat(F.lit("malformed line: "), F.col(MALFORMED)))
                           .cast(f.dataType)).otherwise(value)
        cols.append(value.alias(f.name))
    return df.select(*cols)


def split_rejects(df: DataFrame, schema: T.StructType, formats: Formats = Formats()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows that fit, with the declared types, and the others as read, with ``motivo_rechazo``.

    Every row of ``df`` is in exactly one of the two.
    """
    why, at = reasons(df, schema, formats)
    marked = df.withColumn(REASON, why).withColumn(FAULTS, at)
    values = [value.alias(f.name) for f, _, value, _ in _cells(df, schema, formats)]
    return marked.where(F.col(FAULTS).isNull()).select(*values), marked.where(F.col(FAULTS).isNotNull())


def count_rejects(rejected: DataFrame) -> DataFrame:
    """(columnas_rechazo, filas): rejected rows by the columns at fault."""
    return rejected.groupBy(FAULTS).agg(F.count("*").alias("filas"))
