"""Readers for the four input tables and their light cleaning.

The original inputs were spreadsheet sheets; here they arrive as Parquet,
CSV or JSON files. Columns are matched by name. CSV and JSON cells are read as
text and parsed by strict grammars (:mod:`pozo.sources.strict`), with or without
a declared schema: a cell that is not written as declared fails the query or, by
``split_rejects``, puts its row among the rejects.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T

from pozo.functions.text import title_case
from pozo.sources import schemas
from pozo.sources.strict import MALFORMED, Formats, conform, split_rejects


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", formats: Formats = Formats(), **options) -> DataFrame:
    """Read one input table. CSV defaults to a header row.

    Without ``schema``, CSV and JSON columns are text under their header names, for
    the ``prepare_*`` functions. With ``schema``, they are matched by name (exact,
    else as :func:`clean_name` writes it; by position in a CSV without header) and
    given the declared types as ``prepare_*`` would: both ways read a cell alike.
    Lines with too many or too few cells, or that are no JSON, arrive in the column
    ``linea_malformada``. A CSV file whose header differs from the first one's raises.
    JSON without a schema takes one pass over the input to find its keys.
    """
    if fmt == "csv":
        options.setdefault("header", "true")
        header = str(options["header"]).lower() == "true"
        names = spark.read.format(fmt).options(**options).load(path).columns
        # Every cell counts towards a line's length, also those no query asks for.
        options.setdefault("columnPruning", "false")
        if header and not any(re.fullmatch(r"_c\d+", n) for n in names):
            options.setdefault("enforceSchema", "false")
        df = _text_reader(spark, fmt, names, options).load(path)
        if schema is not None and not header and len(names) >= len(schema.fields):
            df = df.toDF(*[f.name for f in schema.fields], *df.columns[len(schema.fields):])
    elif fmt == "json":
        if schema is not None:
            df = _text_reader(spark, fmt, [f.name for f in schema.fields], options).load(path)
        else:
            df = (spark.read.format(fmt).options(primitivesAsString="true", columnNameOfCorruptRecord=MALFORMED, **options)
                  .load(path))
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    if schema is None:
        return df
    # Only optional columns may be missing.
    wanted = {clean_name(f.name): f.name for f in schema.fields}
    for c in df.columns:
        to = wanted.get(clean_name(c))
        if to and to not in df.columns:
            df = df.withColumnRenamed(c, to)
    require(df.columns, schema)
    return conform(df, schema, formats)


def _text_reader(spark: SparkSession, fmt: str, names: list[str], options: dict) -> DataFrameReader:
    fields = [T.StructField(n, T.StringType()) for n in [*names, MALFORMED]]
    return (spark.read.format(fmt).schema(T.StructType(fields))
            .options(mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, **options))


# -- column-name normalisation --------------------------------------------

# Symbol words used when normalising column names, and the
# quote characters that are dropped rather than turned into separators.
_SYMBOL_WORDS = {"%": "percent", "#": "number"}
_DROPPED = ("'", '"')


def clean_name(name: str) -> str:
    """One column name in snake_case ASCII ("Monto Total" -> "monto_total")."""
    s = name
    for q in _DROPPED:
        s = s.replace(q, "")
    for sym, word in _SYMBOL_WORDS.items():
        s = s.replace(sym, f"_{word}_")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)      # camelCase boundary
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)   # ABCWord boundary
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`clean_name`; repeats get ``_2``, ``_3``.

    Metadata only: no job runs.
    """
    seen: dict[str, int] = {}
    out: list[str] = []
    for c in df.columns:
        base = name = clean_name(c)
        while name in out:     # "a, A, a_2": a suffix may meet a name already there
            seen[base] = seen.get(base, 1) + 1
            name = f"{base}_{seen[base]}"
        out.append(name)
    return df if out == df.columns else df.toDF(*out)


# -- per-table preparation ---------------------------------------------------

# Columns that a member table may lack; any other missing column is an error.
OPTIONAL = ("nombre", "avatar_img")


def require(have, schema: T.StructType, skip: tuple = OPTIONAL) -> None:
    """Raise when a declared column is missing: a misspelt header must not read as NULL."""
    missing = [f.name for f in schema.fields if f.name not in have and f.name not in skip]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}; the table has {', '.join(have)}")


def _named(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` under the declared column names."""
    if schema is schemas.MULTAS:
        wanted = {f.name.lower(): f.name for f in schema.fields}
        for c in df.columns:
            to = wanted.get(c.lower())
            if to and c != to and to not in df.columns:
                df = df.withColumnRenamed(c, to)
    elif schema is not schemas.MIEMBROS:
        df = clean_names(df)
    require(df.columns, schema)
    return df


def _conform(df: DataFrame, schema: T.StructType, formats: Formats) -> DataFrame:
    df = _named(df, schema)
    if [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]:
        return df   # already the declared shape
    return conform(df, schema, formats)


def prepare_ledger(df: DataFrame, title_case_members: bool = True, formats: Formats = Formats()) -> DataFrame:
    """Payments: dates as DATE, amounts as decimal, member names title-cased."""
    out = _conform(df, schemas.APORTES, formats)
    if title_case_members:
        out = out.withColumn("miembro", title_case("miembro"))
    return out


def prepare_expenses(df: DataFrame, formats: Formats = Formats()) -> DataFrame:
    """Expenses: names normalised, dates as DATE."""
    return _conform(df, schemas.GASTOS, formats)


def prepare_fines(df: DataFrame, formats: Formats = Formats()) -> DataFrame:
    """Receivables: the four published columns; headers match whatever their case."""
    return _conform(df, schemas.MULTAS, formats)


def prepare_members(df: DataFrame, formats: Formats = Formats()) -> DataFrame:
    """Member directory: start date as DATE; names are not normalised."""
    return _conform(df, schemas.MIEMBROS, formats)


# Per input: its declared schema and its preparation.
INPUTS = {"ledger": (schemas.APORTES, prepare_ledger), "expenses": (schemas.GASTOS, prepare_expenses),
          "fines": (schemas.MULTAS, prepare_fines), "members": (schemas.MIEMBROS, prepare_members)}


def prepare_checked(kind: str, df: DataFrame, formats: Formats = Formats()) -> tuple[DataFrame, DataFrame]:
    """(prepared, rejected) of one input: ``ledger``, ``expenses``, ``fines`` or ``members``.

    Rows with a cell that is no amount or no date, and malformed lines, are
    rejected: they keep their columns as read, with the reason in ``motivo_rechazo``
    and the columns at fault in ``columnas_rechazo``. All others are prepared.
    """
    schema, prepare = INPUTS[kind]
    accepted, rejected = split_rejects(_named(df, schema), schema, formats)
    return prepare(accepted), rejected
