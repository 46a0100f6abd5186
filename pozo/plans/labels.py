"""Date labels and the order of label levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pozo.functions.dates import day_label, heading_label, month_label, tab_label
from pozo.sources.keyed import Ledger, counted


def date_labels(df: Ledger, date_col: str = "fecha") -> DataFrame:
    """Every distinct date with its Spanish labels.

    ``label_dia`` "05 sep 2023", ``label_mes`` "sep 2023", ``titulo``
    "05 de septiembre del 2023", ``pestana`` "Septiembre". One partial
    aggregate per task, so only distinct dates are shuffled. Of a keyed ledger
    payments without a payer are left out, as in the row-level join.
    """
    d = counted(df).where(F.col(date_col).isNotNull() & (F.col("_pz_w") > 0)).select(F.col(date_col).alias("fecha")).distinct()
    return d.select("fecha",
                    day_label("fecha").alias("label_dia"),
                    month_label("fecha").alias("label_mes"),
                    heading_label("fecha").alias("titulo"),
                    tab_label("fecha").alias("pestana"))


def label_order(df: Ledger, date_col: str = "fecha",
                label: Callable[[Column], Column] = day_label) -> DataFrame:
    """Levels of a date label ordered by the median date behind each label.

    Returns ``label``, ``mediana`` (median day number since 1970-01-01,
    halves kept) and ``orden`` (1-based; ties by label text). The median is
    exact: rows are counted per day first (a partial aggregate), and texts and
    medians, weighted by those counts, are built on day grain. The numbering
    runs over the label grain only, never over ledger rows.
    """
    days = (counted(df).where(F.col(date_col).isNotNull() & (F.col("_pz_w") > 0))
            .groupBy(F.col(date_col).alias("_day")).agg(F.sum("_pz_w").alias("_n")))
    per = (days.groupBy(label(F.col("_day")).alias("label"))
           .agg(F.percentile(F.unix_date("_day"), 0.5, F.col("_n")).cast("double").alias("mediana")))
    w = Window.orderBy(F.col("mediana").asc(), F.col("label").asc())
    return per.withColumn("orden", F.row_number().over(w).cast("long"))
