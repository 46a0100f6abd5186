"""Headline figures: latest date, income, expense, balance."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.functions.dates import heading_label, tab_label
from pozo.functions.nulls import lenient_sum
from pozo.functions.text import format_amount
from pozo.sources.keyed import KeyedLedger, Ledger
from pozo.sources.ledger_store import capped
from pozo.sources.schemas import TOTAL


def headline_kpis(ledger: Ledger, expenses: DataFrame,
                  as_of: _dt.date | None = None) -> DataFrame:
    """One row: ``fecha_max``, ``ingreso``, ``gasto``, ``balance``.

    One-row aggregates (partial sums per task); the expense total enters as a
    scalar subquery. NULL amounts and NULL dates are ignored.
    """
    ledger, expenses = capped(ledger, as_of), capped(expenses, as_of)
    if isinstance(ledger, KeyedLedger):
        parts = ledger.payments.groupBy(ledger.key).agg(F.max("fecha").alias("_pz_m"),
                                                        F.sum("aporte").alias("_pz_s"))
        inc = ledger.name(parts).agg(F.max("_pz_m").alias("fecha_max"),
                                     F.coalesce(F.sum("_pz_s"), F.lit(0)).cast(TOTAL).alias("ingreso"))
    else:
        inc = ledger.agg(F.max("fecha").alias("fecha_max"), lenient_sum("aporte").alias("ingreso"))
    gasto = expenses.select(lenient_sum("monto")).scalar()
    return (inc.withColumn("gasto", gasto)
            .withColumn("balance", F.col("ingreso") - F.col("gasto")))


def formatted_kpis(ledger: Ledger, expenses: DataFrame,
                   as_of: _dt.date | None = None, keep_values: bool = False) -> DataFrame:
    """The page heading, tab label and the three badges as text.

    With ``keep_values`` the numeric KPIs stay alongside the text.
    """
    k = headline_kpis(ledger, expenses, as_of)
    return k.select(
        *(k.columns if keep_values else []),
        heading_label("fecha_max").alias("titulo"),
        tab_label("fecha_max").alias("pestana"),
        format_amount("ingreso").alias("ingreso_txt"),
        format_amount("gasto").alias("gasto_txt"),
        format_amount("balance").alias("balance_txt"),
    )
