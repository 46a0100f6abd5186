"""Running balance by day: the dated snapshots the published page kept."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pozo.functions.dates import heading_label, tab_label
from pozo.functions.text import format_amount
from pozo.sources.keyed import Ledger, counted
from pozo.sources.schemas import TOTAL


def balance_timeline(ledger: Ledger, expenses: DataFrame) -> DataFrame:
    """Per day with any flow: day totals and running income, expense, balance.

    Payments and expenses are summed per day (partial sums per task, then one
    shuffle of day-grain rows). The running sum then works on one row per
    calendar day, a size bounded by the dates in the data, not by the number of
    payments. Flows without a date come first, as one opening row with a NULL
    ``fecha``: the last balance is the headline balance.
    """
    none = F.lit(None).cast(TOTAL)
    # A payment counts once per payer of its key; names are not needed.
    income = (counted(ledger).where("_pz_w > 0").groupBy("fecha", "_pz_w").agg(F.sum("aporte").alias("_s"))
              .select("fecha", (F.col("_s") * F.col("_pz_w")).cast(TOTAL).alias("ingreso"), none.alias("gasto")))
    spent = expenses.groupBy("fecha").agg(F.sum("monto").cast(TOTAL).alias("gasto")).select("fecha", none.alias("ingreso"), "gasto")
    per_day = income.unionByName(spent).groupBy("fecha").agg(
        F.coalesce(F.sum("ingreso"), F.lit(0)).alias("ingreso_dia"),
        F.coalesce(F.sum("gasto"), F.lit(0)).alias("gasto_dia"))
    w = Window.orderBy(F.col("fecha").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (per_day
            .withColumn("ingreso", F.sum("ingreso_dia").over(w))
            .withColumn("gasto", F.sum("gasto_dia").over(w))
            .withColumn("balance", F.col("ingreso") - F.col("gasto"))
            .orderBy(F.col("fecha").asc_nulls_first()))


def balance_snapshots(ledger: Ledger, expenses: DataFrame, dates: DataFrame | Sequence[_dt.date]) -> DataFrame:
    """The page heading's figures as they stood on given days, one row per day asked for.

    ``dates`` is a list of days or a one-column frame (repeats and NULLs fall away).
    Columns: ``corte`` (the day asked for), ``fecha`` (latest day with a flow at or
    before it; NULL if there is none), running ``ingreso``, ``gasto``, ``balance``, and
    the heading, tab and badge texts. Flows without a date are in every snapshot,
    as the timeline's opening row.

    An as-of join on day grain: the days asked for are sorted in among the days of
    the running balance, and each takes the last figures before it.
    """
    days = balance_timeline(ledger, expenses)
    if not isinstance(dates, DataFrame):
        dates = days.sparkSession.createDataFrame([(d,) for d in dates], "corte date")
    asked = dates.toDF("corte").select(F.col("corte").cast("date")).where("corte IS NOT NULL").distinct()
    figures = ["ingreso", "gasto", "balance"]
    types = dict(days.dtypes)
    both = (days.select(F.col("fecha").alias("_at"), F.lit(0).alias("_kind"), "fecha", *figures)
            .unionByName(asked.select(F.col("corte").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("date").alias("fecha"),
                                      *[F.lit(None).cast(types[c]).alias(c) for c in figures])))
    w = Window.orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.select("_at", "_kind", F.last("fecha", ignorenulls=True).over(w).alias("fecha"),
                      *[F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0).cast(types[c])).alias(c) for c in figures])
    return (out.where("_kind = 1")
            .select(F.col("_at").alias("corte"), "fecha", *figures, heading_label("fecha").alias("titulo"),
                    tab_label("fecha").alias("pestana"), *[format_amount(c).alias(f"{c}_txt") for c in figures])
            .orderBy("corte"))
