"""Build every treasury report from the four inputs and write them out.

The counterpart of rendering the original page: one call computes each table
the page showed (and the ones it computed but did not show) and the sink
writes them from the executors. Nothing is collected to the driver.

    python -m pozo.publish --ledger PATH --expenses PATH --fines PATH \\
        --members PATH --out DIR [--format parquet|csv|json] [--year 2023]
"""

from __future__ import annotations

import argparse
import datetime as _dt
import os
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo import plans
from pozo.functions.dates import month_label
from pozo.params import Params
from pozo.plans.display import DUES_HEADINGS, SUMMARY_HEADINGS, display_names
from pozo.sources.readers import INPUTS, prepare_checked, read_table
from pozo.sources.ledger_store import capped, read_ledger, write_ledger
from pozo.sources.sinks import write_report
from pozo.sources.strict import FAULTS, Formats, count_rejects


def treasury_reports(ledger: DataFrame, expenses: DataFrame, fines: DataFrame,
                     members: DataFrame, params: Params = Params(),
                     cut_dates: DataFrame | Sequence[_dt.date] | None = None) -> dict[str, DataFrame]:
    """Every report, lazily: name -> DataFrame. Inputs must be prepared.

    ``cut_dates`` are the days of the balance snapshots; by default the last day
    of every month with a payment.

    With ``params.as_of`` all dated inputs are capped once, here, so that every
    report shows the same day; rows without a date are then left out of all.
    """
    ledger, expenses, fines = (capped(t, params.as_of) for t in (ledger, expenses, fines))
    # One pass over the year's payments for both dues reports.
    grain = plans.dues_grain(ledger, params)
    dues = plans.year_dues(grain, members, params)
    return {
        "kpis": plans.formatted_kpis(ledger, expenses, params.as_of, keep_values=True),
        "historico": plans.member_summary(ledger, "all", params.as_of),
        "historico_detalle": plans.member_pages(ledger, "all", params.page_size, params.as_of),
        "mes_actual": plans.member_summary(ledger, "current_month", params.as_of),
        "mes_actual_detalle": plans.member_pages(ledger, "current_month", params.page_size, params.as_of),
        "mes_anterior": plans.member_summary(ledger, "last_month", params.as_of),
        "mes_anterior_detalle": plans.member_pages(ledger, "last_month", params.page_size, params.as_of),
        "este_ano": plans.debt_band(dues, params),
        "estatus": plans.member_status(grain, members, params),
        "gastos": plans.expense_list(expenses),
        "multas": plans.fines_list(fines),
        "orden_fechas": plans.label_order(ledger),
        "orden_meses_gastos": plans.label_order(expenses, label=month_label),
        "etiquetas_fechas": plans.date_labels(ledger),
        "saldo_diario": plans.balance_timeline(ledger, expenses),
        "cortes": plans.balance_snapshots(ledger, expenses, snapshot_days(ledger, params) if cut_dates is None else cut_dates),
        "directorio": plans.member_directory(members),
        "tarjetas": plans.member_cards(members),
    }


def snapshot_days(ledger: DataFrame, params: Params) -> DataFrame:
    """The last day of every month with a payment, no later than ``as_of``."""
    day = F.last_day("fecha")
    return ledger.select((F.least(day, F.lit(params.as_of)) if params.as_of else day).alias("corte")).distinct()


HEADINGS = {"historico": SUMMARY_HEADINGS, "mes_actual": SUMMARY_HEADINGS, "mes_anterior": SUMMARY_HEADINGS,
            "este_ano": DUES_HEADINGS}


def publish(reports: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", headings: bool = False) -> list[str]:
    """Write each report under ``out_dir/<name>``; returns the written paths.

    With ``headings`` the summary and dues tables carry their display names.
    CSV cannot hold the nested pages: those are written as JSON lines.
    """
    paths = []
    for name, df in reports.items():
        if headings:
            df = display_names(df, HEADINGS.get(name, {}))
        path = os.path.join(out_dir, name)
        if fmt == "csv" and any(f.dataType.typeName() in ("array", "struct", "map")
                                for f in df.schema.fields):
            fmt_used = "json"   # nested pages do not fit in CSV
        else:
            fmt_used = fmt
        write_report(df, path, fmt=fmt_used)
        paths.append(path)
    return paths


def load_inputs(spark: SparkSession, ledger: str, expenses: str, fines: str, members: str,
                fmt: str = "parquet", formats: Formats = Formats()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Read and prepare the four inputs; a cell that does not fit fails the report that reads it."""
    paths = {"ledger": ledger, "expenses": expenses, "fines": fines, "members": members}
    return tuple(INPUTS[k][1](read_table(spark, p, fmt=fmt), formats=formats) for k, p in paths.items())


def load_checked(spark: SparkSession, paths: dict[str, str], rejects_dir: str, fmt: str = "parquet",
                 formats: Formats = Formats()) -> tuple[list[DataFrame], DataFrame]:
    """Read the four inputs and put rows that do not fit aside.

    Rejected rows are written as JSON lines to ``rejects_dir/<input>``, as read and
    with their reason. Returns the prepared inputs and the report
    (entrada, columnas_rechazo, filas), counted from what was written.
    """
    prepared, counts = [], []
    for kind, path in paths.items():
        accepted, rejected = prepare_checked(kind, read_table(spark, path, fmt=fmt), formats)
        target = os.path.join(rejects_dir, kind)
        write_report(rejected, target, fmt="json")
        back = spark.read.schema(f"{FAULTS} string").json(target)
        counts.append(count_rejects(back).select(F.lit(kind).alias("entrada"), FAULTS, "filas"))
        prepared.append(accepted)
    return prepared, reduce(lambda a, b: a.unionByName(b), counts)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("ledger", "expenses", "fines", "members", "out"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--input-format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--year", type=int, default=None)
    ap.add_argument("--as-of", type=_dt.date.fromisoformat, default=None)
    ap.add_argument("--target-mode", default="month_only", choices=["month_only", "calendar"])
    ap.add_argument("--dues", type=Decimal, default=Params.dues, help="monthly dues")
    ap.add_argument("--yellow-below", type=Decimal, default=Params.yellow_below, help="balance below which the band is yellow")
    ap.add_argument("--red-below", type=Decimal, default=Params.red_below, help="balance below which the band is red")
    ap.add_argument("--inactive-balance", type=Decimal, default=Params.inactive_balance, help="balance shown for inactive members")
    ap.add_argument("--inactive-label", default=Params.inactive_label, help="member condition that means paused")
    ap.add_argument("--dues-category", default=Params.dues_category, help="category that holds the dues")
    ap.add_argument("--fine-pattern", default=Params.fine_pattern, help="pattern of the categories shown beside the dues")
    ap.add_argument("--category", action="append", default=None,
                    help="a category to show, in this order (repeat; default: all of the year's)")
    ap.add_argument("--null-category", default=Params.null_category, help="column of payments without a category")
    ap.add_argument("--page-size", type=int, default=Params.page_size)
    ap.add_argument("--headings", action="store_true", help="display names on the summary and dues tables")
    ap.add_argument("--no-stage", action="store_true",
                    help="build every report from the raw inputs instead of the stored ledger")
    ap.add_argument("--cut", type=_dt.date.fromisoformat, action="append", default=None,
                    help="a day of the balance snapshots (repeat; default: the month ends)")
    ap.add_argument("--rejects", default=None, metavar="DIR",
                    help="write rows that do not fit there, and their number as report rechazos, instead of failing")
    ap.add_argument("--decimal", default=".", help="decimal mark of amounts in text")
    ap.add_argument("--thousands", default="", help="thousands mark of amounts in text")
    ap.add_argument("--date-pattern", action="append", default=None,
                    help="Spark pattern of dates in text (repeat; default yyyy-MM-dd)")
    a = ap.parse_args(argv)
    from pozo.session import build_session
    spark = build_session()
    formats = Formats(a.decimal, a.thousands, tuple(a.date_pattern or Formats.dates))
    paths = {"ledger": a.ledger, "expenses": a.expenses, "fines": a.fines, "members": a.members}
    rejected = None
    if a.rejects:
        (led, exp, fin, mem), rejected = load_checked(spark, paths, a.rejects, a.input_format, formats)
    else:
        led, exp, fin, mem = load_inputs(spark, **paths, fmt=a.input_format, formats=formats)
    if not a.no_stage:
        # Prepare the ledger once into a year/month-partitioned table; every
        # report then reads it (and prunes it) instead of re-reading the input.
        staged = os.path.join(a.out, "ledger_por_mes")
        write_ledger(led, staged)
        led = read_ledger(spark, staged)
    params = Params(year=a.year, as_of=a.as_of, target_mode=a.target_mode, dues=a.dues, page_size=a.page_size,
                    yellow_below=a.yellow_below, red_below=a.red_below, inactive_balance=a.inactive_balance,
                    inactive_label=a.inactive_label, dues_category=a.dues_category, fine_pattern=a.fine_pattern,
                    categories=tuple(a.category) if a.category else None, null_category=a.null_category)
    reports = treasury_reports(led, exp, fin, mem, params, a.cut)
    if rejected is not None:
        reports["rechazos"] = rejected
    publish(reports, a.out, a.format, a.headings)


if __name__ == "__main__":
    main()
