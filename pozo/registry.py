"""Registered queries: every report over the driver's tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables. Decimal
amounts are cast to DOUBLE at this edge only, to compare with the oracle.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pozo import plans
from pozo.operators.names import Exact
from pozo.operators.tables import page_rows, search_rows, sort_rows, table_order
from pozo.params import Params
from pozo.sources import adapter

# The driver's orders end in August 2001: the dues report is for that year.
REPORT_PARAMS = Params(year=2001)
CALENDAR_PARAMS = Params(year=2001, target_mode="calendar")
# Month reports "as of" the end of June 2001 (the data's last month is nearly empty).
AS_OF = _dt.date(2001, 6, 30)
ASOF_PARAMS = Params(as_of=AS_OF)         # dues as they stood on that day (year 2001)
SEARCH_QUERY = "25"
DUES_SEARCH_QUERY = "-9"                  # balances (or other numbers) starting with -9
SORT_SPEC = ("cantidad_aportes", True)   # column, descending
PAGE_SPEC = (3, 10)                       # page, page size (by total, largest first)
EXPENSE_PAGE_SPEC = (2, 10)               # page, page size of the expense list
DEEP_PAGE_SPEC = (5500, 10)               # a page far down the same list


def as_doubles(df: DataFrame) -> DataFrame:
    """Cast decimal columns to DOUBLE, keep every other column."""
    x = Exact(df)
    return x.named(x.df.select(*[x.at(i).cast("double") if isinstance(t, T.DecimalType) else x.at(i)
                                 for i, t in enumerate(x.types)]))


class Inputs:
    """The four inputs for one data folder: lazy DataFrames, defined on first use.

    Every query defines its own, so files that arrive between two queries of a
    session are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def aportes(self) -> DataFrame:
        return adapter.aportes(self.spark, self.sf_dir)

    @cached_property
    def keyed(self):
        """The ledger as payments by customer key + customer names (eager aggregation)."""
        return adapter.aportes_keyed(self.spark, self.sf_dir)

    @cached_property
    def miembros(self) -> DataFrame:
        return adapter.miembros(self.spark, self.sf_dir)

    @cached_property
    def gastos(self) -> DataFrame:
        return adapter.gastos(self.spark, self.sf_dir)

    @cached_property
    def multas(self) -> DataFrame:
        return adapter.multas(self.spark, self.sf_dir)


# The member whose detail the expanded row shows (its title-cased name).
EXPAND_MEMBER = "Customer#000000001"


def _q(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_doubles(fn(Inputs(spark, sf_dir)))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _pages(i: Inputs) -> DataFrame:
    p = plans.member_pages(i.keyed, page_size=REPORT_PARAMS.page_size)
    text = F.transform("data", lambda x: F.concat_ws(
        "|", x["pos"].cast("string"), x["fecha"].cast("string"),
        x["aporte"].cast("string"), x["concepto"]))
    return p.select("miembro", "pagina", "filas", F.array_join(text, ";").alias("detalle"))


def _table_page(i: Inputs) -> DataFrame:
    s = plans.member_summary(i.keyed)
    page, size = PAGE_SPEC
    return page_rows(s, table_order(s, "total", True, ["miembro"]), page, size).select(
        "pos", "miembro", "cantidad_aportes", "total")


def _table_sort(i: Inputs) -> DataFrame:
    by, desc = SORT_SPEC
    s = plans.member_summary(i.keyed)
    return sort_rows(s, by, desc, ["miembro"]).select("pos", "miembro", "cantidad_aportes", "total")


def _label_order(df: DataFrame, label) -> DataFrame:
    return plans.label_order(df, "fecha", label)


def _build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pozo.functions.dates import day_label, month_label
    from pozo.functions.text import title_case

    P = REPORT_PARAMS
    defs: dict[str, Callable[[Inputs], DataFrame]] = {
        "q_ledger_prep": lambda i: i.aportes.select("miembro", "fecha", "aporte", "concepto"),
        "q_member_summary": lambda i: plans.member_summary(i.keyed),
        "q_member_detail": lambda i: plans.member_detail(i.keyed),
        "q_member_pages": _pages,
        "q_current_month": lambda i: plans.member_summary(i.keyed, "current_month"),
        "q_last_month": lambda i: plans.member_summary(i.keyed, "last_month"),
        "q_last_month_asof": lambda i: plans.member_summary(i.keyed, "last_month", as_of=AS_OF),
        "q_last_month_detail": lambda i: plans.member_detail(i.keyed, "last_month"),
        "q_current_month_detail": lambda i: plans.member_detail(i.keyed, "current_month"),
        "q_expand_member": lambda i: plans.expand_member(i.aportes, EXPAND_MEMBER),
        "q_headline_kpis": lambda i: plans.headline_kpis(i.keyed, i.gastos),
        "q_formatted_kpis": lambda i: plans.formatted_kpis(i.keyed, i.gastos),
        "q_kpis_asof": lambda i: plans.formatted_kpis(i.keyed, i.gastos, AS_OF, keep_values=True),
        "q_date_labels": lambda i: plans.date_labels(i.keyed),
        "q_label_order": lambda i: _label_order(i.keyed, day_label),
        "q_expense_label_order": lambda i: _label_order(i.gastos, month_label),
        "q_title_case": lambda i: i.miembros.select(
            "nombre_pago", title_case("nombre_pago").alias("miembro")),
        "q_category_pivot": lambda i: plans.category_pivot(i.keyed, P),
        "q_year_dues": lambda i: plans.year_dues(i.keyed, i.miembros, P),
        "q_year_dues_calendar": lambda i: plans.year_dues(i.keyed, i.miembros, CALENDAR_PARAMS),
        "q_year_dues_asof": lambda i: plans.year_dues(i.keyed, i.miembros, ASOF_PARAMS),
        "q_debt_band": lambda i: plans.debt_band(plans.year_dues(i.keyed, i.miembros, P), P)
            .select("miembro", "balance", "banda"),
        "q_member_status": lambda i: plans.member_status(i.keyed, i.miembros, P),
        "q_expense_list": lambda i: plans.expense_list(i.gastos),
        "q_expense_page": lambda i: plans.expense_page(i.gastos, *EXPENSE_PAGE_SPEC),
        "q_expense_page_deep": lambda i: plans.expense_page(i.gastos, *DEEP_PAGE_SPEC),
        "q_fines_list": lambda i: plans.fines_list(i.multas),
        "q_member_directory": lambda i: plans.member_directory(i.miembros),
        "q_member_cards": lambda i: plans.member_cards(i.miembros),
        "q_table_search": lambda i: search_rows(plans.member_summary(i.keyed), SEARCH_QUERY),
        "q_dues_search": lambda i: search_rows(plans.year_dues(i.keyed, i.miembros, P), DUES_SEARCH_QUERY),
        "q_table_sort": _table_sort,
        "q_table_page": _table_page,
        "q_balance_timeline": lambda i: plans.balance_timeline(i.keyed, i.gastos),
        "q_balance_snapshots": lambda i: plans.balance_snapshots(
            i.keyed, i.gastos, i.gastos.select(F.last_day("fecha"))),
    }
    out = {}
    for k, fn in defs.items():
        fn.__name__ = k
        out[k] = _q(fn)
    return out


QUERIES = _build()
