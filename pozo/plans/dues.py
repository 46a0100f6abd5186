"""This year's dues: paid per category, target, balance, band and status."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pozo.functions.text import title_case
from pozo.operators.names import Exact, unique_names
from pozo.operators.pivot import category_names, matching, pivot_grain
from pozo.params import Params
from pozo.session import cut_lineage
from pozo.sources.keyed import KeyedLedger, Ledger
from pozo.sources.ledger_store import capped, is_stored
from pozo.sources.schemas import TOTAL

NAME_HINT = "; rename the category, or set Params(null_category=...) for payments without one"


def year_slice(ledger: Ledger, year: int) -> Ledger:
    """Ledger rows dated in ``year``, as a date range the scan can push down."""
    lo, hi = _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)
    cond = (F.col("fecha") >= F.lit(lo)) & (F.col("fecha") < F.lit(hi))
    rows = ledger.payments if isinstance(ledger, KeyedLedger) else ledger
    if is_stored(rows):
        cond = cond & (F.col("anio") == F.lit(year))   # prunes to one year's folders
    return ledger.where(cond)


@dataclass(frozen=True)
class DuesGrain:
    """The year's payments summed once: ``rows`` has one row per (member, category).

    Columns ``miembro``, ``concepto``, payments ``n``, those with an amount ``nn``,
    their sum ``s`` and the latest month ``m``. Every dues report can be given a
    grain in place of the ledger, so that several share one pass over it.
    """

    rows: DataFrame
    year: int
    as_of: _dt.date | None = None


def year_sums(ledger: Ledger, params: Params = Params()) -> DataFrame:
    """The year's payments summed per (member, category): the rows of a :class:`DuesGrain`.

    A keyed ledger is summed per payer key before names are attached. The sums
    merge: rows, non-NULL values and their total tell the strict sum.
    """
    y = year_slice(capped(ledger, params.as_of), params.report_year())
    sums = [F.count(F.lit(1)).alias("n"), F.count("aporte").alias("nn"), F.sum("aporte").alias("s"),
            F.max(F.month("fecha")).alias("m")]
    if isinstance(y, KeyedLedger):
        per_key = y.payments.groupBy(y.key, "concepto").agg(*sums)
        return y.name(per_key).groupBy("miembro", "concepto").agg(
            F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("s").cast(TOTAL).alias("s"), F.max("m").alias("m"))
    return y.groupBy("miembro", "concepto").agg(*sums)


def dues_grain(ledger: Ledger, params: Params = Params()) -> DuesGrain:
    """Read the year's payments once and keep their sums in the checkpoint folder."""
    return DuesGrain(cut_lineage(year_sums(ledger, params)), params.report_year(), params.as_of)


def _grain(ledger: Ledger | DuesGrain, params: Params) -> DuesGrain:
    if not isinstance(ledger, DuesGrain):
        return dues_grain(ledger, params)
    if (ledger.year, ledger.as_of) != (params.report_year(), params.as_of):
        raise ValueError("the sums given are of another year or day than the parameters ask for")
    return ledger


def _categories(g: DuesGrain, params: Params) -> tuple[tuple[str | None, ...], int | None]:
    """The year's categories (or those asked for) and its latest month with a payment.

    At most ``max_categories`` + 1 rows come to the driver; more categories raise
    an error instead of being left out.
    """
    if params.categories is not None:
        return tuple(params.categories), g.rows.agg(F.max("m")).first()[0]
    got = g.rows.groupBy("concepto").agg(F.max("m").alias("m")).limit(params.max_categories + 1).collect()
    if len(got) > params.max_categories:
        raise ValueError(f"more than {params.max_categories} categories in the year: name the ones to show "
                         "with Params(categories=...), or raise max_categories")
    names = {r["concepto"] for r in got if r["concepto"] is not None} | {params.dues_category}
    cats = (*sorted(names), *([None] if any(r["concepto"] is None for r in got) else []))
    return cats, max((r["m"] for r in got), default=None)


def _wide(g: DuesGrain, cats: Sequence[str | None]) -> DataFrame:
    # A member/category has one row: its strict sum, or NULL when an amount is missing.
    return pivot_grain(g.rows, "miembro", "concepto", F.when(F.col("nn") == F.col("n"), F.col("s")), cats)


def category_pivot(ledger: Ledger | DuesGrain, params: Params = Params()) -> DataFrame:
    """One row per member paying this year; one strict-sum column per category.

    A member/category cell is NULL when the member paid nothing in that
    category, or when any of those amounts is NULL. Categories are told apart
    letter for letter ("Aporte" beside "aporte"); a missing category is the
    column ``params.null_category``. A category that is named like that column
    or like the member column raises an error.
    """
    g = _grain(ledger, params)
    cats, _ = _categories(g, params)
    names = unique_names(["miembro", *category_names(cats, params.null_category)], NAME_HINT)
    return _wide(g, cats).toDF(*names)


def _active_months(nmonth: Column, start: Column, year: int, mode: str) -> Column:
    if mode == "month_only":
        # Published rule: only the start *month* counts, whatever its year.
        return nmonth - (F.month(start) - 1)
    if mode == "calendar":
        # Months from the later of the start date and January, never negative.
        # An unknown start or latest month stays unknown (greatest skips NULLs).
        first_month = F.when(F.year(start) < year, F.lit(1)).otherwise(F.month(start))
        return (F.when(start.isNull() | nmonth.isNull(), F.lit(None))
                 .when(F.year(start) > year, F.lit(0))
                 .otherwise(F.greatest(F.lit(0), nmonth - (first_month - 1))))
    raise ValueError("target_mode must be 'month_only' or 'calendar'")


def _dues_frame(g: DuesGrain, members: DataFrame, params: Params, cats: Sequence[str | None],
                nmonth: int | None) -> DataFrame:
    """Members left-joined with this year's category sums (``_c0``, ... as in ``cats``),
    plus ``condicion``, ``pagado`` (the dues), ``objetivo`` and ``balance``.

    The latest month with a payment this year is one value shared by every row.
    """
    piv = _wide(g, cats).withColumnRenamed("miembro", "_k")
    key = F.col("nombre_pago") if params.raw_member_keys else title_case("nombre_pago")
    m = members.select(key.alias("miembro"), "condicion", "fecha_inicio")
    j = m.join(piv, m["miembro"].eqNullSafe(piv["_k"]), "left").drop("_k")

    paid = F.col(f"_c{cats.index(params.dues_category)}") if params.dues_category in cats else F.lit(None).cast(TOTAL)
    cond = F.col("condicion")
    inactive = cond == F.lit(params.inactive_label)
    active_months = _active_months(F.lit(nmonth).cast("int"), F.col("fecha_inicio"), g.year, params.target_mode)
    target = F.when(cond.isNull() | inactive, F.lit(0)).otherwise(active_months * F.lit(params.dues))
    return (j.withColumn("pagado", F.coalesce(paid, F.lit(0)))
            .withColumn("objetivo", target)
            .withColumn("balance", F.when(inactive, F.lit(params.inactive_balance))
                        .otherwise(F.col("pagado") - F.col("objetivo"))))


def year_dues(ledger: Ledger | DuesGrain, members: DataFrame, params: Params = Params()) -> DataFrame:
    """Every registered member with this year's payments, target and balance.

    Columns: ``miembro``, the categories matching ``params.fine_pattern``,
    ``params.dues_category`` (NULL -> 0), ``objetivo``, ``balance``; sorted by
    balance, largest first. Payers missing from ``members`` are left out
    (the report starts from the member table). With ``params.as_of`` only
    payments up to that date count.

    A fine column exists when the year has a payment of that category (or
    ``params.categories`` names it): a year without any has no such column.
    Categories are told apart letter for letter. Categories called "objetivo" or
    "balance" are not shown, the computed columns are; one called "miembro" that
    matches the pattern raises an error.
    """
    g = _grain(ledger, params)
    cats, nmonth = _categories(g, params)
    names = category_names(cats, params.null_category)
    shown = set(matching(names, params.fine_pattern)) - {params.dues_category, "objetivo", "balance"}
    fines = [i for i, n in enumerate(names) if n in shown]
    out = unique_names(["miembro", *[names[i] for i in fines], params.dues_category, "objetivo", "balance"], NAME_HINT)
    return (_dues_frame(g, members, params, cats, nmonth)
            .select("miembro", *[f"_c{i}" for i in fines], "pagado", "objetivo", "balance")
            .orderBy(F.col("balance").desc_nulls_last(), F.col("miembro").asc_nulls_first()).toDF(*out))


def debt_band(dues: DataFrame, params: Params = Params()) -> DataFrame:
    """Add ``banda``: "red" below ``red_below``, "yellow" below ``yellow_below``.

    Strict comparisons: a balance of exactly -300 has no band. NULL -> NULL.
    """
    x = Exact(dues)
    b = x["balance"]
    band = (F.when(b < F.lit(params.red_below), F.lit("red"))
             .when(b < F.lit(params.yellow_below), F.lit("yellow")))
    return x.named(x.df.withColumn("_banda", band), "banda")


# Member status names from the league rules.
STATUS_ACTIVE, STATUS_INACTIVE, STATUS_ARREARS, STATUS_SUSPENDED = (
    "Activo", "Inactivo", "En atraso", "Suspendido")


def member_status(ledger: Ledger | DuesGrain, members: DataFrame, params: Params = Params()) -> DataFrame:
    """Status by the written rules, next to the dues balance.

    Owing one month's dues or more is "En atraso", three months or more is
    "Suspendido" (inclusive, unlike the colour bands); inactive members are
    "Inactivo". ``balance_tope`` caps the debt at three months' dues.
    """
    g = _grain(ledger, params)
    latest = g.rows.agg(F.max("m")).first()[0]
    d = _dues_frame(g, members, params, (params.dues_category,), latest)
    owed = -F.col("balance")
    three = params.dues * 3
    status = (F.when(F.col("condicion") == F.lit(params.inactive_label), F.lit(STATUS_INACTIVE))
               .when(owed >= F.lit(three), F.lit(STATUS_SUSPENDED))
               .when(owed >= F.lit(params.dues), F.lit(STATUS_ARREARS))
               .when(F.col("balance").isNotNull(), F.lit(STATUS_ACTIVE)))
    return d.select("miembro", "balance",
                    F.greatest(F.col("balance"), F.lit(-three)).alias("balance_tope"),
                    status.alias("estado"))
