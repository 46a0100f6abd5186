"""Per-member summaries and ordered payment detail.

Three windows of the ledger are reported: all time, the latest month present
in the data, and the month before it. "Latest" is relative to the data (its
maximum date, NULL dates ignored), optionally capped by ``as_of``.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.functions.nulls import lenient_sum
from pozo.operators.ranking import numbered_parts, positions
from pozo.sources.keyed import KeyedLedger, Ledger, flat
from pozo.sources.ledger_store import capped, is_stored, latest_month, month_of_partition
from pozo.sources.schemas import TOTAL

WINDOWS = ("all", "current_month", "last_month")


def ledger_window(ledger: Ledger, window: str = "all",
                  as_of: _dt.date | None = None) -> Ledger:
    """Rows of the ledger in ``window`` (same input form as given).

    The month start of the latest date is a scalar subquery planned once and
    reused; the filter stays a plain predicate on every row (no join, no
    single-task window). On a stored ledger (:mod:`pozo.sources.ledger_store`)
    the bound comes from the folder names, checked in the latest folder alone,
    and prunes the year/month folders. For a keyed ledger the latest date is
    taken per payer key first, then over the keys that have a payer.
    """
    if window not in WINDOWS:
        raise ValueError(f"window must be one of {WINDOWS}")
    led = capped(ledger, as_of)
    if window == "all":
        return led
    rows = led.payments if isinstance(led, KeyedLedger) else led
    if is_stored(rows):
        start = F.lit(latest_month(ledger, as_of)).cast("date")
    elif isinstance(led, KeyedLedger):
        latest = led.name(led.payments.groupBy(led.key).agg(F.max("fecha").alias("_pz_max")))
        start = latest.select(F.trunc(F.max("_pz_max"), "month")).scalar()
    else:
        start = led.select(F.trunc(F.max("fecha"), "month")).scalar()
    lo = start if window == "current_month" else F.add_months(start, -1)
    cond = F.col("fecha") >= lo
    if window == "last_month":
        cond = cond & (F.col("fecha") < start)
    if is_stored(rows):
        # The same bounds on the partition columns: only those month folders are listed.
        part = month_of_partition()
        cond = cond & (part >= lo) & ((part < start) if window == "last_month" else F.lit(True))
    return led.where(cond)


def member_summary(ledger: Ledger, window: str = "all",
                   as_of: _dt.date | None = None) -> DataFrame:
    """One row per member: payment count and total (NULL amounts ignored).

    ``cantidad_aportes`` counts rows, NULL amounts included. Sorted by total,
    largest first, then by member so ties are stable. A member holding a large
    share of rows is still one partial aggregate per task. A keyed ledger is
    summed per payer key before names are attached (eager aggregation).
    """
    led = ledger_window(ledger, window, as_of)
    if isinstance(led, KeyedLedger):
        parts = led.payments.groupBy(led.key).agg(F.count(F.lit(1)).alias("_pz_n"),
                                                  F.sum("aporte").alias("_pz_s"))
        out = led.name(parts).groupBy("miembro").agg(
            F.sum("_pz_n").alias("cantidad_aportes"),
            F.coalesce(F.sum("_pz_s"), F.lit(0)).cast(TOTAL).alias("total"))
    else:
        out = led.groupBy("miembro").agg(F.count(F.lit(1)).alias("cantidad_aportes"),
                                         lenient_sum("aporte").alias("total"))
    return out.orderBy(F.col("total").desc_nulls_last(), F.col("miembro").asc_nulls_first())


def _detail_fields(window: str) -> list[str]:
    # The month-before table shows no category, as published.
    return ["fecha", "aporte"] if window == "last_month" else ["fecha", "aporte", "concepto"]


def _numbered(rows: DataFrame, window: str) -> DataFrame:
    fields = _detail_fields(window)
    order = [F.col(c).desc_nulls_last() for c in fields]
    return (positions(rows.select("miembro", *fields), order, keys=["miembro"], name="pos")
            .select("miembro", "pos", *fields))


def _numbered_parts(led: Ledger, window: str) -> list[DataFrame]:
    """Detail rows numbered per member, as parts (see ``numbered_parts``).

    A keyed ledger whose payers are one-to-one is numbered per payer key:
    the rows are shuffled once, by key, and the names join the numbered rows
    on that same key, so no second shuffle of the payments follows. Payers that
    are split over tasks get their names from a broadcast of those few names.
    Otherwise names are attached first and rows are numbered per name.
    """
    fields = _detail_fields(window)
    order = [F.col(c).desc_nulls_last() for c in fields]
    if isinstance(led, KeyedLedger) and led.one_to_one():
        rows = led.payments.select(led.key, *fields)
        parts = numbered_parts(rows, order, keys=[led.key], name="pos")
        return [led.name(p.rows, p.hot).select("miembro", "pos", *fields) for p in parts]
    rows = flat(led).select("miembro", *fields)
    return [p.rows.select("miembro", "pos", *fields)
            for p in numbered_parts(rows, order, keys=["miembro"], name="pos")]


def member_detail(ledger: Ledger, window: str = "all",
                  as_of: _dt.date | None = None) -> DataFrame:
    """Every payment with its 1-based position in the member's list.

    The list is newest first; same-day payments are ordered by amount, then
    category, descending. Positions come from :func:`positions`, which splits
    a hot member across tasks instead of sorting it in one.
    """
    parts = _numbered_parts(ledger_window(ledger, window, as_of), window)
    return reduce(lambda a, b: a.unionByName(b), parts)


def expand_member(ledger: Ledger, miembro: str | None, window: str = "all",
                  as_of: _dt.date | None = None) -> DataFrame:
    """The detail behind one summary row, looked up by member key (not by row index).

    The month bounds still come from the whole ledger; the key filter then
    reaches the scan, so the numbering only carries that member's rows.
    """
    key = F.col("miembro").isNull() if miembro is None else (F.col("miembro") == F.lit(miembro))
    return _numbered(flat(ledger_window(ledger, window, as_of)).where(key), window)


def member_pages(ledger: Ledger, window: str = "all", page_size: int = 10,
                 as_of: _dt.date | None = None) -> DataFrame:
    """The nested detail, one row per (member, page) of ``page_size`` payments.

    ``data`` is the page's payments, newest first, as an array of structs. A
    group never holds more than ``page_size`` rows, so a member with millions
    of payments is spread over many small groups and no row is left out.
    """
    fields = _detail_fields(window)
    page = (F.floor((F.col("pos") - 1) / page_size) + 1).cast("int")

    def group(part: DataFrame, key: str) -> DataFrame:
        return (part.withColumn("pagina", page).groupBy(key, "pagina")
                .agg(F.count(F.lit(1)).alias("filas"),
                     F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("data")))

    # Pages are grouped inside each part of the numbering: a member is wholly
    # in one part, and the part of ordinary members is already partitioned by
    # its key, so grouping it into pages needs no second shuffle. For a
    # one-to-one keyed ledger, pages are grouped by payer key and the names
    # join the page rows, not the payments.
    led = ledger_window(ledger, window, as_of)
    if isinstance(led, KeyedLedger) and led.one_to_one():
        order = [F.col(c).desc_nulls_last() for c in fields]
        parts = numbered_parts(led.payments.select(led.key, *fields), order, keys=[led.key], name="pos")
        pages = [led.name(group(p.rows, led.key), p.hot).select("miembro", "pagina", "filas", "data") for p in parts]
    else:
        pages = [group(p, "miembro") for p in _numbered_parts(led, window)]
    return reduce(lambda a, b: a.unionByName(b), pages)
