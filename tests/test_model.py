"""Spark reports against a plain-Python model of the original rules.

The model follows the published script step by step on small random ledgers
(NULL amounts, NULL dates, guests, NULL keys, inactive or unknown members),
independently of the SQL oracle.
"""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pozo import plans
from pozo.params import Params
from pozo.sources import schemas

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
YEAR = 2023
P = Params(year=YEAR)

names = st.sampled_from(["Ana", "Bo", "Cy", "Invitados", None])
dates = st.one_of(st.none(), st.dates(min_value=dt.date(2022, 10, 1), max_value=dt.date(2023, 6, 30)))
amounts = st.one_of(st.none(), st.integers(min_value=0, max_value=900))
ledger_rows = st.lists(st.tuples(dates, names, amounts, st.sampled_from(["Aporte", "Técnica", "Otro"])),
                       min_size=0, max_size=25)
member_rows = st.lists(st.tuples(st.sampled_from(["Ana", "Bo", "Cy", "Di", None]),
                                 st.sampled_from(["Activo", "Inactivo", None]),
                                 st.one_of(st.none(), st.dates(min_value=dt.date(2022, 1, 1),
                                                               max_value=dt.date(2023, 12, 1)))),
                       min_size=0, max_size=5, unique_by=lambda r: r[0])


def _dec(v):
    return None if v is None else Decimal(v).quantize(Decimal("0.01"))


def model_summary(rows, window):
    dated = [r for r in rows if r[0] is not None]
    if window != "all":
        if not dated:
            return {}
        last = max(r[0] for r in dated)
        start = last.replace(day=1)
        prev = (start.replace(year=start.year - 1, month=12) if start.month == 1
                else start.replace(month=start.month - 1))
        lo, hi = (start, dt.date.max) if window == "current_month" else (prev, start)
        rows = [r for r in dated if lo <= r[0] < hi]
    out = {}
    for f, m, a, c in rows:
        n, t = out.get(m, (0, Decimal(0)))
        out[m] = (n + 1, t + (Decimal(a) if a is not None else 0))
    return {m: (n, _dec(t)) for m, (n, t) in out.items()}


def model_dues(rows, members, as_of=None, mode="month_only"):
    if as_of is not None:
        rows = [r for r in rows if r[0] is not None and r[0] <= as_of]
    ys = [r for r in rows if r[0] is not None and r[0].year == YEAR]
    nmonth = max((r[0].month for r in ys), default=None)
    cells = {}
    for f, m, a, c in ys:
        cells.setdefault((m, c), []).append(a)

    def strict(m, c):
        vals = cells.get((m, c))
        if vals is None or any(v is None for v in vals):
            return None
        return _dec(sum(vals))

    out = {}
    for name, cond, start in members:
        aporte = strict(name, "Aporte")
        aporte = aporte if aporte is not None else Decimal(0)
        if cond is None or cond == "Inactivo":
            target = Decimal(0)
        elif nmonth is None or start is None:
            target = None
        elif mode == "calendar":
            months = 0 if start.year > YEAR else max(0, nmonth - ((1 if start.year < YEAR else start.month) - 1))
            target = Decimal(months * 300)
        else:
            target = Decimal((nmonth - (start.month - 1)) * 300)
        if cond == "Inactivo":
            balance = Decimal(-300)
        else:
            balance = None if target is None else aporte - target
        band = None
        if balance is not None:
            band = "red" if balance < -900 else ("yellow" if balance < -300 else None)
        out[name] = (strict(name, "Técnica"), aporte, target, balance, band)
    return out


def _ledger(spark, rows):
    return spark.createDataFrame([(f, m, _dec(a), c) for f, m, a, c in rows], schemas.APORTES)


def _members(spark, rows):
    return spark.createDataFrame([(n, c, s, n, None) for n, c, s in rows], schemas.MIEMBROS)


def _dues(df):
    """A year without payments of a category has no column for it: its cells are NULL."""
    rows = [r.asDict() for r in df.collect()]
    return {r["miembro"]: (r.get("Técnica"), r["Aporte"], r["objetivo"], r["balance"], r["banda"]) for r in rows}


@SETTINGS
@given(rows=ledger_rows)
def test_summaries_follow_the_model(spark, rows):
    led = _ledger(spark, rows)
    for window in ("all", "current_month", "last_month"):
        got = {r["miembro"]: (r["cantidad_aportes"], r["total"])
               for r in plans.member_summary(led, window).collect()}
        assert got == model_summary(rows, window), window


@SETTINGS
@given(rows=ledger_rows, members=member_rows)
def test_dues_follow_the_model(spark, rows, members):
    got = _dues(plans.debt_band(plans.year_dues(_ledger(spark, rows), _members(spark, members), P), P))
    want = model_dues(rows, members)
    assert got == want


@SETTINGS
@given(rows=ledger_rows, members=member_rows,
       as_of=st.one_of(st.none(), st.dates(min_value=dt.date(2023, 1, 15), max_value=dt.date(2023, 6, 30))),
       mode=st.sampled_from(["month_only", "calendar"]))
def test_dues_options_follow_the_model(spark, rows, members, as_of, mode):
    p = Params(year=YEAR, as_of=as_of, target_mode=mode)
    got = _dues(plans.debt_band(plans.year_dues(_ledger(spark, rows), _members(spark, members), p), p))
    assert got == model_dues(rows, members, as_of, mode)
