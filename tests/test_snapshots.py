"""Dated balances: undated flows, as-of snapshots; payments counted without names; months of a stored ledger."""

import calendar
import datetime as dt
import os
import re
import tempfile
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pozo import plans
from pozo.functions.dates import MONTHS_FULL_ES, month_label
from pozo.sources import keyed as keyed_module
from pozo.sources import schemas
from pozo.sources.keyed import KeyedLedger
from pozo.sources.ledger_store import latest_month, read_ledger, stored_months, write_ledger
from tests import golden

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
D = dt.date
days = st.one_of(st.none(), st.dates(min_value=D(2022, 11, 1), max_value=D(2023, 2, 28)))
amounts = st.one_of(st.none(), st.integers(-50, 500))


def _bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_undated_flows_open_the_balance(ledger, expenses):
    led = ledger([("2023-01-05", "A", 10, "Aporte"), (None, "A", 5, "Aporte"), ("2023-01-07", "B", None, "Aporte")])
    exp = expenses([("2023-01-06", "x", 1), (None, "y", 2)])
    rows = plans.balance_timeline(led, exp).collect()
    assert [(r["fecha"], r["balance"]) for r in rows] == [
        (None, 3), (D(2023, 1, 5), 13), (D(2023, 1, 6), 12), (D(2023, 1, 7), 12)]
    assert rows[-1]["balance"] == plans.headline_kpis(led, exp).first()["balance"]
    snaps = plans.balance_snapshots(led, exp, [D(2023, 1, 6), D(2022, 1, 1), D(2023, 1, 6), None, D(2030, 1, 1)]).collect()
    assert [(r["corte"], r["fecha"], r["balance"]) for r in snaps] == [
        (D(2022, 1, 1), None, 3), (D(2023, 1, 6), D(2023, 1, 6), 12), (D(2030, 1, 1), D(2023, 1, 7), 12)]
    none = plans.balance_snapshots(led.where("false"), exp.where("false"), [D(2023, 1, 1)]).first()
    assert (none["fecha"], none["ingreso"], none["balance"], none["balance_txt"]) == (None, 0, 0, "0")


@SETTINGS
@given(pay=st.lists(st.tuples(days, amounts), max_size=25), spent=st.lists(st.tuples(days, amounts), max_size=10),
       asked=st.lists(days, max_size=8))
def test_snapshots_equal_a_plain_sum(spark, pay, spent, asked):
    dec = lambda a: None if a is None else Decimal(a)
    led = spark.createDataFrame([(f, "A", dec(a), "x") for f, a in pay], schemas.APORTES)
    exp = spark.createDataFrame([(f, "x", dec(a)) for f, a in spent], schemas.GASTOS)
    got = {r["corte"]: (r["fecha"], r["ingreso"], r["gasto"], r["balance"]) for r in
           plans.balance_snapshots(led, exp, spark.createDataFrame([(d,) for d in asked], "d date")).collect()}
    want = {}
    for d in set(asked) - {None}:
        upto = lambda rows: [(f, a) for f, a in rows if f is None or f <= d]
        a, b = upto(pay), upto(spent)
        total = [sum(x or 0 for _, x in rows) for rows in (a, b)]
        want[d] = (max((f for f, _ in a + b if f is not None), default=None), *total, total[0] - total[1])
    assert got == want
    last = plans.balance_timeline(led, exp).collect()
    assert (last[-1]["balance"] if last else 0) == plans.headline_kpis(led, exp).first()["balance"]


# Some of the published page's figures (day, income, expense, balance).
PUBLISHED = [(D(2022, 12, 18), 12055, 6123, 5932), (D(2023, 1, 7), 13920, 7063, 6857), (D(2023, 1, 15), 15410, 8013, 7397),
             (D(2023, 10, 8), 65995, 58932, 7063), (D(2023, 10, 15), 68505, 60362, 8143), (D(2023, 12, 17), 71155, 64572, 6583)]


def _published():
    """All snapshots where the published pages are at hand."""
    if not golden.available():
        return PUBLISHED
    number = lambda t: int(t.replace(",", ""))
    month = lambda m: 1 + (MONTHS_FULL_ES.index(m) if m in MONTHS_FULL_ES else list(calendar.month_name).index(m) - 1)
    return [(D(int(y), month(m), int(d)), number(i), number(g), number(b)) for d, m, y, i, g, b, _ in golden.snapshots()]


def test_published_snapshots(spark):
    """Flows that lead from one published page to the next give every page's figures on its day."""
    by_day = {f: figures for f, *figures in sorted(_published())}     # the last page of a day
    flows, before = [], (0, 0)
    for f, (i, g, _) in sorted(by_day.items()):
        flows.append((f, Decimal(i - before[0]), Decimal(g - before[1])))
        before = (i, g)
    led = spark.createDataFrame([(f, "x", a, "Aporte") for f, a, _ in flows], schemas.APORTES)
    exp = spark.createDataFrame([(f, "x", b) for f, _, b in flows], schemas.GASTOS)
    asked = {f + dt.timedelta(days=k) for f in by_day for k in (0, 1)}
    got = {r["corte"]: r for r in plans.balance_snapshots(led, exp, sorted(asked)).collect()}
    for f, figures in by_day.items():
        assert [got[f]["fecha"], got[f]["ingreso"], got[f]["gasto"], got[f]["balance"]] == [f, *figures]
        assert got[f]["balance_txt"] == f"{figures[2]:,}"
    assert set(got) == asked and all(r["fecha"] == max(f for f in by_day if f <= d) for d, r in got.items())
    assert got[max(got)]["balance"] == plans.headline_kpis(led, exp).first()["balance"]
    assert (got[D(2023, 12, 17)]["titulo"], got[D(2023, 12, 17)]["pestana"]) == ("17 de diciembre del 2023", "Diciembre")


# -- payments counted at key grain -----------------------------------------------

PAYERS = [(1, "Ana"), (2, "Bo"), (2, "Bob"), (3, "Cy"), (4, "Cy"), (None, "Nadie")]
keys = st.one_of(st.none(), st.integers(1, 6))    # 5 and 6 have no payer


@pytest.mark.parametrize("limit", [100_000, 1])
@SETTINGS
@given(rows=st.lists(st.tuples(keys, days, amounts), max_size=30))
def test_counting_payments_equals_the_row_join(spark, limit, rows):
    pay = spark.createDataFrame([(k, f, None if a is None else Decimal(a), "x") for k, f, a in rows],
                                "id_pagador int, fecha date, aporte decimal(18,2), concepto string")
    k = KeyedLedger(pay, spark.createDataFrame(PAYERS, "id_pagador int, miembro string"))
    exp = spark.createDataFrame([(D(2023, 1, 2), "agua", Decimal("10"))], schemas.GASTOS)
    before, keyed_module.MAX_EXCEPTIONS = keyed_module.MAX_EXCEPTIONS, limit
    try:
        for report in (plans.date_labels, plans.label_order, lambda x: plans.label_order(x, label=month_label),
                       lambda x: plans.balance_timeline(x, exp)):
            assert _bag(report(k)) == _bag(report(k.flat()))
    finally:
        keyed_module.MAX_EXCEPTIONS = before


def test_no_payment_is_shuffled_by_payer_for_labels_and_balance(spark):
    pay = spark.range(5000).select((F.col("id") % 700).cast("int").alias("id_pagador"),
                                   F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("fecha"),
                                   F.lit(1).cast("decimal(18,2)").alias("aporte"), F.lit("x").alias("concepto"))
    k = KeyedLedger(pay, spark.range(650).select(F.col("id").cast("int").alias("id_pagador"), F.lit("n").alias("miembro")))
    exp = spark.createDataFrame([(D(2023, 1, 2), "agua", Decimal("10"))], schemas.GASTOS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (plans.date_labels(k), plans.label_order(k), plans.balance_timeline(k, exp)):
            df.collect()
            text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "BroadcastHashJoin" in text and not re.search(r"Exchange hashpartitioning\((id_pagador|_pz_odd)", text)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- months of a stored ledger ------------------------------------------------------

def _stored(spark, df):
    path = os.path.join(tempfile.mkdtemp(prefix="pozo-ledger-", dir="/tmp"), "l")
    write_ledger(df, path, num_files=2)
    return read_ledger(spark, path)


def test_latest_month_comes_from_the_folder_names(spark, ledger):
    rows = [("2022-12-30", "A", 1, "x"), ("2023-01-02", "A", 1, "x"), ("2023-03-31", "A", 1, "x"), (None, "A", 1, "x")]
    led = _stored(spark, ledger(rows))
    assert stored_months(led) == [D(2023, 3, 1), D(2023, 1, 1), D(2022, 12, 1)]
    assert latest_month(led) == D(2023, 3, 1)
    assert latest_month(led, D(2023, 3, 30)) == D(2023, 1, 1)      # that folder's rows are all later
    assert latest_month(led, D(2022, 1, 1)) is None
    assert latest_month(_stored(spark, ledger(rows[3:]))) is None
    for window in ("current_month", "last_month"):
        for as_of in (None, D(2023, 3, 30), D(2022, 12, 31), D(2022, 1, 1)):
            assert _bag(plans.member_summary(led, window, as_of)) == _bag(plans.member_summary(ledger(rows), window, as_of))
    plan = plans.member_summary(led, "current_month")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan and plan.count("FileScan parquet") == 1


def test_a_folder_without_known_payers_is_passed_over(spark):
    pay = spark.createDataFrame([(1, D(2023, 1, 5), Decimal(3), "x"), (9, D(2023, 4, 5), Decimal(3), "x"), (None, D(2023, 5, 5), Decimal(3), "x")],
                                "id_pagador int, fecha date, aporte decimal(18,2), concepto string")
    names = spark.createDataFrame([(1, "Ana")], "id_pagador int, miembro string")
    stored = KeyedLedger(_stored(spark, pay), names)
    assert latest_month(stored) == D(2023, 1, 1)
    assert _bag(plans.member_summary(stored, "current_month")) == _bag(plans.member_summary(KeyedLedger(pay, names), "current_month"))
