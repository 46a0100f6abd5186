"""Stored ledger: same reports, month folders pruned at run time."""

import os
import tempfile

import pytest

from pozo import plans
from pozo.params import Params
from pozo.sources import adapter
from pozo.sources.ledger_store import read_ledger, write_ledger

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _scan_metrics(df):
    out = []

    def walk(p):
        name = p.nodeName()
        if "Scan" in name:
            it = p.metrics().iterator()
            vals = {}
            while it.hasNext():
                kv = it.next()
                vals[kv._1()] = kv._2().value()
            out.append(vals)
        if name == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in name:
            walk(p.plan())
        ch = p.children().iterator()
        while ch.hasNext():
            walk(ch.next())
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_stored_ledger_reports_equal_and_prune(spark):
    src = adapter.aportes(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="pozo-ledger-", dir="/tmp"), "ledger")
    write_ledger(src, path, num_files=4)
    led = read_ledger(spark, path)
    months = len({p.split("/mes=")[0] + p.split("/mes=")[1].split("/")[0] for p in led.inputFiles()})
    assert months > 20
    for window in ("all", "current_month", "last_month"):
        a = sorted(map(tuple, plans.member_summary(led, window).collect()))
        b = sorted(map(tuple, plans.member_summary(src, window).collect()))
        assert a == b, window
    cur = plans.member_summary(led, "last_month")
    cur.collect()
    parts = [m.get("numPartitions") for m in _scan_metrics(cur) if "numPartitions" in m]
    assert parts and max(parts) == 1          # one month folder read, not all of them
    mem = adapter.miembros(spark, SF)
    p = Params(year=2001)
    dues = plans.year_dues(led, mem, p)
    assert sorted(map(tuple, dues.collect())) == sorted(map(tuple, plans.year_dues(src, mem, p).collect()))
    assert "anio" not in dues.columns and "mes" not in plans.member_detail(led).columns


def test_stored_keyed_payments_prune_too(spark):
    from pozo.sources.keyed import KeyedLedger
    keyed = adapter.aportes_keyed(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="pozo-ledger-", dir="/tmp"), "pagos")
    write_ledger(keyed.payments, path, num_files=4)
    stored = KeyedLedger(read_ledger(spark, path), keyed.payers, keyed.key)
    got = plans.member_summary(stored, "last_month")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plans.member_summary(keyed, "last_month").collect()))
    parts = [m.get("numPartitions") for m in _scan_metrics(got) if "numPartitions" in m]
    assert parts and max(parts) == 1


def test_as_of_reads_no_later_folder(spark):
    import datetime as dt
    src = adapter.aportes(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="pozo-ledger-", dir="/tmp"), "ledger")
    write_ledger(src, path, num_files=4)
    led = read_ledger(spark, path)
    day = dt.date(1996, 3, 15)
    got = plans.member_summary(led, "all", day)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plans.member_summary(src, "all", day).collect()))
    folders = {r[0] for r in led.where("fecha is not null").selectExpr("anio * 100 + mes").distinct().collect()}
    parts = [m.get("numPartitions") for m in _scan_metrics(got) if "numPartitions" in m]
    assert parts and max(parts) == len([f for f in folders if f <= 199603]) < len(folders)


def test_own_year_and_month_columns_are_no_stored_ledger(spark, ledger):
    from pyspark.sql import functions as F
    led = ledger([("2023-05-02", "A", 300, "Aporte"), ("2023-04-02", "B", 100, "Aporte")])
    odd = led.withColumns({"anio": F.lit(1900), "mes": F.lit(1)})
    assert [r["miembro"] for r in plans.member_summary(odd, "current_month").collect()] == ["A"]
    assert plans.category_pivot(odd, Params(year=2023)).count() == 2
