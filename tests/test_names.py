"""Categories of any spelling as columns: pivot, dues, band, status, search, sink."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pozo import plans
from pozo.operators.names import Exact, apart_without_case, unique_names
from pozo.operators.pivot import pivot_sums
from pozo.operators.tables import search_rows
from pozo.params import Params
from pozo.registry import as_doubles
from pozo.sources import schemas
from pozo.sources.sinks import write_report

P = Params(year=2023)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
# Names people type, and names the reports use themselves.
ODD = ["Aporte", "aporte", "APORTE", "Técnica", "técnica", "Técnica 1.5", "técnica `x`", "Multa.técnica", "balance", "objetivo",
       "condicion", "fecha_inicio", "miembro ", "NA ", "_c0", "_k", "concepto", "s", "", " ", "a\nb", "É", "é", "Balance técnica"]


def _ledger(spark, rows):
    return spark.createDataFrame([(dt.date(2023, m, 1), "Ana" if k else "Bo", None if a is None else Decimal(a), c)
                                  for k, m, a, c in rows], schemas.APORTES)


def _members(spark):
    return spark.createDataFrame([(n, "Activo", dt.date(2023, 1, 1), n, None) for n in ("Ana", "Bo", "Cy")], schemas.MIEMBROS)


@SETTINGS
@given(rows=st.lists(st.tuples(st.booleans(), st.integers(1, 6), st.one_of(st.none(), st.integers(0, 500)),
                               st.sampled_from([*ODD, None])), min_size=1, max_size=40))
def test_any_category_is_a_column_with_its_sum(spark, rows):
    led, mem = _ledger(spark, rows), _members(spark)
    cells = {}
    for k, _, a, c in rows:
        cells.setdefault(("Ana" if k else "Bo", c), []).append(a)

    def strict(member, cat):
        got = cells.get((member, cat))
        return None if got is None or None in got else Decimal(sum(got))

    cats = {c for *_, c in rows} | {"Aporte"}
    piv = plans.category_pivot(led, P)
    assert sorted(piv.columns) == sorted(["miembro", *["NA" if c is None else c for c in cats]])
    for r in piv.collect():
        got = dict(zip(piv.columns, r))
        assert all(got["NA" if c is None else c] == strict(got["miembro"], c) for c in cats)

    dues = plans.debt_band(plans.year_dues(led, mem, P), P)
    fines = sorted(c for c in cats if c is not None and "técnica" in c.lower())
    assert dues.columns == ["miembro", *fines, "Aporte", "objetivo", "balance", "banda"]
    latest = max(m for _, m, _, _ in rows)
    for r in dues.collect():
        got = dict(zip(dues.columns, r))
        assert all(got[c] == strict(got["miembro"], c) for c in fines)
        paid = strict(got["miembro"], "Aporte") or 0
        assert (got["Aporte"], got["objetivo"], got["balance"]) == (paid, latest * 300, paid - latest * 300)
    status = {r["miembro"]: r["balance"] for r in plans.member_status(led, mem, P).collect()}
    assert status == {r[0]: r[dues.columns.index("balance")] for r in dues.collect()}
    assert as_doubles(dues).columns == dues.columns == search_rows(dues, "zzz").columns
    assert search_rows(dues, "ana").count() == 1


def test_true_clashes_are_named_in_the_error(spark):
    led = _ledger(spark, [(True, 1, 5, "NA"), (True, 1, 6, None), (True, 2, 7, "Aporte")])
    with pytest.raises(ValueError, match="'NA'"):
        plans.category_pivot(led, P)
    apart = plans.category_pivot(led, Params(year=2023, null_category="sin concepto")).first()
    assert (apart["NA"], apart["sin concepto"], apart["Aporte"]) == (5, 6, 7)
    assert plans.year_dues(led, _members(spark), P).first()["Aporte"] == 7        # not in this view: no clash
    own = _ledger(spark, [(True, 1, 5, "miembro")])
    with pytest.raises(ValueError, match="'miembro'"):
        plans.category_pivot(own, P)
    with pytest.raises(ValueError, match="'miembro'"):
        plans.year_dues(own, _members(spark), Params(year=2023, fine_pattern="miembro"))
    assert plans.year_dues(own, _members(spark), P).columns == ["miembro", "Aporte", "objetivo", "balance"]


def test_computed_columns_win_over_categories_of_their_name(spark):
    led = _ledger(spark, [(True, 2, 50, "balance"), (True, 2, 60, "objetivo"), (True, 2, 70, "Balance"), (True, 2, 80, "condicion")])
    got = plans.debt_band(plans.year_dues(led, _members(spark), Params(year=2023, fine_pattern=".")), P)
    assert got.columns == ["miembro", "Balance", "condicion", "Aporte", "objetivo", "balance", "banda"]
    ana = [r for r in got.collect() if r[0] == "Ana"][0]
    assert tuple(ana)[1:] == (70, 80, 0, 600, -600, "yellow")


def test_too_many_categories_name_the_way_on(spark):
    led = _ledger(spark, [(True, 1, 1, f"c{i}") for i in range(5)])
    with pytest.raises(ValueError, match="categories="):
        plans.category_pivot(led, Params(year=2023, max_categories=4))
    assert plans.category_pivot(led, Params(year=2023, max_categories=4, categories=("c3",))).columns == ["miembro", "c3"]


def test_reports_share_one_grain(spark):
    led, mem = _ledger(spark, [(True, 1, 5, "Aporte"), (False, 3, 9, "Técnica")]), _members(spark)
    g = plans.dues_grain(led, P)
    for f in (lambda x: plans.category_pivot(x, P), lambda x: plans.year_dues(x, mem, P), lambda x: plans.member_status(x, mem, P)):
        assert sorted(map(tuple, f(g).collect())) == sorted(map(tuple, f(led).collect()))
    with pytest.raises(ValueError, match="year"):
        plans.year_dues(g, mem, Params(year=2022))


def test_pivot_keeps_extra_aggregates_and_case_variants(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("k", "x", 1), ("k", "X", 2)], "k string, c string, v int")
    out = pivot_sums(df, "k", "c", "v", ["x", "X"], [F.count("*").alias("n")])
    assert out.columns == ["k", "x", "X", "n"] and tuple(out.first()) == ("k", 1, 2, 2)


def test_sink_writes_case_variants_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Aporte", "aporte", "x.y")
    path = os.path.join(tempfile.mkdtemp(prefix="pozo-test-", dir="/tmp"), "r")
    write_report(df, path)
    assert spark.read.parquet(path).columns == ["Aporte", "aporte_2", "x.y"]
    assert apart_without_case(["a", "A", "A_2", "a"]) == ["a", "A_3", "A_2", "a_4"]


def test_exact_lookup(spark):
    x = Exact(spark.range(1).selectExpr("1 as a", "2 as b").toDF("Balance", "balance"))
    assert x.df.select(x["balance"]).first()[0] == 2
    with pytest.raises(ValueError, match="no column"):
        x["BALANCE"]
    assert unique_names(["a", "A"]) == ["a", "A"]
