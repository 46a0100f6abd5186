"""Keyed ledger (eager aggregation) equals the flat join, report by report."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pozo import plans
from pozo.params import Params
from pozo.sources import schemas
from pozo.sources.keyed import KeyedLedger

SETTINGS = settings(max_examples=4, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

keys = st.one_of(st.none(), st.integers(min_value=1, max_value=5))   # 5 has no payer: orphan
payments = st.lists(st.tuples(keys, st.one_of(st.none(), st.dates(min_value=dt.date(2022, 11, 1),
                                                                  max_value=dt.date(2023, 4, 30))),
                              st.one_of(st.none(), st.integers(0, 500)),
                              st.sampled_from(["Aporte", "Técnica"])), min_size=0, max_size=25)
# Key 2 is listed twice (two names); keys 3 and 4 share a name.
PAYERS = [(1, "Ana"), (2, "Bo"), (2, "Bob"), (3, "Cy"), (4, "Cy")]


def _frames(spark, rows):
    pay = spark.createDataFrame([(k, f, None if a is None else Decimal(a), c) for k, f, a, c in rows],
                                "id_pagador int, fecha date, aporte decimal(18,2), concepto string")
    names = spark.createDataFrame(PAYERS, "id_pagador int, miembro string")
    keyed = KeyedLedger(pay, names, "id_pagador")
    return keyed, keyed.flat()


def _bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@SETTINGS
@given(rows=payments)
def test_keyed_reports_equal_flat(spark, rows):
    keyed, flat = _frames(spark, rows)
    mem = spark.createDataFrame([(n, "Activo", dt.date(2023, 1, 1), n, None) for n in ("Ana", "Bo", "Bob", "Cy")],
                                schemas.MIEMBROS)
    exp = spark.createDataFrame([(dt.date(2023, 1, 2), "agua", Decimal("10"))], schemas.GASTOS)
    p = Params(year=2023)
    for window in ("all", "current_month", "last_month"):
        assert _bag(plans.member_summary(keyed, window)) == _bag(plans.member_summary(flat, window)), window
    assert _bag(plans.headline_kpis(keyed, exp)) == _bag(plans.headline_kpis(flat, exp))
    assert _bag(plans.category_pivot(keyed, p)) == _bag(plans.category_pivot(flat, p))
    assert _bag(plans.year_dues(keyed, mem, p)) == _bag(plans.year_dues(flat, mem, p))
    assert _bag(plans.member_status(keyed, mem, p)) == _bag(plans.member_status(flat, mem, p))
    assert _bag(plans.balance_timeline(keyed, exp)) == _bag(plans.balance_timeline(flat, exp))
    assert _bag(plans.member_detail(keyed)) == _bag(plans.member_detail(flat))


def _types(df):
    return [(f.name, f.dataType) for f in df.schema.fields]


def test_keyed_schema_matches_flat(spark):
    keyed, flat = _frames(spark, [(1, dt.date(2023, 1, 5), 10, "Aporte")])
    assert _types(plans.member_summary(keyed)) == _types(plans.member_summary(flat))
    p = Params(year=2023)
    assert _types(plans.category_pivot(keyed, p)) == _types(plans.category_pivot(flat, p))
    assert _types(plans.headline_kpis(keyed, flat.limit(0).select("fecha", F.lit("x").alias("item"),
                                                                    F.col("aporte").alias("monto")))) == \
        _types(plans.headline_kpis(flat, flat.limit(0).select("fecha", F.lit("x").alias("item"),
                                                              F.col("aporte").alias("monto"))))


UNIQUE = [(1, "Ana"), (2, "Bo"), (3, "Cy")]


@SETTINGS
@given(rows=payments)
def test_one_to_one_payers_number_per_key(spark, rows):
    pay = spark.createDataFrame([(k, f, None if a is None else Decimal(a), c) for k, f, a, c in rows],
                                "id_pagador int, fecha date, aporte decimal(18,2), concepto string")
    names = spark.createDataFrame(UNIQUE, "id_pagador int, miembro string")
    keyed = KeyedLedger(pay, names, "id_pagador", unique_names=True)
    flat = keyed.flat()
    for window in ("all", "last_month"):
        assert _bag(plans.member_detail(keyed, window)) == _bag(plans.member_detail(flat, window)), window
    assert _bag(plans.member_pages(keyed, page_size=3)) == _bag(plans.member_pages(flat, page_size=3))
    assert plans.member_detail(keyed).columns == plans.member_detail(flat).columns


def test_keyed_names_are_title_cased_like_a_prepared_ledger(spark):
    from pozo.sources.readers import prepare_ledger
    pay = spark.createDataFrame([(1, dt.date(2023, 3, 1), Decimal("300"), "Aporte")],
                                "id_pagador int, fecha date, aporte decimal(18,2), concepto string")
    names = spark.createDataFrame([(1, "ana pérez")], "id_pagador int, miembro string")
    keyed = KeyedLedger(pay, names, "id_pagador")
    flat = prepare_ledger(KeyedLedger(pay, names, "id_pagador", title_case_names=False).flat())
    mem = spark.createDataFrame([("ana pérez", "Activo", dt.date(2023, 1, 1), "Ana", None)], schemas.MIEMBROS)
    p = Params(year=2023)
    assert _bag(plans.member_summary(keyed)) == _bag(plans.member_summary(flat))
    dues = plans.year_dues(keyed, mem, p).collect()
    assert dues[0]["miembro"] == "Ana Pérez" and dues[0]["Aporte"] == Decimal("300.00")


def test_prepare_conforms_types_and_names(spark):
    pay = spark.createDataFrame([(1, "2023-03-01", "300", "Aporte")],
                                "id_pagador int, Fecha string, Aporte string, Concepto string")
    names = spark.createDataFrame([(1, "ana")], "id_pagador int, Miembro string")
    keyed = KeyedLedger.prepare(pay, names)
    assert [(f.name, f.dataType.simpleString()) for f in keyed.payments.schema.fields] == [
        ("id_pagador", "int"), ("fecha", "date"), ("aporte", "decimal(18,2)"), ("concepto", "string")]
    r = plans.member_summary(keyed).first()
    assert r["miembro"] == "Ana" and r["total"] == Decimal("300.00")


def test_names_that_title_casing_merges_are_numbered_together(spark):
    from pozo import plans
    from pozo.sources.keyed import KeyedLedger
    pay = spark.sql("""select * from values (1, date'2023-01-02', 5.00BD, 'Aporte'), (2, date'2023-01-03', 6.00BD, 'Aporte')
                       as t(id_pagador, fecha, aporte, concepto)""")
    payers = spark.sql("select * from values (1, 'ana'), (2, 'Ana') as t(id_pagador, miembro)")
    keyed = KeyedLedger(pay, payers, unique_names=True)
    assert not keyed.one_to_one()
    got = sorted((r["miembro"], r["pos"]) for r in plans.member_detail(keyed).collect())
    assert got == [("Ana", 1), ("Ana", 2)]
    assert KeyedLedger(pay, payers, unique_names=True, title_case_names=False).one_to_one()


def test_category_of_an_orphan_payment_is_no_column(spark):
    from pozo import plans
    from pozo.params import Params
    from pozo.sources.keyed import KeyedLedger
    pay = spark.sql("""select * from values (1, date'2023-01-02', 5.00BD, 'Aporte'), (9, date'2023-01-03', 6.00BD, 'Técnica')
                       as t(id_pagador, fecha, aporte, concepto)""")
    payers = spark.sql("select * from values (1, 'Ana') as t(id_pagador, miembro)")
    got = plans.category_pivot(KeyedLedger(pay, payers), Params(year=2023))
    assert got.columns == ["miembro", "Aporte"]
