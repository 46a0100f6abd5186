"""Member summaries, month windows and ordered detail (FIXTURES.md cases)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from pozo import plans
from pozo.plans.summary import ledger_window


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_all_null_amounts_count_and_zero_total(ledger):
    led = ledger([("2023-01-05", "m01", None, "Aporte"), ("2023-01-06", "m01", None, "Aporte")])
    assert rows(plans.member_summary(led), "miembro", "cantidad_aportes", "total") == [
        ("m01", 2, Decimal("0.00"))]


def test_month_edges(ledger):
    led = ledger([("2023-02-28", "a", 10, "Aporte"), ("2023-03-01", "a", 20, "Aporte"),
                  ("2023-03-31", "b", 30, "Aporte")])
    cur = ledger_window(led, "current_month").orderBy("fecha")
    assert [r["fecha"] for r in cur.collect()] == [dt.date(2023, 3, 1), dt.date(2023, 3, 31)]
    prev = ledger_window(led, "last_month")
    assert [r["fecha"] for r in prev.collect()] == [dt.date(2023, 2, 28)]


def test_january_edge_previous_is_december(ledger):
    led = ledger([("2022-12-31", "a", 1, "Aporte"), ("2022-11-30", "a", 1, "Aporte"),
                  ("2023-01-15", "a", 1, "Aporte")])
    prev = ledger_window(led, "last_month")
    assert [r["fecha"] for r in prev.collect()] == [dt.date(2022, 12, 31)]


def test_empty_previous_month(ledger):
    led = ledger([("2023-01-10", "a", 1, "Aporte"), ("2023-03-10", "a", 1, "Aporte")])
    assert plans.member_summary(led, "last_month").count() == 0


def test_null_date_ignored_by_months_kept_all_time(ledger):
    led = ledger([(None, "a", 5, "Aporte"), ("2023-03-10", "a", 1, "Aporte")])
    assert rows(plans.member_summary(led, "current_month"), "miembro", "cantidad_aportes") == [("a", 1)]
    assert rows(plans.member_summary(led), "miembro", "cantidad_aportes") == [("a", 2)]


def test_as_of_caps_the_latest_month(ledger):
    led = ledger([("2023-05-10", "a", 1, "Aporte"), ("2023-06-10", "b", 1, "Aporte"),
                  ("2023-07-01", "c", 1, "Aporte")])
    cur = plans.member_summary(led, "current_month", as_of=dt.date(2023, 6, 30))
    assert rows(cur, "miembro") == [("b",)]


def test_tie_order_by_name(ledger):
    led = ledger([("2023-01-01", "zeta", 100, "Aporte"), ("2023-01-01", "alfa", 100, "Aporte"),
                  ("2023-01-01", "mid", 200, "Aporte")])
    assert rows(plans.member_summary(led), "miembro") == [("mid",), ("alfa",), ("zeta",)]


def test_detail_newest_first_and_ties_by_amount(ledger):
    led = ledger([("2023-01-01", "a", 5, "Aporte"), ("2023-02-01", "a", 1, "Aporte"),
                  ("2023-02-01", "a", 9, "Técnica"), ("2023-01-01", "b", 3, "Aporte")])
    det = plans.member_detail(led).orderBy("miembro", "pos")
    assert rows(det, "miembro", "pos", "aporte") == [
        ("a", 1, Decimal("9.00")), ("a", 2, Decimal("1.00")), ("a", 3, Decimal("5.00")),
        ("b", 1, Decimal("3.00"))]


def test_last_month_detail_has_no_category(ledger):
    led = ledger([("2023-02-01", "a", 1, "Aporte"), ("2023-03-01", "a", 1, "Aporte")])
    assert plans.member_detail(led, "last_month").columns == ["miembro", "pos", "fecha", "aporte"]


def test_pages_cover_every_payment(spark, ledger):
    data = [(f"2023-01-{d:02d}", "hot", d, "Aporte") for d in range(1, 29)] + \
           [("2023-01-01", "cold", 1, "Aporte")]
    led = ledger(data)
    pages = plans.member_pages(led, page_size=10).orderBy("miembro", "pagina")
    got = rows(pages, "miembro", "pagina", "filas")
    assert got == [("cold", 1, 1), ("hot", 1, 10), ("hot", 2, 10), ("hot", 3, 8)]
    first = pages.where("miembro = 'hot' AND pagina = 1").first()["data"]
    assert [x["pos"] for x in first] == list(range(1, 11))
    assert first[0]["fecha"] == dt.date(2023, 1, 28)


def test_summary_totals_sum_to_income(ledger, expenses):
    led = ledger([("2023-01-01", "a", 10, "Aporte"), ("2023-01-02", "b", None, "Aporte"),
                  ("2023-01-03", "b", 7.5, "Técnica")])
    ex = expenses([("2023-01-02", "agua", 3)])
    total = plans.member_summary(led).agg(F.sum("total")).first()[0]
    k = plans.headline_kpis(led, ex).first()
    assert total == k["ingreso"] == Decimal("17.50")
    assert k["balance"] == Decimal("14.50")
    assert k["fecha_max"] == dt.date(2023, 1, 3)


def test_month_windows_are_subsets(ledger):
    led = ledger([(f"2023-{m:02d}-{d:02d}", f"m{d % 3}", d, "Aporte")
                  for m in (1, 2, 3) for d in (1, 15, 28)])
    allm = {r["fecha"] for r in ledger_window(led, "all").collect()}
    cur = {r["fecha"] for r in ledger_window(led, "current_month").collect()}
    prev = {r["fecha"] for r in ledger_window(led, "last_month").collect()}
    assert cur and prev and cur <= allm and prev <= allm and not (cur & prev)


def test_display_names_and_cards(spark, members):
    from pozo.plans.display import SUMMARY_HEADINGS, display_names, member_cards
    s = spark.createDataFrame([("a", 1, Decimal("2"), "x")],
                              "miembro string, cantidad_aportes bigint, total decimal(18,2), otra string")
    assert display_names(s, SUMMARY_HEADINGS).columns == ["Miembro", "Aportes", "Total", "otra"]
    mem = spark.createDataFrame([("p", "Activo", None, "Ana", "ana.png"), ("q", "Activo", None, "Bo", None)],
                                "nombre_pago string, condicion string, fecha_inicio date, nombre string, avatar_img string")
    cards = member_cards(mem).collect()
    assert len(cards) == 1
    assert "<img src='images/avatars/ana.png'/>" in cards[0]["tarjeta"]
    assert "<h5> Ana </h5>" in cards[0]["tarjeta"]


def test_expand_member_matches_detail_by_key(ledger):
    led = ledger([("2023-01-01", "a", 5, "Aporte"), ("2023-02-01", "a", 1, "Aporte"),
                  ("2023-01-01", "b", 3, "Aporte"), ("2023-01-02", None, 2, "Aporte")])
    full = plans.member_detail(led)
    for key in ("a", "b", None):
        got = rows(plans.expand_member(led, key).orderBy("pos"), "miembro", "pos", "fecha", "aporte")
        cond = full["miembro"].isNull() if key is None else (full["miembro"] == key)
        want = rows(full.where(cond).orderBy("pos"), "miembro", "pos", "fecha", "aporte")
        assert got == want and got
