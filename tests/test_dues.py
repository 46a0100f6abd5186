"""Year dues, pivot, bands and status (FIXTURES.md cases)."""

from decimal import Decimal

from pozo import plans
from pozo.params import Params

P23 = Params(year=2023)


def by_member(df):
    return {r["miembro"]: r.asDict() for r in df.collect()}


def test_strict_pivot_cell(ledger):
    led = ledger([("2023-01-05", "A", 100, "Aporte"), ("2023-01-06", "A", None, "Aporte"),
                  ("2023-02-01", "B", 50, "Técnica")])
    got = by_member(plans.category_pivot(led, P23))
    assert got["A"]["Aporte"] is None and got["A"]["Técnica"] is None
    assert got["B"]["Aporte"] is None and got["B"]["Técnica"] == Decimal("50.00")


def test_strict_null_then_dues_use_zero(ledger, members):
    led = ledger([("2023-03-05", "M", 100, "Aporte"), ("2023-03-06", "M", None, "Aporte")])
    mem = members([("M", "Activo", "2023-01-01")])
    r = by_member(plans.year_dues(led, mem, P23))["M"]
    assert r["Aporte"] == Decimal("0") and r["objetivo"] == Decimal("900")
    assert r["balance"] == Decimal("-900")


def test_guest_payer_absent_no_payment_member_present(ledger, members):
    led = ledger([("2023-03-05", "Invitados", 500, "Aporte"), ("2023-03-05", "Ana", 300, "Aporte")])
    mem = members([("Ana", "Activo", "2023-01-01"), ("Bea", "Activo", "2023-02-01")])
    got = by_member(plans.year_dues(led, mem, P23))
    assert set(got) == {"Ana", "Bea"}
    # Bea paid nothing: Aporte 0, target from the shared latest month (3): months 2..3.
    assert got["Bea"]["Aporte"] == 0 and got["Bea"]["objetivo"] == Decimal("600")
    assert got["Ana"]["balance"] == Decimal("300") - Decimal("900")
    assert "Invitados" in {r["miembro"] for r in plans.member_summary(led).collect()}


def test_null_join_keys_match(ledger, members):
    led = ledger([("2023-01-05", None, 100, "Aporte")])
    mem = members([(None, "Activo", "2023-01-01")])
    got = plans.year_dues(led, mem, P23).collect()
    assert len(got) == 1 and got[0]["miembro"] is None and got[0]["Aporte"] == Decimal("100.00")


def test_inactive_payer(ledger, members):
    led = ledger([("2023-04-05", "I", 1000, "Aporte")])
    mem = members([("I", "Inactivo", "2023-01-01")])
    r = by_member(plans.debt_band(plans.year_dues(led, mem, P23), P23))["I"]
    assert r["objetivo"] == 0 and r["balance"] == Decimal("-300") and r["banda"] is None


def test_null_condition(ledger, members):
    led = ledger([("2023-04-05", "N", 50, "Aporte")])
    mem = members([("N", None, "2023-01-01")])
    r = by_member(plans.year_dues(led, mem, P23))["N"]
    assert r["objetivo"] == 0 and r["balance"] == Decimal("50.00")


def test_start_in_earlier_year_month_only_and_calendar(ledger, members):
    led = ledger([("2023-03-05", "S", 0, "Aporte")])
    mem = members([("S", "Activo", "2022-10-01")])
    r = by_member(plans.year_dues(led, mem, P23))["S"]
    assert r["objetivo"] == Decimal("-1800")  # months 3 - 9 = -6, as published
    cal = Params(year=2023, target_mode="calendar")
    r = by_member(plans.year_dues(led, mem, cal))["S"]
    assert r["objetivo"] == Decimal("900")    # January..March


def test_no_payments_this_year(ledger, members):
    led = ledger([("2022-03-05", "A", 10, "Aporte")])
    mem = members([("A", "Activo", "2023-01-01"), ("B", "Inactivo", "2023-01-01")])
    got = by_member(plans.year_dues(led, mem, P23))
    assert got["A"]["Aporte"] == 0 and got["A"]["objetivo"] is None and got["A"]["balance"] is None
    assert got["B"]["balance"] == Decimal("-300")


def test_fine_columns_selected_by_pattern(ledger, members):
    led = ledger([("2023-01-05", "A", 100, "Técnica")])
    mem = members([("A", "Activo", "2023-01-01")])
    cols = plans.year_dues(led, mem, P23).columns
    assert cols == ["miembro", "Técnica", "Aporte", "objetivo", "balance"]
    no_fines = Params(year=2023, categories=("Aporte",))
    assert plans.year_dues(led, mem, no_fines).columns == ["miembro", "Aporte", "objetivo", "balance"]


def test_every_category_is_kept(ledger, members):
    led = ledger([("2023-01-05", "A", 100, "Multa técnica"), ("2023-01-06", "A", 70, "Donación"), ("2023-01-07", "A", 5, None)])
    mem = members([("A", "Activo", "2023-01-01")])
    piv = plans.category_pivot(led, P23).first()
    assert (piv["Multa técnica"], piv["Donación"], piv["NA"]) == (100, 70, 5)
    row = plans.year_dues(led, mem, P23).first()
    assert row["Multa técnica"] == 100 and row["Aporte"] == 0 and "Donación" not in row.asDict()


def test_sorted_by_balance(ledger, members):
    led = ledger([("2023-01-05", "A", 100, "Aporte"), ("2023-01-05", "B", 900, "Aporte")])
    mem = members([("A", "Activo", "2023-01-01"), ("B", "Activo", "2023-01-01")])
    assert [r["miembro"] for r in plans.year_dues(led, mem, P23).collect()] == ["B", "A"]


def test_bands(spark):
    df = spark.createDataFrame([(f"m{i}", Decimal(b)) for i, b in
                                enumerate(["-300", "-301", "-900", "-901"])] + [("mnull", None)],
                               "miembro string, balance decimal(18,2)")
    got = {r["miembro"]: r["banda"] for r in plans.debt_band(df, P23).collect()}
    assert got == {"m0": None, "m1": "yellow", "m2": "yellow", "m3": "red", "mnull": None}


def test_status_boundaries_inclusive(ledger, members):
    # Target in March for a January start: 900. Paid 601, 600, 1, 0 -> owes 299, 300, 899, 900.
    led = ledger([("2023-03-01", n, p, "Aporte") for n, p in
                  (("A", 601), ("B", 600), ("C", 1), ("D", 0))])
    mem = members([(n, "Activo", "2023-01-01") for n in "ABCD"] + [("E", "Inactivo", "2023-01-01")])
    got = {r["miembro"]: (r["estado"], r["balance_tope"]) for r in
           plans.member_status(led, mem, P23).collect()}
    assert got["A"][0] == "Activo" and got["B"][0] == "En atraso"
    assert got["C"][0] == "En atraso" and got["D"][0] == "Suspendido"
    assert got["E"][0] == "Inactivo"
    assert got["D"][1] == Decimal("-900")


def test_member_key_normalised_or_raw(ledger, members):
    led = ledger([("2023-01-05", "ana pérez", 300, "Aporte")])  # ledger names are title-cased at prep
    from pozo.sources.readers import prepare_ledger
    led = prepare_ledger(led)
    mem = members([("ana pérez", "Activo", "2023-01-01")])
    norm = by_member(plans.year_dues(led, mem, P23))
    assert norm["Ana Pérez"]["Aporte"] == Decimal("300.00")
    raw = by_member(plans.year_dues(led, mem, Params(year=2023, raw_member_keys=True)))
    assert raw["ana pérez"]["Aporte"] == 0


def test_calendar_mode_unknowns_stay_unknown(ledger, members):
    cal = Params(year=2023, target_mode="calendar")
    led = ledger([("2023-03-05", "A", 100, "Aporte")])
    mem = members([("A", "Activo", None), ("B", "Activo", "2024-02-01"), ("C", "Activo", "2023-02-01")])
    got = by_member(plans.year_dues(led, mem, cal))
    assert got["A"]["objetivo"] is None and got["A"]["balance"] is None
    assert got["B"]["objetivo"] == 0                       # starts after the report year
    assert got["C"]["objetivo"] == Decimal("600")          # February and March
    empty = by_member(plans.year_dues(ledger([("2022-01-01", "A", 1, "Aporte")]), mem, cal))
    assert empty["C"]["objetivo"] is None


def test_as_of_snapshot_of_the_dues(ledger, members):
    import datetime as dt
    led = ledger([("2023-02-05", "A", 300, "Aporte"), ("2023-05-05", "A", 300, "Aporte")])
    mem = members([("A", "Activo", "2023-01-01")])
    snap = by_member(plans.year_dues(led, mem, Params(as_of=dt.date(2023, 3, 31))))["A"]
    assert snap["Aporte"] == Decimal("300.00") and snap["objetivo"] == Decimal("600")   # through February
    full = by_member(plans.year_dues(led, mem, Params(year=2023)))["A"]
    assert full["Aporte"] == Decimal("600.00") and full["objetivo"] == Decimal("1500")  # through May
