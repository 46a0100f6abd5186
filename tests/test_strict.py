"""Cells that are no amount or no date are never read as something else, on any route."""

import datetime as dt
import json
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pozo import plans
from pozo.publish import main
from pozo.sources import APORTES, GASTOS, MIEMBROS, MULTAS, Formats, KeyedLedger, count_rejects, prepare_checked, read_table, write_report
from pozo.sources.readers import INPUTS
from pozo.sources.strict import parse_amount, parse_date

# Per input: header, a good row, and rows with one bad cell each and its column.
CASES = {
    "ledger": (APORTES, "Fecha,Miembro,Aporte,Concepto", ["2023-01-05,ana,10,Aporte", "2023-01-06,bo,,Aporte", ",cy,7.00,"],
               [('2023-01-07,ana,"12,50",Aporte', "aporte"), ("02/01/2023,ana,5,Aporte", "fecha"), ("2023-02-30,ana,5,Aporte", "fecha"),
                ("2023-01-07,ana,5.005,Aporte", "aporte"), ("2023-01-07,ana,1e3,Aporte", "aporte"), ("hoy,ana,x,Aporte", "fecha,aporte")]),
    "expenses": (GASTOS, "Fecha,Item,Monto", ["2023-01-05 00:00:00,agua,10"], [('2023-01-07,agua,"1,250.00"', "monto"), ("5/1/23,agua,5", "fecha")]),
    "fines": (MULTAS, "Fecha,Deudor,Concepto,Monto", ["2023-01-05,ana,x,10"], [("2023-01-05,ana,x,diez", "Monto"), ("enero,ana,x,1", "Fecha")]),
    "members": (MIEMBROS, "nombre_pago,condicion,fecha_inicio,nombre,avatar_img", ["ana,Activo,2023-01-05,Ana,", "bo,Activo,,Bo,"],
                [("cy,Activo,05-01-2023,Cy,", "fecha_inicio")]),
}


def _tmp():
    return tempfile.mkdtemp(prefix="pozo-test-", dir="/tmp")


def _csv(header, lines):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write("\n".join([header, *lines]) + "\n")
    return d


@pytest.mark.parametrize("kind", list(CASES))
def test_bad_cells_are_rejected_with_their_reason(spark, kind):
    schema, header, good, bad = CASES[kind]
    path = _csv(header, good + [line for line, _ in bad])
    accepted, rejected = prepare_checked(kind, read_table(spark, path, fmt="csv"))
    assert accepted.count() == len(good) and accepted.schema.simpleString() == INPUTS[kind][1](spark.createDataFrame([], schema)).schema.simpleString()
    rows = rejected.collect()
    assert sorted(r["columnas_rechazo"] for r in rows) == sorted(c for _, c in bad)
    assert all(r["motivo_rechazo"].startswith(r["columnas_rechazo"].split(",")[0] + ": {") for r in rows)
    assert sum(r["filas"] for r in count_rejects(rejected).collect()) == len(bad)
    # what is accepted alone equals the plain route, and both reader routes agree
    alone = _csv(header, good)
    plain = INPUTS[kind][1](read_table(spark, alone, fmt="csv"))
    typed = INPUTS[kind][1](read_table(spark, alone, schema, fmt="csv"))
    assert sorted(map(str, accepted.collect())) == sorted(map(str, plain.collect())) == sorted(map(str, typed.collect()))


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("kind", list(CASES))
def test_bad_cells_fail_a_query_that_reads_them(spark, kind, ansi):
    schema, header, good, bad = CASES[kind]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for line, columns in bad[:2]:
            path = _csv(header, [*good, line])
            for df in (INPUTS[kind][1](read_table(spark, path, fmt="csv")), read_table(spark, path, schema, fmt="csv")):
                with pytest.raises(Exception, match=f"{columns}: .*is not a"):
                    df.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_an_unquoted_comma_shifts_nothing(spark):
    path = _csv("Fecha,Miembro,Aporte,Concepto", ["2023-01-05,ana,10,Aporte", "2023-01-05,ana,12,50,Aporte", "2023-01-05,ana"])
    accepted, rejected = prepare_checked("ledger", read_table(spark, path, fmt="csv"))
    assert [tuple(r) for r in accepted.collect()] == [(dt.date(2023, 1, 5), "Ana", Decimal("10.00"), "Aporte")]
    assert sorted(r["motivo_rechazo"] for r in rejected.collect()) == [
        "malformed line: 2023-01-05,ana", "malformed line: 2023-01-05,ana,12,50,Aporte"]
    with pytest.raises(Exception, match="malformed line"):
        plans.member_summary(INPUTS["ledger"][1](read_table(spark, path, fmt="csv"))).collect()


def test_json_lines_behave_like_csv(spark):
    d = _tmp()
    lines = [{"fecha": "2023-01-05", "miembro": "ana", "aporte": 10.5, "concepto": "Aporte"},
             {"fecha": "2023-01-05", "miembro": "ana", "aporte": "12,50", "concepto": "Aporte"},
             {"fecha": "2023-01-05", "miembro": "bo", "aporte": None}, {"fecha": 20230105, "miembro": "bo", "aporte": 1}]
    with open(os.path.join(d, "a.json"), "w", encoding="utf-8") as fh:
        fh.write("\n".join([*map(json.dumps, lines), '{"fecha": "2023']))
    for schema in (None, APORTES):
        if schema is None:
            accepted, rejected = prepare_checked("ledger", read_table(spark, d, fmt="json"))
            assert sorted((r["miembro"], r["aporte"]) for r in accepted.collect()) == [("Ana", Decimal("10.50")), ("Bo", None)]
            assert sorted(r["columnas_rechazo"] for r in rejected.collect()) == ["aporte", "fecha", "line"]
        else:
            with pytest.raises(Exception, match="is not a|malformed line"):
                read_table(spark, d, schema, fmt="json").collect()


def test_declared_formats_read_what_people_type(spark):
    path = _csv("Fecha,Miembro,Aporte,Concepto", ['02/01/2023,ana,"1.250,50",Aporte', '2023-03-01,ana,"-7,5",Aporte', '31/02/2023,ana,"1,0",x',
                                                  '03/01/2023,ana,"1.25,5",x', "03/01/2023,ana,1.250,Aporte"])
    f = Formats(decimal=",", thousands=".", dates=("dd/MM/yyyy", "yyyy-MM-dd"))
    accepted, rejected = prepare_checked("ledger", read_table(spark, path, fmt="csv"), f)
    assert sorted((str(r["fecha"]), r["aporte"]) for r in accepted.collect()) == [
        ("2023-01-02", Decimal("1250.50")), ("2023-01-03", Decimal("1250.00")), ("2023-03-01", Decimal("-7.50"))]
    assert sorted(r["columnas_rechazo"] for r in rejected.collect()) == ["aporte", "fecha"]
    with pytest.raises(ValueError):
        Formats(decimal=",", thousands=",")


def test_grammars_cell_by_cell(spark):
    amounts = {"12": "12.00", " 12.5 ": "12.50", "+3.10": "3.10", "-0.01": "-0.01", "1.2000": "1.20", "9999999999999999.99": "9999999999999999.99",
               "12,50": None, "1,250.00": None, "1e3": None, "12.": None, ".5": None, "NaN": None, "0x10": None, "٣": None, "1 250": None,
               "99999999999999999": None, "1.005": None, "--1": None, "12d": None, "$5": None}
    dates = {"2023-01-02": "2023-01-02", "2023-01-02 00:00:00": "2023-01-02", "2023-01-02T10:11:12.5Z": "2023-01-02", "2023-1-2": None,
             "02/01/2023": None, "2023-02-29": None, "2024-02-29": "2024-02-29", "2023": None, "44928": None, "2023-01-02x": None, "hoy": None}
    df = spark.createDataFrame([(k,) for k in amounts], "t string")
    assert {r[0]: None if r[1] is None else str(r[1]) for r in df.select("t", parse_amount(F.col("t"), T.DecimalType(18, 2))).collect()} == amounts
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    assert {r[0]: None if r[1] is None else str(r[1]) for r in df.select("t", parse_date(F.col("t"))).collect()} == dates


def test_typed_columns_that_hold_no_amount_are_rejected(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), "a", 12.345, "x"), (dt.date(2023, 1, 1), "a", float("nan"), "x"),
                                (dt.date(2023, 1, 1), "a", 1e30, "x"), (dt.date(2023, 1, 1), "a", None, "x")],
                               "fecha date, miembro string, aporte double, concepto string")
    accepted, rejected = prepare_checked("ledger", df)
    assert sorted(str(r["aporte"]) for r in accepted.collect()) == ["12.35", "None"] and rejected.count() == 2
    number = spark.createDataFrame([(20230101, "a", 1, "x")], "fecha int, miembro string, aporte int, concepto string")
    assert [r["columnas_rechazo"] for r in prepare_checked("ledger", number)[1].collect()] == ["fecha"]


def test_files_of_one_table_must_agree_on_the_header(spark):
    d = _csv("Fecha,Miembro,Aporte,Concepto", ["2023-01-05,ana,10,Aporte"])
    with open(os.path.join(d, "b.csv"), "w", encoding="utf-8") as fh:
        fh.write("Miembro,Fecha,Aporte,Concepto\nbo,2023-01-05,10,Aporte\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, d, fmt="csv").collect()


def test_keyed_payments_are_parsed_alike(spark):
    pay = spark.createDataFrame([(1, "2023-03-01", "12,50", "Aporte")], "id_pagador int, Fecha string, Aporte string, Concepto string")
    names = spark.createDataFrame([(1, "ana")], "id_pagador int, Miembro string")
    with pytest.raises(Exception, match="aporte: .*is not an amount"):
        plans.member_summary(KeyedLedger.prepare(pay, names)).collect()
    got = plans.member_summary(KeyedLedger.prepare(pay, names, formats=Formats(decimal=","))).first()
    assert got["total"] == Decimal("12.50")


def test_csv_without_header_is_matched_by_position(spark):
    path = _csv("2023-01-05,ana,10,Aporte", ["2023-01-06,bo,5,x"])
    assert sorted(r["aporte"] for r in read_table(spark, path, APORTES, fmt="csv", header="false").collect()) == [5, 10]


def test_publish_puts_rejects_aside_and_counts_them(spark):
    base, paths = _tmp(), {}
    for kind, (_, header, good, bad) in CASES.items():
        paths[kind] = _csv(header, good + [line for line, _ in bad])
    args = [x for k, p in paths.items() for x in (f"--{k}", p)]
    out, aside = os.path.join(base, "out"), os.path.join(base, "aside")
    with pytest.raises(Exception, match="is not a"):
        main([*args, "--out", os.path.join(base, "no"), "--input-format", "csv", "--year", "2023"])
    main([*args, "--out", out, "--rejects", aside, "--input-format", "csv", "--year", "2023", "--red-below", "-100",
          "--yellow-below", "-50", "--category", "Aporte", "--inactive-label", "Nadie"])
    counts = spark.read.parquet(os.path.join(out, "rechazos")).collect()
    assert {(r["entrada"], r["columnas_rechazo"]): r["filas"] for r in counts}[("ledger", "aporte")] == 3
    assert sum(r["filas"] for r in counts) == sum(len(bad) for *_, bad in CASES.values())
    kept = spark.read.json(os.path.join(aside, "ledger"))
    assert kept.count() == 6 and {"fecha", "miembro", "aporte", "motivo_rechazo"} <= set(kept.columns)
    dues = {r["miembro"]: r for r in spark.read.parquet(os.path.join(out, "este_ano")).collect()}
    assert dues["Ana"]["banda"] == "red" and dues["Ana"].asDict().keys() == {"miembro", "Aporte", "objetivo", "balance", "banda"}


def test_written_reports_read_back_strictly(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), "a", Decimal("1.50"), "Aporte"), (None, None, None, None)], APORTES)
    for fmt in ("csv", "json", "parquet"):
        path = os.path.join(_tmp(), fmt)
        write_report(df.coalesce(1), path, fmt=fmt)
        assert sorted(map(str, read_table(spark, path, APORTES, fmt=fmt).collect())) == sorted(map(str, df.collect())), fmt
