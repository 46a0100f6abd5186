"""Readers with declared schemas, preparation, sinks, lineage cut."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from pozo.session import cut_lineage, ensure_checkpoint_dir
from pozo.sources import (APORTES, prepare_fines, prepare_ledger, prepare_members,
                          read_table, write_report)


def _tmp():
    return tempfile.mkdtemp(prefix="pozo-test-", dir="/tmp")


def test_csv_sheet_with_messy_headers_becomes_ledger(spark):
    d = _tmp()
    with open(os.path.join(d, "ingreso.csv"), "w", encoding="utf-8") as fh:
        fh.write("Fecha,Miembro,Aporte,Concepto\n2023-09-05,ana-maría pérez,300,Aporte\n"
                 "2023-09-06,juan,,Técnica\n")
    raw = read_table(spark, d, fmt="csv")
    led = prepare_ledger(raw)
    assert led.schema == APORTES
    got = [tuple(r) for r in led.orderBy("fecha").collect()]
    assert got == [(dt.date(2023, 9, 5), "Ana-María Pérez", Decimal("300.00"), "Aporte"),
                   (dt.date(2023, 9, 6), "Juan", None, "Técnica")]


def test_fines_keep_capitalised_names_and_members_defaults(spark):
    fines = spark.createDataFrame([("2023-01-02", "x", "Técnica", 100.0, "extra")],
                                  "Fecha string, Deudor string, Concepto string, Monto double, Otro string")
    out = prepare_fines(fines)
    assert out.columns == ["Fecha", "Deudor", "Concepto", "Monto"]
    mem = prepare_members(spark.createDataFrame([("ana", "Activo", None)],
                                                "nombre_pago string, condicion string, fecha_inicio string"))
    r = mem.first()
    assert r["fecha_inicio"] is None and r["avatar_img"] is None


def test_write_report_round_trip(spark):
    d = _tmp()
    df = spark.createDataFrame([(dt.date(2023, 1, 1), "a", Decimal("1.50"), "Aporte")], APORTES)
    for fmt in ("parquet", "json", "csv"):
        path = os.path.join(d, fmt)
        write_report(df, path, fmt=fmt)
        back = read_table(spark, path, APORTES, fmt=fmt)
        assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_checkpoint_dir_and_lineage_cut(spark):
    path = ensure_checkpoint_dir(spark)
    assert path
    df = spark.range(10).selectExpr("id * 2 AS v")
    cut = cut_lineage(df)
    assert cut.count() == 10


def test_parquet_missing_optional_column_reads_as_null(spark):
    from pozo.sources import MIEMBROS
    path = os.path.join(_tmp(), "m")
    spark.createDataFrame([("Ana", "Activo", None)],
                          "nombre_pago string, condicion string, fecha_inicio date").write.parquet(path)
    r = read_table(spark, path, MIEMBROS).first()
    assert r["nombre_pago"] == "Ana" and r["avatar_img"] is None and r["fecha_inicio"] is None


def test_misspelt_header_raises_and_fines_match_any_case(spark):
    import pytest
    from pozo.sources.readers import clean_names, prepare_fines, prepare_ledger
    bad = spark.createDataFrame([("2023-01-01", "ana", 5, "Aporte")], "Fecha string, Miembro string, Monto int, Concepto string")
    with pytest.raises(ValueError, match="aporte"):
        prepare_ledger(bad)
    low = spark.createDataFrame([("2023-01-01", "ana", "x", 5)], "fecha string, deudor string, concepto string, monto int")
    row = prepare_fines(low).first()
    assert str(row["Fecha"]) == "2023-01-01" and row["Monto"] == 5
    names = clean_names(spark.createDataFrame([(1, 2, 3)], "a int, `A` int, a_2 int")).columns
    assert len(set(names)) == 3
