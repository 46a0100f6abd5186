"""Scalar helpers: labels, title case, number text, name cleaning, null rules."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from pozo.functions import (day_label, format_amount, heading_label, js_number_text,
                            month_label, sentence_case, tab_label, title_case)
from pozo.functions.nulls import lenient_sum, strict_sum
from pozo.sources.readers import clean_name, clean_names


def one(spark, col, value, ddl):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("r")).first()["r"]


def test_spanish_labels(spark):
    d = dt.date(2023, 9, 5)
    ddl = "d date"
    assert one(spark, day_label("d"), d, ddl) == "05 sep 2023"
    assert one(spark, month_label("d"), d, ddl) == "sep 2023"
    assert one(spark, heading_label("d"), d, ddl) == "05 de septiembre del 2023"
    assert one(spark, tab_label("d"), d, ddl) == "Septiembre"


def test_every_month_abbreviation(spark):
    rows = [(dt.date(2023, m, 1),) for m in range(1, 13)]
    got = [r[0] for r in spark.createDataFrame(rows, "d date").orderBy("d")
           .select(month_label("d")).collect()]
    assert [g.split()[0] for g in got] == ["ene", "feb", "mar", "abr", "may", "jun",
                                           "jul", "ago", "sep", "oct", "nov", "dic"]


def test_title_case_breaks_at_hyphen(spark):
    assert one(spark, title_case("s"), "ana-maría pérez", "s string") == "Ana-María Pérez"
    assert one(spark, title_case("s"), "JUAN o'neil", "s string") == "Juan O'neil"
    assert one(spark, title_case("s"), None, "s string") is None
    assert one(spark, title_case("s"), "", "s string") == ""


def test_sentence_case(spark):
    assert one(spark, sentence_case("s"), "sEPTIEMBRE", "s string") == "Septiembre"


def test_format_amount_like_r(spark):
    cases = {"12055": "12,055", "6123": "6,123", "5932": "5,932", "-1234.5": "-1,234.5",
             "12055.50": "12,055.5", "1234567.8": "1,234,568", "0.25": "0.25",
             "123456.25": "123,456.2", "2.5": "2.5", "1000000.5": "1,000,000"}
    for v, want in cases.items():
        got = one(spark, format_amount("x"), Decimal(v), "x decimal(18,2)")
        assert got == want, (v, got, want)


def test_js_number_text(spark):
    assert one(spark, js_number_text("x"), Decimal("250.00"), "x decimal(18,2)") == "250"
    assert one(spark, js_number_text("x"), Decimal("1234.50"), "x decimal(18,2)") == "1234.5"
    assert one(spark, js_number_text("x"), 1200, "x bigint") == "1200"


def test_clean_names():
    assert clean_name("Monto Total") == "monto_total"
    assert clean_name("Fecha") == "fecha"
    assert clean_name("fechaInicio") == "fecha_inicio"
    assert clean_name("Año") == "ano"
    assert clean_name("% pago") == "percent_pago"
    assert clean_name("1er") == "x1er"
    assert clean_name("Member's Name") == "members_name"


def test_clean_names_duplicates(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a_b` int, c int")
    assert clean_names(df).columns == ["a_b", "a_b_2", "c"]


def test_two_null_rules(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", None), ("b", Decimal("100")), ("b", None), ("c", Decimal("5"))],
        "k string, v decimal(18,2)")
    got = {r["k"]: (r["lenient"], r["strict"]) for r in
           df.groupBy("k").agg(lenient_sum("v").alias("lenient"), strict_sum("v").alias("strict")).collect()}
    assert got["a"] == (Decimal("0.00"), None)
    assert got["b"] == (Decimal("100.00"), None)
    assert got["c"] == (Decimal("5.00"), Decimal("5.00"))


def test_strict_sum_filtered_missing_category(spark):
    df = spark.createDataFrame([("a", "x", Decimal("1"))], "k string, c string, v decimal(18,2)")
    r = df.groupBy("k").agg(strict_sum("v", where=F.col("c") == "y").alias("s")).first()
    assert r["s"] is None
