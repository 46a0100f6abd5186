"""Pages equal slices of the whole sorted table, however few rows may be sorted."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pozo.operators import tables
from pozo.operators.tables import By, page_rows


def _rows(n, rnd):
    days = [None, dt.date(2023, 1, 1)] + [dt.date(2023, 2, d) for d in range(1, 20)]
    # One day holds a third of the rows, and many rows are equal in every column.
    return [(days[1] if rnd.random() < .33 else rnd.choice(days), rnd.choice(["a", "B", None, "é"]), rnd.choice([None, 1, 2, 3]),
             i if rnd.random() < .5 else 0) for i in range(n)]


@pytest.mark.parametrize("descending,nulls_first", [(False, True), (True, False), (True, True), (False, False)])
def test_deep_pages_rebuild_the_table(spark, monkeypatch, descending, nulls_first):
    monkeypatch.setattr(tables, "TOP", 20)
    monkeypatch.setattr(tables, "KEEP", 25)
    monkeypatch.setattr(tables, "RANGES", 5)
    rows = _rows(700, random.Random(1))
    df = spark.createDataFrame(rows, "d date, s string, n int, i int").repartition(6)
    order = [By(F.col("d"), descending, nulls_first), By(F.lower("s")), By(F.col("n"), True, False)]
    whole = (df.withColumn("_h", F.xxhash64("d", "s", "n", "i")).orderBy(*[b.sort for b in order], "_h").drop("_h").collect())
    for page, size in [(1, 20), (2, 15), (5, 60), (11, 60), (12, 60), (3, 233), (1, 700), (7, 100)]:
        got = page_rows(df, order, page, size).collect()
        at = (page - 1) * size
        assert [r["pos"] for r in got] == list(range(at + 1, min(700, at + size) + 1)), (page, size)
        assert [tuple(r)[:4] for r in got] == [tuple(r) for r in whole[at:at + size]], (page, size)
    assert page_rows(df, order, 9, 100).count() == 0


def test_a_deep_page_inside_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TOP", 5)
    monkeypatch.setattr(tables, "KEEP", 10)
    df = spark.range(300).select(F.lit("x").alias("a"), F.lit(None).cast("int").alias("b"))
    got = page_rows(df, [By(F.col("a")), By(F.col("b"))], 4, 30).collect()
    assert [r["pos"] for r in got] == list(range(91, 121))
    assert page_rows(df.where("false"), [By(F.col("a"))], 4, 30).count() == 0


def test_first_pages_are_a_top_k(spark):
    df = spark.range(100000).select((F.col("id") * 7919 % 100003).alias("v"))
    page = page_rows(df, [By(F.col("v"))], 2, 10)
    assert [r["v"] for r in page.collect()] == sorted(i * 7919 % 100003 for i in range(100000))[10:20]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_a_deep_page_sorts_only_its_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "KEEP", 5000)
    df = spark.range(100000).select((F.col("id") * 7919 % 100003).alias("v"))
    page = page_rows(df, [By(F.col("v"))], 5001, 10)
    assert [r["v"] for r in page.collect()] == sorted(i * 7919 % 100003 for i in range(100000))[50000:50010]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "_pz_kind" not in page.columns and "Filter" in plan
