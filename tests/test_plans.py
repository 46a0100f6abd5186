"""Plan shapes that carry the scale properties, checked on executed plans."""

import os
import re

import pytest

from pozo.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _plan(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans_text(spark):
    return {name: _plan(spark, name) for name in QUERIES}


def test_no_cross_products_anywhere(plans_text):
    for name, text in plans_text.items():
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_year_filter_reaches_the_scan(spark):
    from pozo.plans.dues import year_sums
    from pozo.registry import REPORT_PARAMS
    from pozo.sources import adapter
    df = year_sums(adapter.aportes_keyed(spark, SF), REPORT_PARAMS)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01T00:00)" in text
    assert "LessThan(o_orderdate,2002-01-01T00:00)" in text


def test_scans_read_only_needed_columns(plans_text):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plans_text["q_member_summary"])
    assert "struct<o_custkey:bigint,o_totalprice:double>" in schemas
    assert all("o_orderpriority" not in s and "o_comment" not in s for s in schemas)
    fines = re.findall(r"ReadSchema: (struct<[^>]*>)", plans_text["q_fines_list"])
    assert all("props" not in s for s in fines)


def test_global_numbering_reuses_its_range_exchange(plans_text):
    text = plans_text["q_table_sort"]
    assert "rangepartitioning" in text and "ReusedExchange" in text


def test_summary_aggregates_orders_per_key_before_names(plans_text):
    text = plans_text["q_member_summary"]
    # Orders are aggregated by customer key (eager aggregation), then by name.
    assert "Keys [1]: [id_pagador" in text
    assert "Keys [1]: [miembro" in text


def test_keyed_detail_shuffles_payments_once_by_key(plans_text):
    for name in ("q_member_detail", "q_member_pages"):
        final = plans_text[name].split("== Initial Plan ==")[0]
        parts = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", plans_text[name])
        assert any(p.startswith("id_pagador") for p in parts), name
        assert not any(p.startswith("miembro") for p in parts), name
        assert "Window" in final


def test_dues_read_the_orders_once(plans_text):
    """The report itself scans the members' table alone; the orders' sums come from the checkpoint."""
    text = plans_text["q_year_dues"].split("== Initial Plan ==")[0]
    assert len(re.findall(r"Scan parquet +\(\d+\)", text)) == 1 and "RDD" in text
