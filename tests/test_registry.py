"""Every registered query equals its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from pozo.oracle import oracle_sql
from pozo.registry import QUERIES


def queries():
    return dict(QUERIES)

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


# Spark type -> DuckDB type of the same column.
_TYPES = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE",
          "StringType": "VARCHAR", "DateType": "DATE"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    ocols = rel.columns
    assert sorted(df.columns) == sorted(ocols)
    otypes = dict(zip(ocols, map(str, rel.types)))
    for f in df.schema.fields:
        assert _TYPES.get(type(f.dataType).__name__) == otypes[f.name], (f.name, f.dataType)
    assert _bag(df.collect(), df.columns) == _bag(rel.fetchall(), ocols)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["miembro", "cantidad_aportes", "total"]
    assert df.count() > 0
