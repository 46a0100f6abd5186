import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pozo.session import build_session  # noqa: E402
from pozo.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Up to 3 attempts per task, so retry behaviour can be tested.
    s = build_session("local[4,3]", 8, app_name="pozo-tests")
    yield s
    s.stop()


def D(s):
    return dt.date.fromisoformat(s)


def M(x):
    return None if x is None else Decimal(str(x))


@pytest.fixture
def ledger(spark):
    """Build a ledger from (fecha, miembro, aporte, concepto) tuples."""
    def make(rows):
        data = [(None if f is None else D(f), m, M(a), c) for f, m, a, c in rows]
        return spark.createDataFrame(data, schemas.APORTES)
    return make


@pytest.fixture
def members(spark):
    """Build a member table from (nombre_pago, condicion, fecha_inicio) tuples."""
    def make(rows):
        data = [(n, c, None if f is None else D(f), n, None) for n, c, f in rows]
        return spark.createDataFrame(data, schemas.MIEMBROS)
    return make


@pytest.fixture
def expenses(spark):
    def make(rows):
        data = [(None if f is None else D(f), i, M(m)) for f, i, m in rows]
        return spark.createDataFrame(data, schemas.GASTOS)
    return make
