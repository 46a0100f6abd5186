"""Sources and sinks: fixed schemas, readers, the test-table adapter, writers."""

from pozo.sources.schemas import APORTES, GASTOS, MIEMBROS, MULTAS
from pozo.sources.readers import (
    clean_name,
    clean_names,
    prepare_checked,
    prepare_expenses,
    prepare_fines,
    prepare_ledger,
    prepare_members,
    read_table,
)
from pozo.sources.strict import Formats, count_rejects, split_rejects
from pozo.sources.sinks import write_report
from pozo.sources.keyed import KeyedLedger
from pozo.sources.ledger_store import read_ledger, write_ledger

__all__ = [
    "APORTES", "GASTOS", "MIEMBROS", "MULTAS",
    "clean_name", "clean_names", "read_table",
    "prepare_ledger", "prepare_expenses", "prepare_fines", "prepare_members",
    "Formats", "prepare_checked", "split_rejects", "count_rejects",
    "write_report", "KeyedLedger", "read_ledger", "write_ledger",
]
