"""pozo — contribution-ledger analytics on Spark.

Given tables of payments (``aportes``), expenses (``gastos``), receivables
(``multas``) and members (``miembros``), compute the treasury reports: headline
income/expense/balance, per-member summaries (all time, latest month, month
before), per-member ordered detail, yearly dues against target with debt bands,
expense and fine listings, Spanish date labels, and searchable, sortable,
pageable result tables.

Every function takes and returns Spark DataFrames; nothing is collected to the
driver except one-row scalars that Spark itself plans as subqueries.
"""

from pozo.params import Params
from pozo.plans import (
    balance_timeline,
    category_pivot,
    date_labels,
    debt_band,
    expand_member,
    expense_list,
    expense_page,
    fines_list,
    formatted_kpis,
    headline_kpis,
    label_order,
    member_detail,
    member_directory,
    member_pages,
    member_status,
    member_summary,
    year_dues,
)
from pozo.session import build_session
from pozo.sources.keyed import KeyedLedger

__all__ = [
    "Params", "KeyedLedger", "build_session",
    "headline_kpis", "formatted_kpis", "member_summary", "member_detail", "member_pages",
    "expand_member", "category_pivot", "year_dues", "debt_band", "member_status",
    "expense_list", "expense_page", "fines_list", "member_directory",
    "date_labels", "label_order", "balance_timeline",
]
