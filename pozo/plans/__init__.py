"""The treasury reports, each a DataFrame -> DataFrame function."""

from pozo.plans.summary import (
    expand_member,
    ledger_window,
    member_detail,
    member_pages,
    member_summary,
)
from pozo.plans.kpis import formatted_kpis, headline_kpis
from pozo.plans.dues import DuesGrain, category_pivot, debt_band, dues_grain, member_status, year_dues
from pozo.plans.listings import expense_list, expense_page, fines_list, member_directory
from pozo.plans.labels import date_labels, label_order
from pozo.plans.timeline import balance_snapshots, balance_timeline
from pozo.plans.display import display_names, member_cards

__all__ = [
    "ledger_window", "member_summary", "expand_member", "member_detail", "member_pages",
    "headline_kpis", "formatted_kpis",
    "DuesGrain", "dues_grain", "category_pivot", "year_dues", "debt_band", "member_status",
    "expense_list", "expense_page", "fines_list", "member_directory",
    "date_labels", "label_order", "balance_timeline", "balance_snapshots",
    "display_names", "member_cards",
]
