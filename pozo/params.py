"""Report parameters (the reference hard-codes these; here they are arguments)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Params:
    """Knobs of the treasury reports.

    ``year`` is the calendar year of the dues report; ``None`` means the year of
    the wall clock, as the original report does. ``as_of`` restricts every
    ledger-relative report to rows on or before that date before the latest
    date is taken (``None``: no restriction).
    """

    # Must equal the published report for right results.
    dues: Decimal = Decimal("300")               # monthly dues per active member
    inactive_balance: Decimal = Decimal("-300")  # balance shown for inactive members
    yellow_below: Decimal = Decimal("-300")      # band "yellow" when balance < this
    red_below: Decimal = Decimal("-900")         # band "red" when balance < this
    inactive_label: str = "Inactivo"             # member condition meaning paused
    dues_category: str = "Aporte"                # ledger category holding dues
    fine_pattern: str = "Técnica"                # category columns kept in dues view
    categories: tuple | None = None              # pivot columns, in output order; None: all of the year's
    null_category: str = "NA"                    # column of payments without a category
    max_categories: int = 500                    # more distinct categories than this raise an error

    year: int | None = None
    as_of: _dt.date | None = None
    # "month_only": active months = latest month - (start month - 1), whatever
    # the start year (published behaviour). "calendar": clamp the start to the
    # report year, so members who joined earlier owe every month so far.
    target_mode: str = "month_only"
    # Title-case the member directory key like the ledger key (False copies
    # the original, which compares a title-cased ledger name with a raw one).
    raw_member_keys: bool = False
    page_size: int = 10

    def report_year(self) -> int:
        """The dues year: ``year``, else the year of ``as_of``, else the clock's."""
        if self.year is not None:
            return self.year
        return (self.as_of or _dt.date.today()).year
