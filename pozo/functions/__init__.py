"""Column-level helpers built only from Spark built-in expressions (no UDFs)."""

from pozo.functions.dates import (
    MONTHS_ABBR_ES,
    MONTHS_FULL_ES,
    day_label,
    heading_label,
    month_label,
    tab_label,
)
from pozo.functions.text import (
    format_amount,
    js_number_text,
    sentence_case,
    title_case,
)
from pozo.functions.nulls import lenient_sum, strict_sum

__all__ = [
    "MONTHS_ABBR_ES", "MONTHS_FULL_ES",
    "day_label", "month_label", "heading_label", "tab_label",
    "title_case", "sentence_case", "format_amount", "js_number_text",
    "lenient_sum", "strict_sum",
]
