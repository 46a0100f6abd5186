"""String helpers: title/sentence case and the two number-to-text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A word starts after any character that is not a letter, mark, digit,
# apostrophe or period; so "ana-maría" has two words and "o'neil" one.
_WORD_BREAK = r"(?<=[^\p{L}\p{M}\p{N}'.])"


def title_case(c) -> Column:
    """Upper-case the first character of each word, lower-case the rest.

    Plain ``initcap`` only breaks words at spaces ("Ana-maría"); splitting
    after every non-word character first gives "Ana-María".
    """
    pieces = F.split(_col(c), _WORD_BREAK, -1)
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def sentence_case(c) -> Column:
    """First character upper-case, the rest lower-case."""
    s = _col(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def _strip_fraction_zeros(s: Column) -> Column:
    # "12,055.50" -> "12,055.5"; "5,932.00" -> "5,932"; integers untouched.
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_amount(c, significant: int = 7) -> Column:
    """Amount text with a thousands comma, as R's ``format(x, big.mark=",")``.

    R prints at most ``significant`` significant digits but never drops
    integer digits, and no trailing fraction zeros: 12055 -> "12,055",
    12055.5 -> "12,055.5", 1234567.8 -> "1,234,568". Ties round half-even.
    Input must be a decimal with scale 2 (the ledger amount type).

    R would switch to scientific notation when that is narrower (100000 ->
    "1e+05", and totals of 13 or more digits); that quirk is not copied:
    amounts always print in fixed notation with separators.
    """
    x = _col(c).cast("decimal(38,2)")
    int_digits = F.length(F.floor(F.abs(x)).cast("string"))
    places = F.greatest(F.lit(0), F.least(F.lit(2), F.lit(significant) - int_digits))
    text = (F.when(places == 0, F.format_number(F.bround(x, 0), 0))
             .when(places == 1, F.format_number(F.bround(x, 1), 1))
             .otherwise(F.format_number(x, 2)))
    return _strip_fraction_zeros(text)


def js_number_text(c) -> Column:
    """A decimal as the browser prints it: no trailing fraction zeros.

    ``250.00`` -> "250", ``1234.50`` -> "1234.5". Integral types pass as is.
    """
    return _strip_fraction_zeros(_col(c).cast("string"))
